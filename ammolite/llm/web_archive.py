"""WARC archives of pages with payload deduplication, and a globally ordered index of captures.

Pages are joined with the first page of each payload digest, written by tasks into archives of gzip members (one record
each) in the shared folder, and every archive's captures become a run sorted by URL key and timestamp. Runs are dealt by
ranges of (URL key, timestamp, page) and each range is merged from its runs by a loser tree, so the ranges together are the
capture history in global order; a URL with very many captures spreads over several ranges by its timestamps. Reading goes
through that index: each record is fetched by its archive, offset and length.

Defined results: a null html is an empty payload and a null url an empty one; rows that share payload and the smallest
page_id are all responses; a null page_id is never the first of a payload that another page has. Only archives that the
committed runs name are read, so repeated attempts of a task leave no duplicates. Repeated rows have a record each; captures of
equal url and time go by page_id; very long payloads are one record, held whole by its task; an empty table gives none; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import ensure_columns, materialize, scratch_path

#: Smaller payloads are always written in full.
MIN_BYTES = 0
#: An archive, and with it a run, ends at this many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parts into which the pages of one payload are dealt.
SALTS = 16
RUN_SCHEMA = "run string, url_key string, captured string, page_id long, path string, offset long, size long, digest string, record_type string"


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, no scheme, user, port or fragment, query arguments sorted."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = parts.hostname or ""
    except ValueError:
        return url
    labels = [x for x in host.lower().split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str, captured: str, payload: bytes, first: int | None) -> tuple[bytes, str, str]:
    """(record, digest, type). A revisit keeps the HTTP head alone and names the page that it refers to."""
    digest, kind = digest_of(payload), "response" if first is None else "revisit"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        body += payload
    url = "".join(c for c in url if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {captured}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(first)}"] if first is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest, kind


def parse_record(raw: bytes) -> dict:
    """Header fields of a record and its payload (None in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields | {"payload_bytes": length}


class LoserTree:
    """Merges k sorted iterators: every inner node holds the loser of its match, so the next item takes log2(k) comparisons."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(runs)
        self.losers = [-1] * k
        for i in range(k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w][1]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, out: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html) below `out`; returns the runs, each sorted."""
    rows = ensure_columns(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("payload", F.sha1("html"))
    # only hashes meet by payload: a page finds its payload's first page by both keys, so a payload that very many pages have is dealt out
    keys = rows.select("payload", "page_id", F.octet_length("html").alias("n"))
    firsts = keys.groupBy("payload").agg(F.min("page_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("pages")).where(F.col("pages") > 1).where(F.col("n") >= min_bytes)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = salted.join(firsts.select("payload", "first", salts), ["payload", "salt"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def write(batches):
        fs, root = _filesystem(out)
        fs.create_dir(root, recursive=True)
        sink, name, captures, at = None, "", [], 0

        def close():
            nonlocal sink, captures, at
            sink.close()
            captures.sort(key=lambda c: (c[0], c[1], -1 if c[2] is None else c[2]))
            columns = list(zip(*captures))
            n = len(captures)
            sink, captures, at = None, [], 0
            return pa.record_batch(
                [pa.array([name] * n), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array([f"{out}/{name}"] * n), *(pa.array(c, pa.int64()) for c in columns[3:5]), pa.array(columns[5]), pa.array(columns[6])],
                names=["run", "url_key", "captured", "page_id", "path", "offset", "size", "digest", "record_type"],
            )

        for b in batches:
            for page, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                if sink is None:
                    name = f"captures-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                captured = (EPOCH + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                record, digest, kind = record_bytes(page, url or "", captured, html.encode(), first)
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                sink.write(member)
                captures.append((url_key(url or ""), captured, page, at, len(member), digest, kind))
                at += len(member)
                if at >= ARCHIVE_BYTES or len(captures) >= ARCHIVE_RECORDS:
                    yield close()
        if sink is not None:
            yield close()

    return materialize(rows.mapInArrow(write, RUN_SCHEMA), "capture-runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order of (url_key, captured, page_id): ranges in partition order, each merged by a loser tree."""

    def merge(batches):
        held: dict[str, list] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for row in b.to_pylist():
                held.setdefault(row["run"], []).append(row)
        key = lambda r: (r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"])
        # fetched blocks of one run arrive whole; those of a run that spans several come in any order
        sorted_runs = [r if all(key(x) <= key(y) for x, y in zip(r, r[1:])) else sorted(r, key=key) for _, r in sorted(held.items())]
        out = []
        for row in LoserTree([((key(r), r) for r in run) for run in sorted_runs]):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return runs.repartitionByRange("url_key", "captured", "page_id").mapInArrow(merge, RUN_SCHEMA)


def read_archives(index: DataFrame) -> DataFrame:
    """One row per capture of the index, from the record that it points at."""

    def read(batches):
        name, source = None, None
        for b in batches:
            out = []
            for path, offset, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                if path != name:
                    fs, file = _filesystem(path)
                    name, source = path, fs.open_input_file(file)
                source.seek(offset)
                record = parse_record(zlib.decompress(source.read(size), 31))
                digest = record["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = record["payload"]
                if payload is not None and (len(payload) != record["payload_bytes"] or digest_of(payload) != digest):
                    raise ValueError(f"damaged record at {offset} of {path}")
                number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
                out.append((number(record["WARC-Record-ID"]), record["WARC-Target-URI"], record["payload_bytes"], digest, record["WARC-Type"], number(record["WARC-Refers-To"]) if "WARC-Refers-To" in record else None))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = index.select("path", "offset", "size").repartition("path").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    runs = write_archives(pages, scratch_path(spark, "archives"))
    # the index is kept: its files, in their order, hold the captures in global order
    index = materialize(merge_runs(runs), "capture-index")
    return read_archives(index).drop("url")


OP6_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM h), f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS f FROM s),
-- base32: five bits at a time, from two hex digits
d AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(s, CAST(i + 1 AS BIGINT), 1)) - 1) AS x FROM f)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x[5 * i // 4 + 1] * 16 + coalesce(x[5 * i // 4 + 2], 0)) >> (3 - 5 * i % 4)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM d"""
