"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept as a fingerprint, for documents as for benchmark items,
so that two texts that share a span of k + w - 1 words share the fingerprint of that span. Fingerprints are joined, and the
documents that meet an item this way have every hit extended to the left and right, word by word, in the whole text. With
k = 5 and w = 9 each shared span of 13 words is found. Items of fewer words are a window of their own: for every length
that occurs among them the documents are fingerprinted once more, with a guarantee of just that length.

Defined results: null and empty texts have no words; an item without words occurs nowhere; repeated documents keep all
their rows, and items with the same text all count. Documents without hits have n_hit 0 and the hash of an empty list. Very
long texts count whole; null ids are kept, those of items are named by no list; empty tables give no rows, or no hits; columns
to be kept may have any names but those that are added.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ammolite.llm.common import WordHash, ensure_columns, gram_hashes, materialize, signed, sliding_min

SPAN, GRAM = 13, 5
#: Item fingerprints of at most this many rows (20 bytes each) and candidates of at most this many bytes are broadcast; beyond that they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8 << 20
_ALNUM = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_CUT = bytes.maketrans(_ALNUM, b" " * len(_ALNUM))


def item_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, a-z and all characters beyond ASCII."""
    return (text or "").encode().lower().translate(_CUT).split()


def fingerprints(hashes: np.ndarray, span: int) -> np.ndarray:
    """Distinct winnowed fingerprints that catch every shared span of `span` words."""
    k = min(GRAM, span)
    grams = gram_hashes(hashes, k, salt=span)
    return np.unique(sliding_min(grams, span - k + 1))


def _fingerprint_rows(lengths: list[int], key: str):
    """Rows (key, span, fp) of every text, for the spans given; with none, for the text's own span (items)."""

    def run(batches):
        known = WordHash()
        for b in batches:
            keys, spans, found = [], [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = item_words(text)
                if not words:
                    continue
                hashes = known.array(words)
                for span in lengths or [min(SPAN, len(words))]:
                    got = fingerprints(hashes, span)
                    found.append(got)
                    keys.append(np.full(len(got), -1 if name is None else name, np.int64))
                    spans.append(np.full(len(got), span, np.int32))
                if len(found) >= 2000:
                    yield flush(keys, spans, found)
                    keys, spans, found = [], [], []
            if found:
                yield flush(keys, spans, found)

    def flush(keys, spans, found):
        return pa.record_batch([np.concatenate(keys), np.concatenate(spans), signed(np.concatenate(found))], names=[key, "span", "fp"])

    return run


def mark(words: list[bytes], items: list[tuple[object, list[bytes]]]) -> tuple[int, list]:
    """(words covered by occurrences of the items' windows, names of the items that occur): hits extended in the words themselves."""
    covered, occurring = np.zeros(len(words) + 1, np.int32), []
    at: dict[tuple, dict] = {}
    for k in {min(GRAM, len(item)) for _, item in items}:
        at[k] = defaultdict(list)
        wanted = {tuple(item[i : i + k]) for _, item in items if min(GRAM, len(item)) == k for i in range(len(item) - k + 1)}
        for i in range(len(words) - k + 1):
            if (gram := tuple(words[i : i + k])) in wanted:
                at[k][gram].append(i)
    for name, item in items:
        k, span = min(GRAM, len(item)), min(SPAN, len(item))
        reached: dict[int, int] = {}  # by diagonal, the end of the last extended hit
        hit = False
        for j in range(len(item) - k + 1):
            for i in at[k].get(tuple(item[j : j + k]), ()):
                if reached.get(i - j, -1) >= i + k:
                    continue
                end_i, end_j = i + k, j + k
                while end_i < len(words) and end_j < len(item) and words[end_i] == item[end_j]:
                    end_i, end_j = end_i + 1, end_j + 1
                start = i
                while start > 0 and j - (i - start) > 0 and words[start - 1] == item[j - (i - start) - 1]:
                    start -= 1
                reached[i - j] = end_i
                if end_i - start >= span:
                    covered[start] += 1
                    covered[end_i] -= 1
                    hit = True
        if hit:
            occurring.append(name)
    return int((np.cumsum(covered[:-1]) > 0).sum()), occurring


def contamination(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; `keep` names further columns of it.

    `benchmark` needs item_id and text. Fingerprints are matched by a join: broadcast if the items' are few, else shuffled.
    """
    items = ensure_columns(benchmark, item_id="string", text="string")
    items = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    wanted = materialize(items.select("item", "text").mapInArrow(_fingerprint_rows([], "item"), "item long, span int, fp long"), "item-fingerprints")
    n = wanted.count()
    spans = sorted(r.span for r in wanted.select("span").distinct().collect())  # 13 values at most
    docs = ensure_columns(documents, doc_id="long", text="string")
    small = n <= BROADCAST_ROWS
    targets = F.broadcast(wanted) if small else wanted
    found = docs.mapInArrow(_fingerprint_rows(spans or [SPAN], "doc"), "doc long, span int, fp long").join(targets, ["span", "fp"]).select("doc", "item").distinct()
    pairs = materialize(found, "candidate-items")
    # each candidate item's text goes with the pair, so that a document meets only the items it may hold
    by_doc = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "item_text")).alias("candidates"))
    by_doc = materialize(by_doc, "candidates")
    held = by_doc.agg(F.sum(F.aggregate("candidates", F.lit(0).cast("long"), lambda n, c: n + 32 + F.octet_length(F.coalesce(c["item_text"], F.lit("")))))).first()[0]
    by_doc = F.broadcast(by_doc) if (held or 0) <= BROADCAST_BYTES else by_doc
    rows = documents.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")) if keep else docs.withColumnRenamed("text", "_text")
    joined = rows.join(by_doc, F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("doc"), "left").drop("doc")

    def judge(batches):
        for b in batches:
            at = b.schema.names.index("_text")
            out = []
            for text, candidates in zip(b.column(at).to_pylist(), b.column(len(b.schema.names) - 1).to_pylist()):
                words = item_words(text)
                n_hit, names = mark(words, [(c["item_id"], item_words(c["item_text"])) for c in candidates]) if candidates else (0, [])
                listed = ",".join(sorted(x or "" for x in names))
                out.append((len(words), n_hit, len(names), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(words)))
            columns = list(zip(*out)) or [()] * 5
            kept = [b.column(i) for i in range(len(b.schema.names) - 1) if i != at]
            names_kept = [x for x in b.schema.names[:-1] if x != "_text"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.record_batch([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names_kept, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    added = StructType().add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    return joined.mapInArrow(judge, StructType([*(f for f in rows.schema if f.name != "_text"), *added]))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(documents, benchmark)


OP7_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
h AS (SELECT w.doc_id, w.i, w.n, g.item_id FROM w JOIN g ON g.n = w.n AND g.g = w.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
