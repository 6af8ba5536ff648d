"""Alignment of the tokens of two tokenizers over the same bytes.

Every byte of a text gets a label: no token ends there, one of tokenizer A does, one of B does, or both do. A regular
expression scans the label string for spans up to and with each both-label; the labels in a span say how many tokens of A
and of B make its group. The last token of A and the last of B in a group end together: that is a link.

Texts are cut before each run of spaces or line feeds where neither vocabulary can join across, so that both tokenizers
end a token at every cut; what a chunk between cuts gives is remembered up to a bound. Texts with characters that could
make a difference are one chunk. Links are counted over the corpus by a grouping on the id pair. Pairs with at least one
of `HEAVY` equal shares of all links are at most `HEAVY` many whatever the size of the corpus: their counts are broadcast.
The links of all other pairs, none of which has more than such a share, meet their counts in a join.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text, have no
tokens: zeros and an empty hash, and no links that count. Repeated rows and repeated or null doc_ids are rows of their own,
and each counts its links. Very long texts are aligned whole. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import blocks, discard, ensure_columns, materialize, release, runs, text_blocks, tokenizer_path

#: Pairs of ids whose counts are broadcast, at most (20 bytes each).
HEAVY = 200_000
#: Chunks whose alignment a task remembers, at most; none longer than LONGEST characters.
REMEMBERED, LONGEST = 400_000, 48
#: The label of a byte, by whether a token of A (1) or of B (2) ends there.
NONE, A_END, B_END, BOTH = b"0", b"1", b"2", b"3"
SPAN = re.compile(rb"[^3]*3")
_CHUNK = re.compile(r"[ \n]+[^ \n]*")
#: Texts with a space or line feed at an end or beside another one.
_RUNS = re.compile(r"^[ \n]|[ \n][ \n]|[ \n]$")
#: White space other than the space and the line feed, control and format characters, and B's mark of a space.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]")
#: Before chunks that are written with all their white space; others leave out the one space before them.
_AS_IT_IS = "\x00"
_MARK = "\u2581"


def spans(labels: bytes) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) of each group, from the label string."""
    return [(s.count(A_END) + 1, s.count(B_END) + 1) for s in SPAN.findall(labels)]


def label_string(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """One label a byte, from the byte offsets at which tokens end."""
    labels = np.full(size, NONE[0], np.uint8)
    labels[ends_a - 1] |= 1
    labels[ends_b - 1] |= 2
    return labels.tobytes()


def _with_space(chunk: str) -> str:
    return chunk[1:] if chunk[0] == _AS_IT_IS else chunk if chunk[0] == "\n" else " " + chunk


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Groups and links of texts, by a byte-level `tokenizers` file (A) and a `sentencepiece` model (B).

    What chunks give is held by number: `counts` (tokens of A, of B, groups), `said` (the groups), `links` from `first` on;
    a chunk whose bytes differ on either side is not `good`.
    """

    def __init__(self, path_a: str, path_b: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = _byte_alphabet()
        self.bytes_a = [bytes(map(alphabet.get, t)) if set(t) <= alphabet.keys() else b"" for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(pieces)))))
        # cutting needs a byte-level splitter on A's side, and no piece of B that runs on into a space or line feed
        splitter = json.loads(self.a.to_str())
        self.cuts = splitter["normalizer"] is None and (splitter["pre_tokenizer"] or {}).get("type") == "ByteLevel" and splitter["pre_tokenizer"]["use_regex"]
        self.cuts = self.cuts and not any(re.search(f"[^{_MARK}\n][{_MARK}\n]|\n.", p, re.S) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number, self.said, self.held = {}, [], 0
        self.counts, self.first, self.good = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.links, self.n_links = np.zeros(4096, np.int64), 0

    def _add(self, chunks: list, counts: np.ndarray, said: list[str], links: np.ndarray, good: bool) -> None:
        """Hold what chunks give: their links follow each other."""
        n, m = self.held + len(chunks), self.n_links + len(links)
        while n > len(self.first):
            self.counts, self.first, self.good = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.first, self.good))
        while m > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.counts[self.held : n] = counts
        self.first[self.held : n] = self.n_links + np.cumsum(counts[:, 2]) - counts[:, 2]
        self.good[self.held : n] = good
        self.links[self.n_links : m] = links
        self.number.update(zip(chunks, range(self.held, n)))
        self.said += said
        self.held, self.n_links = n, m

    def _align(self, text: str):
        """(ids of A, ids of B, groups) of a space and the text; None where a side's bytes differ from it."""
        expected = b" " + text.encode()
        ids_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != expected or b"".join(map(self.bytes_b.__getitem__, ids_b)) != expected:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        return ids_a, ids_b, spans(label_string(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]), len(expected)))

    def _say(self, ids_a: np.ndarray, ids_b: np.ndarray, groups: list[tuple[int, int]]) -> tuple[list[str], np.ndarray]:
        """Each group as a string, and its link."""
        a, b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        said, i, j = [], 0, 0
        for na, nb in groups:
            said.append(f"{a[i] if na == 1 else ','.join(a[i : i + na])}|{b[j] if nb == 1 else ','.join(b[j : j + nb])}")
            i, j = i + na, j + nb
        sizes = np.array(groups, np.int64).reshape(-1, 2)
        last = np.cumsum(sizes, 0) - 1
        return said, ids_a[last[:, 0]] << 32 | ids_b[last[:, 1]]

    def _one(self, key, text: str, skip: int) -> None:
        """Hold a chunk that is encoded by itself, without the first `skip` groups (of a token each)."""
        found = self._align(text) if text else None
        if found is None:
            self._add([key], np.zeros((1, 3), np.int64), [""], np.empty(0, np.int64), not text)
            return
        ids_a, ids_b, groups = found[0][skip:], found[1][skip:], found[2][skip:]
        said, links = self._say(ids_a, ids_b, groups)
        self._add([key], np.array([[len(ids_a), len(ids_b), len(groups)]]), [";".join(said)], links, True)

    def _many(self, chunks: list[str]) -> None:
        """Hold chunks with both tokenizers' ends at their ends: encoded as one text, after the chunk " a"."""
        for part in blocks(chunks, 20_000):
            texts = list(map(_with_space, part))
            found = self._align("a" + "".join(texts))
            if found is not None:
                ids_a, ids_b, groups = found
                ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
                cuts = np.cumsum([2, *(len(c.encode()) for c in texts)])
                to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
            if found is None or not ((ends_a[to_a - 1] == cuts) & (ends_b[to_b - 1] == cuts)).all():
                for c, t in zip(part, texts):
                    self._one(c, "a" + t, 1)
                continue
            said, links = self._say(ids_a, ids_b, groups)
            to_g = np.searchsorted(np.cumsum([g[0] for g in groups]), to_a) + 1
            at = to_g.tolist()
            counts = np.stack([np.diff(to_a), np.diff(to_b), np.diff(to_g)], 1)
            self._add(part, counts, [";".join(said[i:j]) for i, j in zip(at, at[1:])], links[1:], True)

    def cut(self, text: str):
        """A text's chunks, the space before each left out; None if it is one chunk."""
        if not text or not self.cuts or _ODD.search(text):
            return None
        if not _RUNS.search(text):
            return text.replace("\n", " \n").split(" ")
        return [c if c[0] == "\n" else c[1:] if c[1:2] not in ("", " ", "\n") else _AS_IT_IS + c for c in _CHUNK.findall(" " + text)]

    def block(self, texts: list[str]):
        """Per text: tokens of A and B, groups, hash of the groups; then all distinct links: text number, id pair, times."""
        cut = [self.cut(t) for t in texts]
        every = set().union(*(c for c in cut if c))
        missing = every.difference(self.number)
        if self.held + len(missing) > self.most:
            self.forget()
            missing = every
        plain = [c for c in missing if c[-1] not in " \n" and len(c) <= LONGEST]
        self._many(plain)
        for c in missing:
            if c[-1] in " \n" and len(c) <= LONGEST:
                self._one(c, "a" + _with_space(c), 1)
        # very long chunks, and texts that are one chunk, are not remembered
        kept, long = self.held, [c for c in missing if len(c) > LONGEST]
        for c in long:
            self._one(c, "a" + _with_space(c), 1)
        numbers = []
        for k, (t, c) in enumerate(zip(texts, cut)):
            if c is None:
                self._one(None, t, 0)
                numbers.append([self.held - 1])
            else:
                numbers.append(list(map(self.number.__getitem__, c)))
        lengths = np.array([len(x) for x in numbers], np.int64)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(texts)), lengths)
        valid = np.bincount(of, ~self.good[flat], len(texts)) == 0
        hashes = [hashlib.sha256(";".join(map(self.said.__getitem__, x)).encode()).hexdigest() if ok and t else "" for x, ok, t in zip(numbers, valid, texts)]
        keep = valid[of]
        flat, of = flat[keep], of[keep]
        counts = self.counts[flat]
        totals = np.stack([np.bincount(of, counts[:, k], len(texts)) for k in range(3)], 1).astype(np.int64)
        # links by number of chunk first: a chunk that a text holds often is looked at once
        chunks, times = np.unique(of * self.held + flat, return_counts=True)
        of, flat = chunks // self.held, chunks % self.held
        per = self.counts[flat, 2]
        linked = self.links[runs(per, self.first[flat])]
        codes, kinds = np.unique(linked, return_inverse=True)
        seen, at = np.unique(np.repeat(of, per) * max(1, len(codes)) + kinds, return_inverse=True)
        total = np.bincount(at, np.repeat(times, per), len(seen)).astype(np.int64)
        for c in [*long, None]:
            self.number.pop(c, None)
        if kept < self.held:
            del self.said[kept:]
            self.held, self.n_links = kept, int(self.first[kept])
        return totals, hashes, seen // max(1, len(codes)), codes[seen % max(1, len(codes))] if len(seen) else seen, total


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.astype(np.int32)))


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256 of every row, and its distinct links: arrays a, b (ids), n (times)."""

    def run(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for lo, hi in text_blocks(texts):
                totals, hashes, of, codes, times = aligner.block(texts[lo:hi])
                sizes = np.bincount(of, minlength=hi - lo)
                lists = [_lists(x, sizes) for x in (codes >> 32, codes & 0xFFFFFFFF, times)]
                columns = [batch.column("row")[lo:hi], batch.column("doc_id")[lo:hi], *map(pa.array, totals.T.copy()), pa.array(hashes), *lists]
                yield pa.record_batch(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "n"])
        del aligner
        release()

    rows = ensure_columns(documents, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, links (of the pair over the whole corpus), best (whether no other a has more links with b)."""
    pairs = aligned.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("links"))
    pairs = materialize(pairs, "link-counts")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def alignment(documents: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `documents`."""
    spark = documents.sparkSession
    aligned = materialize(align(documents, path_a, path_b), "alignment")
    counts = materialize(link_counts(aligned), "link-table")
    total = counts.agg(F.sum("links")).first()[0] or 0
    share = max(1, -(-total // heavy))
    frequent = counts.where(F.col("links") >= share).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), "links", "best").toArrow()
    order = np.argsort(frequent["code"].to_numpy())
    table = tuple(frequent[k].to_numpy()[order] for k in ("code", "links", "best"))
    told = spark.sparkContext.broadcast(table)

    def judge(batches):
        codes, links, best = told.value
        for batch in batches:
            lists = {k: batch.column(k) for k in "abn"}
            a, b, n = (lists[k].flatten().to_numpy().astype(np.int64) for k in "abn")
            of = np.repeat(np.arange(len(batch)), lists["n"].value_lengths().to_numpy())
            code = a << 32 | b
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            at, rest = at[hit], ~hit
            sums = [np.bincount(of[hit], n[hit] * w, len(batch)).astype(np.int64) for w in (best[at], links[at])]
            sums.append(np.bincount(of, n, len(batch)).astype(np.int64))
            sizes = np.bincount(of[rest], minlength=len(batch))
            names = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
            yield pa.record_batch([*map(batch.column, names), *map(pa.array, sums), *(_lists(x[rest], sizes) for x in (a, b, n))], names=[*names, "n_best", "count_sum", "n_links", "a", "b", "n"])

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, n_links long, a array<int>, b array<int>, n array<int>"
    judged = materialize(aligned.mapInArrow(judge, kinds), "alignment-judged")
    discard(aligned)
    rare = judged.select("row", F.inline(F.arrays_zip("a", "b", "n"))).join(counts.where(F.col("links") < share), ["a", "b"])
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("rare_best"), F.sum(F.col("n") * F.col("links")).alias("rare_sum"))
    added = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return judged.drop("a", "b", "n").join(rare, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "rare_best"), added("count_sum", "rare_sum"), "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
