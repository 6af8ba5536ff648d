"""Removal of repeated spans through a compacted de Bruijn graph of the corpus.

Edges are the windows of 13 words, nodes the 12 words that neighbours share. The graph is never held window by window:
consecutive windows of a document with the same minimizer (the smallest hash of four words inside the window) form a path,
and a path is one row. Equal windows have equal minimizers, so whatever repeats meets at its minimizer. One aggregation by
minimizer finds the smallest source document and whether all occurrences run along the same words: such a path does not
branch, it compacts to a single edge, and its source coordinate (the smallest document) holds for all of its windows. Only
where occurrences differ, at the ends of repeated spans and at edits, the paths are taken apart into windows and joined
on (minimizer, window). Every document then verifies the repeated edges against its own coordinates and removes the words
that they cover.

What is shuffled: a row per path (about one in five windows), rows of repeated paths, windows of branching ones, and the
texts once. A bitmap of bounded size says which minimizers may be repeated, so that the second pass sends little else; its
errors cost rows, never results, since the joins are exact.

Defined results: null texts have no words; documents of fewer words than a window keep them all; a null doc_id is smaller
than nothing and has nothing smaller; rows with the same doc_id are one source and each keeps its own words; very long texts
count whole; of equal windows the smallest doc_id is the source, and all others lose theirs; an empty table gives none; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import WordBlock, ensure_columns, gram_hashes, in_bitmap, key_bitmap, materialize, mix, runs, signed, sliding_min, word_blocks

SPAN, GRAM = 13, 4

class Paths:
    """The windows of a block of texts, and their paths: consecutive windows of a text with the same minimizer."""

    def __init__(self, block: WordBlock):
        self.counts = np.maximum(block.counts - SPAN + 1, 0)
        at = runs(self.counts, np.cumsum(block.counts) - block.counts)
        self.minimizers = sliding_min(gram_hashes(block.hashes, GRAM, salt=7), SPAN - GRAM + 1)[at]
        self.windows = gram_hashes(block.hashes, SPAN, salt=11)[at]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        change = (self.minimizers[1:] != self.minimizers[:-1]) | (self.text[1:] != self.text[:-1])
        self.starts = np.flatnonzero(np.concatenate(([True], change))) if len(at) else np.empty(0, np.int64)

    def path_hashes(self) -> np.ndarray:
        """Hash of the windows of each path in their order."""
        if not len(self.windows):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.windows)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.windows))))
        return mix(np.add.reduceat(self.windows * (mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), self.starts))


def _blocks(batches):
    """(doc_id of each text, whether it is null, Paths)."""
    for b in batches:
        keys = np.asarray(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        named = ~np.asarray(b.column(0).is_null().to_numpy(zero_copy_only=False), bool)
        for lo, hi, block in word_blocks(b.column(1), lower=False):
            yield keys[lo:hi], named[lo:hi], Paths(block)


def _rows(names: list[str], *columns: np.ndarray):
    return pa.record_batch([signed(x) if x.dtype == np.uint64 else x for x in columns], names=names)


def _path_rows(batches):
    for keys, named, p in _blocks(batches):
        m, path, text = p.minimizers[p.starts], p.path_hashes(), p.text[p.starts]
        keep = named[text]
        yield _rows(["m", "path", "doc"], m[keep], path[keep], keys[text[keep]])


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Positions of the distinct rows."""
    order = np.lexsort(columns)
    if not len(order):
        return order
    differ = np.zeros(len(order) - 1, bool)
    for c in columns:
        differ |= c[order[1:]] != c[order[:-1]]
    return order[np.concatenate(([True], differ))]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that stays) of every row of `documents` (doc_id, text)."""
    spark = documents.sparkSession
    docs = ensure_columns(documents, doc_id="long", text="string")
    compact = docs.mapInArrow(_path_rows, "m long, path long, doc long").groupBy("m").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.min("path").alias("p1"), F.max("path").alias("p2"))
    repeated = materialize(compact.where("source < last").select("m", "source", (F.col("p1") != F.col("p2")).alias("branches")), "repeated-paths")

    maps = {branches: key_bitmap(repeated.where(F.col("branches") == branches), "m") for branches in (False, True)}
    sent = spark.sparkContext.broadcast((maps[False], maps[True]))

    def second(batches):
        """Rows (m, window, doc): window 0 for paths that may be repeated whole, else one row per window of a path that may branch."""
        whole_map, branch_map = sent.value
        for keys, named, p in _blocks(batches):
            doc, ours = keys[p.text], named[p.text]
            whole = np.flatnonzero(ours & in_bitmap(whole_map, p.minimizers))
            whole = whole[_distinct(p.minimizers[whole], doc[whole])]
            pick = np.flatnonzero(ours & in_bitmap(branch_map, p.minimizers))
            pick = pick[_distinct(p.windows[pick], p.minimizers[pick], doc[pick])]
            both = np.concatenate([whole, pick])
            mark = np.arange(len(both)) < len(whole)
            yield _rows(["m", "window", "whole", "doc"], p.minimizers[both], np.where(mark, np.uint64(0), p.windows[both]), mark, doc[both])

    rows = materialize(docs.mapInArrow(second, "m long, window long, whole boolean, doc long"), "repeated-candidates")
    compacted = repeated.where(~F.col("branches")).select("m", "source")
    by_path = rows.where("whole").join(compacted, "m").where("source < doc").select("doc", F.col("m").alias("key"), F.lit(True).alias("whole"))
    edges = rows.where("not whole").select("m", "window", "doc")
    sources = edges.groupBy("m", "window").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last").drop("last")
    by_window = edges.join(sources, ["m", "window"]).where("source < doc").select("doc", F.col("window").alias("key"), F.lit(False).alias("whole"))
    # a document's own repeated edges, at most one for each of its windows
    marks = by_path.unionByName(by_window).groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), F.col("key"))).alias("whole"), F.collect_list(F.when(~F.col("whole"), F.col("key"))).alias("single"))
    joined = docs.join(marks, docs.doc_id == marks.doc, "left").select("doc_id", "text", "whole", "single")

    def cut(batches):
        for b in batches:
            out = []
            for lo, hi, block in word_blocks(b.column(1), lower=False):
                p = Paths(block)
                dup = np.zeros(len(p.windows), bool)
                first = np.cumsum(p.counts) - p.counts
                for k in range(lo, hi):
                    if b.column(2)[k].is_valid:
                        w = slice(int(first[k - lo]), int(first[k - lo] + p.counts[k - lo]))
                        marked = [np.asarray(b.column(c)[k].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for c in (2, 3)]
                        dup[w] = np.isin(p.minimizers[w], marked[0]) | np.isin(p.windows[w], marked[1])
                # a window covers its 13 words: ends are counted where they begin and where they stop
                word = (np.cumsum(block.counts) - block.counts)[p.text[dup]] + np.flatnonzero(dup) - first[p.text[dup]]
                change = np.bincount(word, minlength=len(block.hashes) + SPAN + 1).astype(np.int64)
                change[SPAN:] -= np.bincount(word, minlength=len(block.hashes) + 1)[: len(change) - SPAN]
                gone = np.cumsum(change)[: len(block.hashes)] > 0
                at = 0
                for k, n in zip(range(lo, hi), block.counts.tolist()):
                    words, g = (b.column(1)[k].as_py() or "").encode().split(), gone[at : at + n]
                    at += n
                    kept = b" ".join([w for w, x in zip(words, g.tolist()) if not x]) if g.any() else b" ".join(words)
                    out.append((n, int(g.sum()), kept.decode()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.record_batch([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (s) WHERE d < doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN cov ON pos.doc_id = cov.doc_id AND pos.p = cov.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
