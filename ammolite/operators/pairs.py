"""Sums over all pairs of rows without a row a pair: blocks of rows meet in tasks and leave a row for each of theirs.

Every pair is looked at, so the time is that of all pairs; what is shuffled is the rows, once for every block, and a few numbers a
row and block. A task holds two blocks and a tile of their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, blocks at least (fewer for fewer rows); rows of a tile's sides.
LARGEST, FEWEST, TILE = 16_384, 12, (256, 1024)


def block_pairs(rows: DataFrame, key: str, values: str, fold: Callable, schema: str, own: str | None = None, blocks: int | None = None) -> DataFrame:
    """The rows of `fold`(ids, values, other ids, other values, same) for every pair of blocks, each block also with itself (same).

    `values` is an array of numbers as long in every row; fold gets matrices of doubles, a row for each id in ascending order, and gives a
    dictionary of columns. A null array is a row of NaN. Rows are dealt by `own`, a number below `blocks`, or by a hash of the key.
    """
    if blocks is None:
        n = rows.count()
        blocks = max(1, min(FEWEST, n // 16), -(-n // LARGEST))
    dealt = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(blocks)) if own is None else F.col(own)
    x = rows.select(F.col(key).cast("long").alias("id"), F.col(values).alias("v"), dealt.cast("int").alias("own"))
    met = x.select("id", "v", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = met.select((F.greatest("own", "other") * F.lit(1 << 20).cast("long") + F.least("own", "other")).alias("pair"), "own", "id", "v")

    def run(t: pa.Table) -> pa.Table:
        ids, side, pair = t["id"].to_numpy(), t["own"].to_numpy(), t["pair"][0].as_py()
        lists = t["v"].combine_chunks()
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = np.full((len(ids), len(held) // max(1, there.sum())), np.nan)
        v[there] = held.reshape(there.sum(), -1) if there.any() else v[there]

        def block(k):
            at = np.flatnonzero(side == k)
            at = at[np.argsort(ids[at], kind="stable")]
            return ids[at], v[at]

        hi, lo = pair >> 20, pair & ((1 << 20) - 1)
        a = block(lo)
        b = a if lo == hi else block(hi)
        return pa.table(fold(*a, *b, lo == hi))

    return met.repartition(min(2000, blocks * (blocks + 1) // 2), "pair").groupBy("pair").applyInArrow(run, schema)


def tiles(n: int, m: int, same: bool) -> Iterator[tuple[slice, slice]]:
    """Parts of an n x m matrix; of a block with itself those that touch the part above the diagonal."""
    for i in range(0, n, TILE[0]):
        for j in range(0, m, TILE[1]):
            if not same or j + TILE[1] > i:
                yield slice(i, min(n, i + TILE[0])), slice(j, min(m, j + TILE[1]))


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of a tile: euclidean, manhattan, chebyshev or cosine.

    Euclidean ones of wide rows come from products; where these cancel, of rows that are nearly the same, from differences.
    """
    if metric == "cosine":
        return 1 - (a @ b.T) / np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
    if metric == "euclidean" and a.shape[1] > 8:
        norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        total = norms - 2 * (a @ b.T)
        near = total <= 1e-7 * norms
        if near.any():
            i, j = np.nonzero(near)
            for k in range(0, len(i), 10_000):
                part = slice(k, k + 10_000)
                total[i[part], j[part]] = ((a[i[part]] - b[j[part]]) ** 2).sum(1)
        return np.sqrt(total, out=total)
    if metric == "manhattan" and a.shape[1] > 8:
        return _manhattan(a, b)
    total, gap = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        np.subtract(x[:, None], y[None, :], out=gap)
        if metric == "euclidean":
            np.multiply(gap, gap, out=gap)
            total += gap
        else:
            np.abs(gap, out=gap)
            (np.add if metric == "manhattan" else np.maximum)(total, gap, out=total)
    return np.sqrt(total, out=total) if metric == "euclidean" else total


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the sum of differences is twice that of the larger values less both sums, unless values are so large that this would lose digits."""
    total, gap, ones = np.empty((len(a), len(b))), np.empty_like(b), np.ones(b.shape[1])
    small = max(np.abs(x).max(initial=0.0) for x in (a, b)) * b.shape[1] < 1e4 and not np.isnan(a).any() and not np.isnan(b).any()
    for x, row in zip(a, total):
        if small:
            np.maximum(b, x, out=gap)
        else:
            np.subtract(b, x, out=gap)
            np.abs(gap, out=gap)
        np.dot(gap, ones, out=row)
    if small:
        total *= 2
        total -= a.sum(1)[:, None]
        total -= b.sum(1)
    return total


def distance_sums(vectors: DataFrame, key: str, vector: str, metric: str = "euclidean", digits: int = 5) -> DataFrame:
    """(i, n, total, least, most) of the rounded distances of each row to all rows with a larger key: how many pairs, their sum, least and largest.

    Pairs with a null array count in n only. Rows with the same key are not compared; the largest key has no row. Blocks are ranges of the key, so that of two blocks
    the rows of one look at all rows of the other.
    """
    count = vectors.count()
    blocks = max(1, min(FEWEST, count // 16), -(-count // LARGEST))
    place = F.col(key).cast("double")
    bounds = vectors.select(place.alias("k")).approxQuantile("k", [k / blocks for k in range(1, blocks)], 0.02 / blocks) if blocks > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0)

    def fold(ids, v, others, w, same):
        n = np.zeros(len(ids) + len(others), np.int64)
        total, least, most, any_ = np.zeros(len(n)), np.full(len(n), np.inf), np.full(len(n), -np.inf), np.zeros(len(n), bool)
        here, there = ~np.isnan(v).all(1), ~np.isnan(w).all(1)
        whole = bool(not same and len(ids) and len(others) and ids[-1] < others[0] and not np.isnan(v).any() and not np.isnan(w).any())
        for a, b in tiles(len(ids), len(others), same):
            d = distances(v[a], w[b], metric)
            d *= 10.0**digits
            d += 0.5
            np.floor(d, out=d)
            d /= 10.0**digits
            if whole:
                n[a] += d.shape[1]
                any_[a] = True
                total[a] += d.sum(1)
                least[a] = np.minimum(least[a], d.min(1))
                most[a] = np.maximum(most[a], d.max(1))
                continue
            known = here[a][:, None] & there[b][None, :]
            first = ids[a][:, None] < others[b][None, :]
            sides = [(slice(a.start, a.stop), first, 1)]
            if not same:
                sides.append((slice(len(ids) + b.start, len(ids) + b.stop), ids[a][:, None] > others[b][None, :], 0))
            for at, mask, axis in sides:
                n[at] += mask.sum(axis)
                mask = mask & known
                total[at] += np.where(mask, d, 0).sum(axis)
                least[at] = np.fmin(least[at], np.fmin.reduce(np.where(mask, d, np.inf), axis))
                most[at] = np.maximum(most[at], np.where(mask, d, -np.inf).max(axis))
                any_[at] |= mask.any(axis)
        kept = n > 0
        number = lambda x: pa.array(x[kept], mask=~any_[kept])
        return {"i": np.concatenate([ids, others])[kept], "n": n[kept], "total": number(total), "least": number(least), "most": number(most)}

    parts = block_pairs(vectors.withColumn("_own", own), key, vector, fold, "i long, n long, total double, least double, most double", own="_own", blocks=blocks)
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
