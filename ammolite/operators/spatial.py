"""Points: nearest neighbours, spatial statistics, interpolation, minimum spanning trees, directions on the sphere.

Points are (id, x, y) or rows with an array of coordinates. Statistics over all pairs have a row a pair by nature: they are
dealt in blocks of points against blocks, so no task holds all of either side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import missing
from ammolite.functions.scans import numbered
from ammolite.functions.storage import cut
from ammolite.operators.pairs import TILE, block_pairs, distances, tiles

#: Blocks into which points are dealt for pairs: a pair of blocks is a key of the join.
BLOCKS = 8


def points(df: DataFrame, key: str, x: str | Column, y: str | Column) -> DataFrame:
    return df.select(F.col(key).alias("id"), missing(x).alias("x"), missing(y).alias("y")).dropna()


def point_pairs(p: DataFrame, other: DataFrame | None = None, both: bool = False) -> DataFrame:
    """(i, j, d) of all pairs i < j of points, of both orders, or of all points of `p` with all of `other`; Euclidean distances."""
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    a = p.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), block.alias("bi"), every.alias("bj"))
    b = (p if other is None else other).select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), block.alias("bj"), every.alias("bi"))
    pairs = a.join(b, ["bi", "bj"])
    if other is None:
        pairs = pairs.where("i != j" if both else "i < j")
    return pairs.select("i", "j", F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)).alias("d"))


def pairwise_distances(vectors: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """(i, j, d) of all pairs i < j of rows with an array of numbers: euclidean, manhattan, chebyshev or cosine."""
    block = F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    v = F.col(vector).cast("array<double>")
    a, b = vectors.select(F.col(key).alias("i"), v.alias("u"), block.alias("bi"), every.alias("bj")), vectors.select(F.col(key).alias("j"), v.alias("v"), block.alias("bj"), every.alias("bi"))
    total = lambda f: F.aggregate(F.zip_with("u", "v", f), F.lit(0.0), lambda s, x: s + x)
    d = {
        "euclidean": F.sqrt(total(lambda x, y: (x - y) * (x - y))), "manhattan": total(lambda x, y: F.abs(x - y)), "chebyshev": F.array_max(F.zip_with("u", "v", lambda x, y: F.abs(x - y))),
        "cosine": 1 - total(lambda x, y: x * y) / F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x) * F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)),
    }[metric]
    return a.join(b, ["bi", "bj"]).where("i < j").select("i", "j", F.round(d, 5).alias("d"))


def ripley_k(p: DataFrame, radii: list[float]) -> DataFrame:
    """K(r) = A 2 #{i < j, d <= r} / (n (n - 1)) without edge correction, A the bounding box, and L(r) - r.

    Pairs are counted block by block: their number within a radius grows by the square, what is shuffled does not.
    """
    box = p.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))

    def fold(ids, v, others, w, same):
        count = np.zeros(len(radii), np.int64)
        for a, b in tiles(len(ids), len(others), same):
            d = distances(v[a], w[b])
            d[ids[a][:, None] >= others[b][None, :] if same else ids[a][:, None] == others[b][None, :]] = np.inf
            count += [np.count_nonzero(d <= r) for r in radii]
        return {"k": np.arange(len(radii), dtype=np.int32), "pairs": count}

    counts = block_pairs(p.select("id", F.array("x", "y").alias("v")), "id", "v", fold, "k int, pairs long").groupBy("k").agg(F.sum("pairs").alias("pairs"))
    every = p.sparkSession.createDataFrame([(k, float(r)) for k, r in enumerate(radii)], "k int, r double")
    rows = every.join(F.broadcast(counts), "k", "left").join(F.broadcast(box)).select("r", F.coalesce("pairs", F.lit(0)).alias("pairs"), "n", "area")
    k = F.col("area") * 2 * F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    return rows.select("r", "pairs", F.round(k, 6).alias("k"), F.round(F.sqrt(k / math.pi) - F.col("r"), 6).alias("l_minus_r"))


def morans_i(p: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of (id, v) with weights 1 / distance, each row's divided by their sum; points at the same place are an error in the caller's data: I is null.

    Blocks of points meet in tasks, which leave a row for each of their points.
    """
    x = values.join(p, "id")
    x = x.join(F.broadcast(x.agg(F.avg("v").alias("mean")))).select("id", F.array("x", "y", F.col("v") - F.col("mean")).alias("v"))

    def fold(ids, v, others, w, same):
        n = np.zeros(len(ids) + (0 if same else len(others)), np.int64)
        s, lag, none = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        for a in range(0, len(ids), TILE[0]):
            a = slice(a, min(len(ids), a + TILE[0]))
            for b in range(0, len(others), TILE[1]):
                b = slice(b, min(len(others), b + TILE[1]))
                d = distances(v[a, :2], w[b, :2])
                pair = ids[a][:, None] != others[b][None, :]
                weight = np.divide(1.0, d, out=np.zeros_like(d), where=pair & (d > 0))
                sides = [(a, w[b, 2], 1)] if same else [(a, w[b, 2], 1), (slice(len(ids) + b.start, len(ids) + b.stop), v[a, 2], 0)]
                for at, z, axis in sides:
                    n[at] += pair.sum(axis)
                    none[at] += (pair & (d == 0)).sum(axis)
                    s[at] += weight.sum(axis)
                    lag[at] += weight @ z if axis else z @ weight
        names, z = (ids, v[:, 2]) if same else (np.concatenate([ids, others]), np.concatenate([v[:, 2], w[:, 2]]))
        kept = n > 0
        return {"i": names[kept], "zi": z[kept], "s": s[kept], "lag": lag[kept], "same": none[kept]}

    parts = block_pairs(x, "id", "v", fold, "i long, zi double, s double, lag double, same long")
    rows = parts.groupBy("i").agg(F.max("zi").alias("zi"), *(F.sum(c).alias(c) for c in ("s", "lag", "same")))
    t = rows.agg(F.count("*").alias("n"), F.sum(F.col("zi") * F.col("lag") / F.nullif(F.col("s"), F.lit(0.0))).alias("up"), F.sum(F.col("zi") * F.col("zi")).alias("down"), F.sum("same").alias("same"))
    return t.select("n", F.when(F.col("same") == 0, F.round(F.col("up") / F.nullif(F.col("down"), F.lit(0.0)), 6)).alias("i"), F.round(-1 / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("expected"))


def near_pairs(p: DataFrame, eps: float) -> DataFrame:
    """(i, j, d) of pairs i < j at most eps apart: points meet in the cells of an eps grid that touch theirs, not with all others."""
    cell = lambda c: F.floor(F.col(c) / eps)
    a = p.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), u -> transform(array(-1, 0, 1), v -> struct(u, v))))")).alias("o")
    b = p.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("bx"), cell("y").alias("by"), around)
    b = b.select("j", "xj", "yj", (F.col("bx") + F.col("o.u")).alias("cx"), (F.col("by") + F.col("o.v")).alias("cy"))
    d = F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))
    return a.join(b, ["cx", "cy"]).where("i < j").select("i", "j", d.alias("d")).where(F.col("d") <= eps)


#: Points of a block among which neighbours are looked for, and query points that meet it in one group.
NEAR_BLOCK = 2048


class Rectangles:
    """Blocks of points in strips by x, each strip cut by y: limits of strips and of their blocks ascend, so both are found by bisection."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.strip, r.block))
        self.first = np.flatnonzero(np.diff([r.strip for r in rows], prepend=-1))
        self.ends = np.append(self.first[1:], len(rows))
        self.block = np.array([r.block for r in rows], np.int64)
        self.lo_x, self.hi_x, self.lo_y, self.hi_y = (np.array([r[c] for r in rows], np.float64) for c in ("lo_x", "hi_x", "lo_y", "hi_y"))
        self.strips = np.minimum.reduceat(self.lo_x, self.first), np.maximum.reduceat(self.hi_x, self.first)

    def home(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The block of a place, or one near it."""
        out = np.empty(len(x), np.int64)
        strip = np.minimum(np.searchsorted(self.strips[1], x), len(self.first) - 1)
        for k in np.unique(strip):
            at, lo, hi = strip == k, self.first[k], self.ends[k]
            out[at] = self.block[lo + np.minimum(np.searchsorted(self.hi_y[lo:hi], y[at]), hi - lo - 1)]
        return out

    def within(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, block) of all blocks whose rectangle is at most r away."""
        far = r * (1 + 1e-9) + 1e-12 * (np.abs(x) + np.abs(y))
        begin, end = np.searchsorted(self.strips[1], x - far), np.searchsorted(self.strips[0], x + far, "right")
        out = []
        for k in range(begin.min(initial=len(self.first)), end.max(initial=0)):
            at, lo, hi = np.flatnonzero((begin <= k) & (k < end)), self.first[k], self.ends[k]
            a, b = np.searchsorted(self.hi_y[lo:hi], y[at] - far[at]), np.searchsorted(self.lo_y[lo:hi], y[at] + far[at], "right")
            n = np.maximum(b - a, 0)
            q, m = np.repeat(at, n), lo + np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            dx, dy = np.maximum(np.maximum(self.lo_x[m] - x[q], x[q] - self.hi_x[m]), 0), np.maximum(np.maximum(self.lo_y[m] - y[q], y[q] - self.hi_y[m]), 0)
            near = np.sqrt(dx * dx + dy * dy) <= far[q]
            out.append((q[near], self.block[m[near]]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _nearest_of(asked: pa.Table, held: pa.Table, k: int, same: bool) -> pa.Table:
    """(i, x, y, home, r, j, d): for each point asked the k nearest held ones at most r away, ties by id, and the distance of the k-th."""
    held = held.take(pa.array(np.argsort(held["id"].to_numpy(), kind="stable")))
    own, ids = asked["i"].to_numpy(), held["id"].to_numpy()
    (ax, ay), (bx, by), most = (asked[c].to_numpy() for c in "xy"), (held[c].to_numpy() for c in "xy"), asked["r"].to_numpy()
    counts, found, gaps, last = [], [], [], np.full(len(own), np.inf)
    for lo in range(0, len(own), TILE[0]):
        t = slice(lo, lo + TILE[0])
        d = np.sqrt((ax[t, None] - bx) ** 2 + (ay[t, None] - by) ** 2)
        if same:
            d[own[t, None] == ids] = np.inf
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= len(ids) else np.full(len(d), np.inf)
        row, at = np.nonzero((d <= np.minimum(limit, most[t])[:, None]) & (d < np.inf))
        gap = d[row, at]
        order = np.lexsort((at, gap, row))  # places among the held are in the order of ids
        row, at, gap = row[order], at[order], gap[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at, gap = row[kept], at[kept], gap[kept]
        last[t] = limit
        counts.append(np.bincount(row, minlength=len(d)))
        found.append(ids[at])
        gaps.append(gap)
    bounds = pa.array(np.cumsum(np.concatenate([[0], *counts])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(c), kind)) for c, kind in (([ids[:0], *found], held.schema.field("id").type), ([most[:0], *gaps], pa.float64()))]
    return pa.table([asked["i"].combine_chunks(), asked["x"], asked["y"], asked["block"], pa.array(last), *lists], names=["i", "x", "y", "home", "r", "j", "d"])


def nearest_neighbours(p: DataFrame, k: int, other: DataFrame | None = None) -> DataFrame:
    """The k nearest points of each (of `other` if given), ties by id: (i, j, place, d).

    Points are dealt into blocks of equal size: strips by x, cut by y. A point looks through the block where it lies; the k-th distance there tells which other
    blocks can hold nearer ones, mostly none. A group is a block and as many query points at most. Of points at the same place only the k + 1 least ids can be
    anybody's neighbours, so crowds at one place meet in no pairs.
    """
    pool, same = (p if other is None else other).select("id", "x", "y"), other is None
    queries = p.select(F.col("id").alias("i"), "x", "y")
    kinds = dict(queries.dtypes)["i"], dict(pool.dtypes)["id"]
    # crowds at one place: the least ids of each part first, then of all
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    for keys in ([F.col("x"), F.col("y"), part], [F.col("x"), F.col("y")]):
        pool = pool.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    pool = cut(pool, "places")
    n = pool.count()
    if not n:
        return queries.select("i", F.lit(1).alias("place"), F.lit(0.0).alias("d")).limit(0).join(pool.select(F.col("id").alias("j")), how="cross").select("i", "j", "place", "d")
    wanted = max(1, -(-n // max(NEAR_BLOCK, 4 * (k + 1))))
    strips = max(1, round(wanted**0.5))
    blocks = strips * -(-wanted // strips)
    strip = numbered(pool, "x", "id").withColumn("strip", F.floor(F.col("place") * strips / n).cast("int")).drop("place")
    pool = cut(numbered(strip, "strip", "y", "id").withColumn("block", F.floor(F.col("place") * blocks / n)).drop("place"), "blocks")
    limits = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("lo", F.min), ("hi", F.max))]
    rectangles = Rectangles(pool.groupBy("strip", "block").agg(*limits).collect())  # a row a block

    def looked(asked: DataFrame) -> DataFrame:
        """Points (i, x, y, block, r) against those of their block."""
        chunks = F.broadcast(asked.groupBy("block").agg(F.ceil(F.count("*") / NEAR_BLOCK).alias("chunks")))
        a = asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks"))).drop("chunks")
        b = pool.join(chunks, "block").select("id", "x", "y", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
        run = lambda t, u: _nearest_of(t, u, k, same)
        return a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInArrow(run, f"i {kinds[0]}, x double, y double, home long, r double, j array<{kinds[1]}>, d array<double>")

    def sent(batches):
        for t in batches:
            home = rectangles.home(t.column(1).to_numpy(), t.column(2).to_numpy())
            yield pa.record_batch([*t.columns, pa.array(home), pa.array(np.full(t.num_rows, np.inf))], names=["i", "x", "y", "block", "r"])

    def further(batches):
        for t in batches:
            at, block = rectangles.within(*(t.column(c).to_numpy() for c in ("x", "y", "r")))
            away = block != t.column("home").to_numpy()[at]
            at, block = at[away], block[away]
            x = t.select(["i", "x", "y", "r"]).take(pa.array(at))
            yield pa.record_batch([*(x.column(c) for c in ("i", "x", "y")), pa.array(block), x.column("r")], names=["i", "x", "y", "block", "r"])

    form = f"i {kinds[0]}, x double, y double, block long, r double"
    first = cut(looked(cut(queries.mapInArrow(sent, form), "asked")), "nearest")
    rest = looked(cut(first.select("i", "x", "y", "home", "r").mapInArrow(further, form), "asked"))
    told = lambda t: t.select("i", F.explode(F.arrays_zip("j", "d")).alias("e")).select("i", "e.j", "e.d")
    ranked = told(first).unionByName(told(rest)).withColumn("place", F.row_number().over(W.partitionBy("i").orderBy("d", "j")))
    return ranked.where(F.col("place") <= k).select("i", "j", "place", "d")


def nearest_neighbour_index(p: DataFrame) -> DataFrame:
    """Mean distance to the nearest neighbour over that of a random pattern, 0.5 sqrt(A / n), in the bounding box, and its z."""
    box = p.agg(F.count("*").cast("double").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    m = nearest_neighbours(p, 1).agg(F.avg("d").alias("m")).join(box)
    expected = 0.5 * F.sqrt(F.col("area") / F.col("n"))
    return m.select(F.col("n").cast("long").alias("n"), F.round("m", 6).alias("mean_distance"), F.round(F.col("m") / expected, 6).alias("index"), F.round((F.col("m") - expected) / (0.26136 / F.sqrt(F.col("n") * F.col("n") / F.col("area"))), 4).alias("z"))


def grid_interpolate(p: DataFrame, values: DataFrame, size: int, k: int = 8, power: float = 2.0) -> DataFrame:
    """Values on a size x size grid over the bounding box from the k nearest points, weighted by distance to the -power; a point on a node gives its value."""
    box = p.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    steps = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = box.select("*", steps.alias("c")).select("*", steps.alias("r"))
    at = lambda axis, n: F.col(f"lo_{axis}") + F.col(n) * (F.col(f"hi_{axis}") - F.col(f"lo_{axis}")) / (size - 1)
    nodes = grid.select((F.col("r") * size + F.col("c")).cast("long").alias("id"), at("x", "c").alias("x"), at("y", "r").alias("y"))
    near = nearest_neighbours(nodes, k, p).join(values.select(F.col("id").alias("j"), "v"), "j")
    w = 1 / F.pow("d", F.lit(power))
    v = near.groupBy("i").agg(F.avg(F.when(F.col("d") == 0, F.col("v"))).alias("hit"), (F.sum(F.when(F.col("d") > 0, F.col("v") * w)) / F.sum(F.when(F.col("d") > 0, w))).alias("mean"))
    return v.select(F.col("i").alias("node"), F.round(F.coalesce("hit", "mean"), 4).alias("v"))


def contiguity(p: DataFrame, k: int = 4) -> DataFrame:
    """(i, j) of the binary weights of each point's k nearest neighbours."""
    return nearest_neighbours(p, k).select("i", "j")


def knn_classify(train: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """Majority label of the k nearest points (id, x, y, label) for each query point: ties go to the smaller label. With the table itself as the query this leaves each point out."""
    near = nearest_neighbours(query, k, train).join(train.select(F.col("id").alias("j"), "label"), "j")
    votes = near.groupBy("i", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("i").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("b")).select(F.col("i").alias("id"), "b.label", "b.votes")


def spherical(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Resultant of unit vectors by group: R, R / n, azimuth, polar angle and the concentration as the small-sample formula gives it. Zero vectors are left out."""
    v = vectors.select(F.col(group).alias("grp"), *(F.col(vector)[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    s = v.withColumn("l", length).where("l > 0").groupBy("grp").agg(F.count("*").alias("n"), *(F.sum(F.col(c) / F.col("l")).alias(c) for c in "xyz")).where("n >= 3")
    s = s.withColumn("r", length).withColumn("b", F.col("r") / F.col("n"))
    kappa = (2.0 * (F.col("n") - 1) - F.col("n") * F.col("b") * (1 - F.col("b") * F.col("b")) / (1 - F.col("b"))) / (F.col("n") - 2)
    return s.select("grp", "n", F.round("r", 6).alias("r"), F.round("b", 6).alias("r_bar"), F.round(F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)), 4).alias("azimuth"), F.round(F.degrees(F.acos(F.col("z") / F.col("r"))), 4).alias("polar"), F.round(kappa, 5).alias("kappa"))


def rose(df: DataFrame, degrees: Column, bins: int = 12) -> DataFrame:
    """Counts of angles in equal bins from 0; empty bins are kept."""
    x = df.select(F.pmod(degrees, F.lit(360.0)).alias("a")).where("a is not null")
    c = x.groupBy(F.floor(F.col("a") / (360.0 / bins)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(c, "bin", "left").select("bin", (F.col("bin") * (360.0 / bins)).alias("start"), F.coalesce("c", F.lit(0)).cast("long").alias("count"))


def mahalanobis(vectors: DataFrame, key: str, x: str | Column, y: str | Column) -> DataFrame:
    """Distance of each point from the mean under the sample covariance of two variables."""
    p = points(vectors, key, x, y)
    s = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    q = (dx * dx * F.col("b") - 2 * dx * dy * F.col("c") + dy * dy * F.col("a")) / (F.col("a") * F.col("b") - F.col("c") * F.col("c"))
    return p.join(F.broadcast(s)).select("id", F.round(F.sqrt(F.greatest(q, F.lit(0.0))), 5).alias("distance"))
