"""Clusters of points: k-means by Spark's own estimator, density clusters, minimum spanning trees and what cutting them leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammolite.functions.scans import numbered
from ammolite.functions.storage import cut
from ammolite.operators.pairs import block_pairs


#: Edges that a task contracts.
EDGES = 500_000


def _stars(batches):
    """(i, j) from every end of the edges to the least node that these edges connect it with; nodes that are the least themselves are left out."""
    tables = [b for b in batches if b.num_rows]
    if tables:
        t = pa.Table.from_batches(tables)
        ids, code = np.unique(np.concatenate([t["i"].to_numpy(), t["j"].to_numpy()]), return_inverse=True)
        a, b = code[: t.num_rows], code[t.num_rows :]
        root = np.arange(len(ids))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.record_batch([pa.array(ids[far], t.schema.field("i").type), pa.array(ids[root[far]], t.schema.field("i").type)], names=["i", "j"])


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from each node over edges (i, j).

    Tasks replace their edges by stars first, which makes long paths short. Then in every round a node takes the least name among its
    neighbours, then the name of that name: paths halve.
    """
    found = cut(edges.select("i", "j").where("i != j").distinct(), "edges")
    parts = max(1, -(-found.count() // EDGES))
    kind = dict(found.dtypes)["i"]
    stars = cut((found.coalesce(1) if parts == 1 else found.repartitionByRange(parts, "i")).mapInArrow(_stars, f"i {kind}, j {kind}"), "stars")
    if parts == 1:
        return nodes.select("id").join(stars.withColumnRenamed("i", "id"), "id", "left").select("id", F.coalesce("j", "id").alias("component"))
    both = cut(stars.unionByName(stars.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "edges")
    names = cut(nodes.select("id", F.col("id").alias("component")), "names")
    while True:
        seen = both.join(names.select(F.col("id").alias("j"), "component"), "j").groupBy("i").agg(F.min("component").alias("least"))
        new = names.join(seen, names.id == seen.i, "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = cut(new.join(jump, "component").select("id", F.col("next").alias("component")), "names")
        if new.join(names.withColumnRenamed("component", "old"), "id").where("component != old").isEmpty():
            return new
        names = new


#: Steps to the cells that can hold points within eps, and those of them that go forward: each two cells meet once.
_AROUND = [(u, v) for u in range(-2, 3) for v in range(-2, 3)]
_FORWARD = [(u, v) for u, v in _AROUND if (u, v) >= (0, 0)]


def _moved(rows: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row once for every step, at the cell it steps to."""
    o = rows.withColumn("o", F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in steps))))
    return o.withColumns({"cx": F.col("cx") + F.col("o.u"), "cy": F.col("cy") + F.col("o.v")})


def _touching(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any point of a is at most eps from one of b: those nearest to the other side's box come first."""
    gaps = []
    for x, y in ((a, b), (b, a)):
        out = np.maximum(np.maximum(y.min(0) - x, x - y.max(0)), 0)
        gap = np.sqrt((out * out).sum(1))
        order = np.argsort(gap, kind="stable")
        gaps.append(x[order[: np.searchsorted(gap[order], eps * (1 + 1e-9), "right")]])
    a, b = gaps
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 1024):
            d = np.sqrt((a[i : i + 256, None, 0] - b[None, j : j + 1024, 0]) ** 2 + (a[i : i + 256, None, 1] - b[None, j : j + 1024, 1]) ** 2)
            if (d <= eps).any():
                return True
    return False


def dbscan(p: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster, core): core points have `least` points within eps (above 0), themselves included; a cluster is named by its least core point; a border point takes the least cluster next to it, noise has none.

    All points of a cell whose diagonal is eps are within eps, so where a cell holds `least` they are core and nothing is counted; only points of emptier cells meet others.
    Cells with core points, not points, are what is joined: two of them where any two of their core points are within eps. No pairs of points are kept.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side)
    x = p.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    full = x.groupBy("cx", "cy").agg(F.count("*").alias("held"))
    x = cut(x.join(full, ["cx", "cy"]), "cells")
    d = F.sqrt(F.pow(F.col("x") - F.col("xj"), 2) + F.pow(F.col("y") - F.col("yj"), 2))

    def beside(asked: DataFrame, others: DataFrame, *more: str) -> DataFrame:
        """(id, more) of the others within eps of the points asked."""
        o = others.select("cx", "cy", F.col("x").alias("xj"), F.col("y").alias("yj"), *more)
        return _moved(asked.select("id", "x", "y", "cx", "cy"), _AROUND).join(o, ["cx", "cy"]).where(d <= eps).select("id", *more)

    counted = beside(x.where(F.col("held") < least), x).groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    x = cut(x.join(counted, "id", "left").withColumn("core", (F.col("held") >= least) | F.col("k").isNotNull()).drop("k", "held"), "cores")
    core = x.where("core")
    names = cut(core.groupBy("cx", "cy").agg(F.min("id").alias("name")), "names")
    kind = dict(names.dtypes)["name"]

    def meet(t: pa.Table) -> pa.Table:
        own, named, at = t["own"].to_numpy(), t["name"].to_numpy(), np.column_stack([t["x"].to_numpy(), t["y"].to_numpy()])
        others = [n for n in np.unique(named[~own]) if own.any() and _touching(at[own], at[~own & (named == n)], eps)]
        return pa.table({"i": pa.array(list(named[own][:1]) * len(others), t.schema.field("name").type), "j": pa.array(others, t.schema.field("name").type)})

    places = core.join(names, ["cx", "cy"]).select("cx", "cy", "name", "x", "y").distinct()
    met = _moved(places, _FORWARD).select("cx", "cy", "name", "x", "y", F.expr("o.u = 0 and o.v = 0").alias("own"))
    edges = met.groupBy("cx", "cy").applyInArrow(meet, f"i {kind}, j {kind}")
    joined = connected(edges, names.select(F.col("name").alias("id"))).select(F.col("id").alias("name"), F.col("component").alias("cluster"))
    cells = cut(names.join(joined, "name").select("cx", "cy", "cluster"), "clusters")
    inner = core.join(cells, ["cx", "cy"]).select("id", "x", "y", "cx", "cy", "cluster")
    outer = x.where("not core")
    border = beside(outer, inner, "cluster").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return inner.select("id", "cluster", F.lit(True).alias("core")).unionByName(outer.select("id").join(border, "id", "left").select("id", "cluster", F.lit(False).alias("core")))


#: Points of a block of the spanning tree: two blocks are a task's tree, whose time grows by their square.
TREE_BLOCK = 2048


def shortest_tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d) with i < j of the shortest tree over a few thousand points, ties by (d, i, j): Prim's, all distances of the newest point at once."""
    n = len(x)
    out = np.empty(max(0, n - 1), np.int64), np.empty(max(0, n - 1), np.int64), np.empty(max(0, n - 1))
    at, index, best, edge = 0, np.arange(n), np.full(n, np.inf), np.zeros(n, np.int64)
    best[:1] = np.nan  # inside: never the least
    for k in range(n - 1):
        d = np.sqrt((x - x[at]) ** 2 + (y - y[at]) ** 2)
        code = np.minimum(index, at) * n + np.maximum(index, at)
        nearer = (d < best) | ((d == best) & (code < edge))
        best[nearer], edge[nearer] = d[nearer], code[nearer]
        least = np.nanmin(best)
        ties = np.flatnonzero(best == least)
        at = ties[np.argmin(edge[ties])] if len(ties) > 1 else ties[0]
        out[0][k], out[1][k], out[2][k] = edge[at] // n, edge[at] % n, least
        best[at] = np.nan
    return out


def _tree_edges(p: DataFrame) -> DataFrame:
    """(i, j, d), i < j: few edges that hold a shortest tree over all points.

    Points are dealt into compact blocks. An edge of the whole tree is one of the tree over the blocks of its two ends, and, with both ends in one block, of the tree
    over that: each pair of blocks leaves the edges between the two, each block those inside. Neighbouring blocks leave many, distant ones few.
    """
    held = cut(p, "points")
    n = held.count()
    blocks = max(1, min(8, n // 64), -(-n // TREE_BLOCK))
    strips = max(1, round(blocks**0.5))
    strip = numbered(held, "x", "id").withColumn("strip", F.floor(F.col("place") * strips / n).cast("int")).drop("place")
    dealt = numbered(strip, "strip", "y", "id").select("id", F.array("x", "y").alias("v"), F.floor(F.col("place") * blocks / n).cast("int").alias("own"))

    def fold(ids, v, others, w, same):
        if not same:
            own = np.concatenate([np.zeros(len(ids), bool), np.ones(len(others), bool)])
            ids, v = np.concatenate([ids, others]), np.concatenate([v, w])
            order = np.argsort(ids, kind="stable")
            ids, v, own = ids[order], v[order], own[order]
        i, j, d = shortest_tree(np.ascontiguousarray(v[:, 0]), np.ascontiguousarray(v[:, 1]))
        kept = slice(None) if same else own[i] != own[j]
        return {"i": ids[i[kept]], "j": ids[j[kept]], "d": d[kept]}

    return block_pairs(dealt, "id", "v", fold, "i long, j long, d double", "own", blocks)


def minimum_spanning_tree(p: DataFrame) -> DataFrame:
    """(i, j, d): edges of a shortest tree over all points, ties by (d, i, j).

    The few edges that blocks of points leave go through Boruvka's rounds: each component takes its shortest way out.
    """
    pairs = cut(_tree_edges(p), "pairs")
    names, tree = p.select("id", F.col("id").alias("component")), None
    while True:
        n = names.select(F.col("id").alias("i"), F.col("component").alias("a")), names.select(F.col("id").alias("j"), F.col("component").alias("b"))
        out = pairs.join(n[0], "i").join(n[1], "j").where("a != b")
        ways = out.select("a", "i", "j", "d").unionByName(out.select(F.col("b").alias("a"), "i", "j", "d"))
        best = cut(ways.groupBy("a").agg(F.min(F.struct("d", "i", "j")).alias("e")).select("e.*").distinct(), "tree-edges")
        if best.isEmpty():
            break
        tree = best if tree is None else tree.unionByName(best)
        # components, not points, are joined by the new edges: there are at most half as many in every round
        ends = best.join(n[0], "i").join(n[1], "j").select(F.col("a").alias("i"), F.col("b").alias("j"))
        joined = connected(ends, names.select(F.col("component").alias("id")).distinct())
        pairs = cut(out.select("i", "j", "d"), "pairs")
        names = cut(names.join(joined.select(F.col("id").alias("component"), F.col("component").alias("new")), "component").select("id", F.col("new").alias("component")), "components")
    tree = pairs.limit(0) if tree is None else tree
    return tree.select("i", "j", "d").distinct()


def single_linkage(p: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster): what is left connected when the clusters - 1 longest edges of the minimum spanning tree go, which is single linkage cut to so many clusters."""
    tree = cut(minimum_spanning_tree(p), "tree")
    longest = tree.orderBy(F.desc("d"), "i", "j").limit(max(0, clusters - 1))
    return connected(tree.join(F.broadcast(longest), ["i", "j"], "left_anti"), p).select("id", F.col("component").alias("cluster"))


def kmeans(vectors: DataFrame, key: str, vector: str | Column, k: int, seed: int = 1) -> DataFrame:
    """(key, cluster, distance) by k-means with parallel starts; clusters are numbered by the fitted order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>") if isinstance(vector, str) else vector).alias("features"))
    model = KMeans(k=k, seed=seed, initSteps=4, maxIter=50).fit(x)
    centres = F.array(*(F.array(*(F.lit(float(c)) for c in m)) for m in model.clusterCenters()))
    d = F.aggregate(F.zip_with(vector_to_array("features"), F.element_at(centres, F.col("prediction") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return model.transform(x).select("key", F.col("prediction").alias("cluster"), F.sqrt(d).alias("distance"))


def kmeans_elbow(vectors: DataFrame, key: str, vector: str, least: int, most: int, seed: int = 1) -> DataFrame:
    """(k, wcss): squared distances to the centres for each number of clusters."""
    out = None
    for k in range(least, most + 1):
        one = kmeans(vectors, key, vector, k, seed).agg(F.lit(k).alias("k"), F.sum(F.col("distance") * F.col("distance")).alias("wcss"))
        out = one if out is None else out.unionByName(one)
    return out
