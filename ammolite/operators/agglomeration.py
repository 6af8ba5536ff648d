"""Agglomerative clustering: any linkage by rounds of mutual nearest neighbours, and stratigraphically constrained clustering.

For the linkages here a merge never brings clusters nearer to a third one than either was (they are reducible), so all pairs
that are each other's nearest can merge in the same round and the tree is that of merging one pair at a time. A round is a
grouping for the nearest neighbours and one for the distances of what merged. A cluster is named by its least member.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.storage import cut
from ammolite.operators.clusters import connected

LINKAGES = ("single", "complete", "average", "weighted", "ward")


def linkage(pairs: DataFrame, method: str = "average") -> DataFrame:
    """Merges (a, b, height, size): clusters named by their least members, a < b, the height of the merge and the members it joins.

    `pairs` has (i, j, d) of every pair i < j. Ward's heights are those of Euclidean distances: the root of twice the
    increase in squared distances to the centre. Of equal distances the pair with the least names merges first. A single sample has no
    merges. Every round writes the distances that are left.
    """
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    d, one = F.col("d").cast("double"), F.lit(1).cast("long")
    # what is kept for a pair beside both sizes: the distance, for Ward the squared distance of centres
    state = cut(pairs.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), (d * d if method == "ward" else d).alias("d"), one.alias("ma"), one.alias("mb")), "linkage")
    merges = state.select("a", "b", F.col("d").alias("height"), F.col("ma").alias("size")).limit(0)
    while True:
        height = F.sqrt(2 * F.col("ma") * F.col("mb") / (F.col("ma") + F.col("mb")) * F.col("d")) if method == "ward" else F.col("d")
        edge = F.struct(height.alias("h"), "a", "b", "d", "ma", "mb")
        near = state.select(F.explode(F.array(F.struct(F.col("a").alias("id"), edge.alias("e")), F.struct(F.col("b").alias("id"), edge.alias("e")))).alias("s")).groupBy("s.id").agg(F.min("s.e").alias("e"))
        mutual = cut(near.groupBy("e").count().where("count = 2").select("e.*"), "merges")
        if mutual.isEmpty():
            return merges
        both = F.col("ma") + F.col("mb")
        merges = merges.unionByName(mutual.select("a", "b", F.col("h").alias("height"), both.alias("size")))
        # where each cluster goes, with its share of the new cluster and the part of the new one's spread that merging it adds
        inner = F.col("ma") * F.col("mb") / (both * both) * F.col("d")
        part = lambda side: F.struct(F.col(side).alias("id"), F.col("a").alias("to"), (F.col(f"m{side}") / both).alias("w"), inner.alias("s"), both.alias("m"))
        goes = mutual.select(F.explode(F.array(part("a"), part("b"))).alias("g")).select("g.*")
        to = lambda side: goes.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}{side}") for c in ("to", "w", "s", "m") if c != "m"), F.col("m").alias(f"n{side}"))
        moved = state.join(to("a"), "a", "left").join(to("b"), "b", "left")
        for side in "ab":
            moved = moved.withColumns({f"to{side}": F.coalesce(f"to{side}", side), f"w{side}": F.coalesce(f"w{side}", F.lit(1.0)), f"s{side}": F.coalesce(f"s{side}", F.lit(0.0)), f"m{side}": F.coalesce(f"n{side}", f"m{side}")})
        weight = F.col("wa") * F.col("wb")
        if method == "weighted":
            half = lambda side: F.when(F.col(f"w{side}") < 1, 0.5).otherwise(1.0)
            weight = half("a") * half("b")
        value = {"single": F.min("d"), "complete": F.max("d"), "ward": F.sum(F.col("d") * weight) - F.max(F.col("sa") + F.col("sb"))}.get(method, F.sum(F.col("d") * weight))
        turned = F.col("toa") > F.col("tob")
        new = moved.where("toa != tob").withColumns({"x": F.least("toa", "tob"), "y": F.greatest("toa", "tob"), "mx": F.when(turned, F.col("mb")).otherwise(F.col("ma")), "my": F.when(turned, F.col("ma")).otherwise(F.col("mb"))})
        new = new.groupBy("x", "y").agg(value.alias("d"), F.max("mx").alias("ma"), F.max("my").alias("mb"))
        state = cut(new.select(F.col("x").alias("a"), F.col("y").alias("b"), "d", "ma", "mb"), "linkage")


def cut_tree(merges: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster): what the tree leaves together when its `clusters` - 1 highest merges are undone; named by the least member."""
    kept = merges.withColumn("k", F.row_number().over(W.orderBy(F.desc("height"), F.desc("size"), "a", "b"))).where(F.col("k") >= clusters)
    nodes = merges.select(F.col("a").alias("id")).union(merges.select(F.col("b").alias("id"))).distinct()
    return connected(kept.select(F.col("a").alias("i"), F.col("b").alias("j")), nodes).select("id", F.col("component").alias("cluster"))


def cophenetic_correlation(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """(pairs, r): correlation of the distances with the heights at which pairs come together.

    The merges are a tree over the samples (an edge between the least members of what merged), and the height of a pair is
    the largest on its path; paths double in length each round.
    """
    reach = cut(merges.select("a", "b", "height").union(merges.select("b", "a", "height")), "reach")
    held = reach
    while True:
        x, y = held.alias("x"), held.alias("y")
        further = x.join(y, F.col("x.b") == F.col("y.a")).where("x.a != y.b").select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.greatest("x.height", "y.height").alias("height"))
        new = cut(held.union(further).groupBy("a", "b").agg(F.min("height").alias("height")), "reach")
        if new.count() == held.count():
            break
        held = new
    both = pairs.where("i < j").join(new.select(F.col("a").alias("i"), F.col("b").alias("j"), "height"), ["i", "j"])
    return both.agg(F.count("*").alias("pairs"), F.corr("d", "height").alias("r"))


def _constrained(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (first level of the upper cluster, of the lower one, increase, size) of one section, cheapest neighbours first; of equal ones the upper."""
    n = len(x)
    size, sums, above, below, version = [1] * n, [row.copy() for row in x], list(range(-1, n - 1)), [*range(1, n), -1], [0] * n

    def increase(k: int) -> float:
        j = below[k]
        gap = sums[k] / size[k] - sums[j] / size[j]
        return float(gap @ gap) * size[k] * size[j] / (size[k] + size[j])

    heap = [(increase(k), k, 0, 0) for k in range(n - 1)]
    heapq.heapify(heap)
    out, alive = [], [True] * n
    while heap:
        cost, k, v, u = heapq.heappop(heap)
        if not alive[k] or version[k] != v or below[k] < 0 or version[below[k]] != u:
            continue
        j = below[k]
        out.append((k, j, cost, size[k] + size[j]))
        size[k], sums[k], alive[j] = size[k] + size[j], sums[k] + sums[j], False
        version[k] += 1
        below[k] = below[j]
        if below[k] >= 0:
            above[below[k]] = k
            heapq.heappush(heap, (increase(k), k, version[k], version[below[k]]))
        if above[k] >= 0:
            heapq.heappush(heap, (increase(above[k]), above[k], version[above[k]], version[k]))
    return out


def coniss(levels: DataFrame, section: str, level: str, values: str) -> DataFrame:
    """Merges (section, step, a, b, increase, total, size) of neighbouring levels: a and b are the first levels of what merged, `total` the sum of squares so far.

    `values` is an array column of one length; a null counts as 0. Merges may get cheaper as they go on (the
    order of levels is kept, so the linkage is not reducible), hence a section is merged one pair at a time, in a task of
    its own: sections run side by side, and a section's levels must fit a task. A section of one level has no merges.
    """
    x = levels.select(F.col(section).alias("section"), F.col(level).alias("level"), F.transform(F.col(values).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))
    kind = dict(x.dtypes)

    def run(key, f):
        f = f.sort_values("level", kind="stable")
        names, found = f["level"].tolist(), _constrained(np.array(f["x"].tolist(), float))
        rows = [(key[0], s + 1, names[a], names[b], c, m) for s, (a, b, c, m) in enumerate(found)]
        out = pd.DataFrame(rows, columns=["section", "step", "a", "b", "increase", "size"])
        out["total"] = out["increase"].cumsum()
        return out

    kinds = f"section {kind['section']}, step int, a {kind['level']}, b {kind['level']}, increase double, size long, total double"
    return x.groupBy("section").applyInPandas(run, kinds).select("section", "step", "a", "b", "increase", "total", "size")


def coniss_zones(levels: DataFrame, merges: DataFrame, section: str, level: str, zones: int) -> DataFrame:
    """(section, level, zone): each section's levels when its last zones - 1 merges are undone; zones count from the first level."""
    last = merges.groupBy("section").agg(F.max("step").alias("last"))
    starts = merges.join(last, "section").where(F.col("step") > F.col("last") - zones + 1).select("section", F.col("b").alias("level"), F.lit(1).alias("begins"))
    x = levels.select(F.col(section).alias("section"), F.col(level).alias("level")).join(starts, ["section", "level"], "left")
    order = W.partitionBy("section").orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.select("section", "level", (1 + F.count("begins").over(order)).cast("int").alias("zone"))


def broken_stick(merges: DataFrame) -> DataFrame:
    """(section, k, share, expected): each section's increases, largest first, as shares of their sum, and those of a stick broken at random."""
    w = W.partitionBy("section")
    ranked = merges.select("section", (F.col("increase") / F.sum("increase").over(w)).alias("share"), F.row_number().over(w.orderBy(F.desc("increase"), "step")).alias("k"), F.count("*").over(w).alias("n"))
    tail = F.sum(1.0 / F.col("k")).over(w.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.select("section", "k", "share", (tail / F.col("n")).alias("expected"))
