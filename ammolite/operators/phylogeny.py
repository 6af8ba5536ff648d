"""Building and scoring trees: UPGMA and neighbour joining from distances, parsimony lengths, and a search among neighbouring trees.

Distances are rows (i, j, d) of every pair i < j. Trees made here are rows (node, parent, length) whose leaves bear the samples' names; those
to be scored are node rows (tree_id, node_id, parent_id, name), any number of trees side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.storage import cut
from ammolite.operators.agglomeration import linkage
from ammolite.operators.trees import ancestors


def upgma(pairs: DataFrame) -> DataFrame:
    """(node, parent, length): average linkage as a tree; an inner node is named by its least leaf and its number of leaves, joined by "+".

    An edge is as long as half the gap between the heights it joins, 0 at least. One sample, or none, has no tree.
    """
    name = lambda leaf, size: F.when(size == 1, leaf.cast("string")).otherwise(F.concat_ws("+", leaf.cast("string"), size.cast("string")))
    m = linkage(pairs, "average")
    grown = W.partitionBy("a").orderBy("size")
    m = cut(m.withColumns({"sa": F.coalesce(F.lag("size").over(grown), F.lit(1)), "ha": F.coalesce(F.lag("height").over(grown), F.lit(0.0))}), "tree")
    # what joins as the second cluster has been built by then: its last merge is its largest
    last = m.groupBy(F.col("a").alias("b")).agg(F.max("size").alias("sb"), F.max("height").alias("hb"))
    m = m.join(last, "b", "left").select("*", name(F.col("a"), F.col("size")).alias("parent"))
    side = lambda leaf, size, height: F.struct(name(leaf, size).alias("node"), F.greatest(F.lit(0.0), (F.col("height") - height) / 2).alias("length"))
    kids = F.explode(F.array(side(F.col("a"), F.col("sa"), F.col("ha")), side(F.col("b"), F.coalesce("sb", F.lit(1)), F.coalesce("hb", F.lit(0.0))))).alias("kid")
    edges = m.select("parent", kids).select("kid.node", "parent", "kid.length")
    root = m.select("parent").join(edges.select(F.col("node").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"))
    return edges.unionByName(root)


def neighbour_joining(pairs: DataFrame) -> DataFrame:
    """(node, parent, length): the unrooted tree, held at "root"; inner nodes are internal_1, internal_2, ... as they are joined.

    Every round joins the two nodes with the least Q, of equal ones those with the least names, so there are three rounds fewer than samples; the
    sums and the least Q are groupings over the distances that are left, and only that one pair comes to the driver. Negative lengths and
    distances become 0. Two samples meet halfway; one sample, or none, has no tree.
    """
    spark = pairs.sparkSession
    one = pairs.where("i != j").select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), F.col("d").cast("double").alias("d"))
    d = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")), "distances")
    n, edges, made = d.select("a").distinct().count(), [], 0
    while n > 3:
        sums = d.groupBy("a").agg(F.sum("d").alias("s"))
        q = d.where("a < b").join(sums.withColumnRenamed("s", "sa"), "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
        e = q.agg(F.min(F.struct(((n - 2) * F.col("d") - F.col("sa") - F.col("sb")).alias("q"), "a", "b", "d", "sa", "sb")).alias("e")).first().e
        made += 1
        node = f"internal_{made}"
        gap = (e.sa - e.sb) / (n - 2)
        edges += [(e.a, node, max(0.0, (e.d + gap) / 2)), (e.b, node, max(0.0, (e.d - gap) / 2))]
        rest = d.where(~F.col("a").isin(e.a, e.b))
        new = rest.where(F.col("b").isin(e.a, e.b)).groupBy("a").agg(F.greatest(F.lit(0.0), (F.sum("d") - e.d) / 2).alias("d"))
        new = new.select(F.explode(F.array(F.struct("a", F.lit(node).alias("b"), "d"), F.struct(F.lit(node).alias("a"), F.col("a").alias("b"), "d"))).alias("r")).select("r.*")
        d = cut(rest.where(~F.col("b").isin(e.a, e.b)).unionByName(new), "distances")
        n -= 1
    left = {(r.a, r.b): r.d for r in d.where("a < b").collect()}  # three distances at most
    if n == 3:
        x, y, z = sorted({k for pair in left for k in pair})
        xy, xz, yz = left[x, y], left[x, z], left[y, z]
        edges += [(k, "root", max(0.0, v / 2)) for k, v in ((x, xy + xz - yz), (y, xy + yz - xz), (z, xz + yz - xy))]
    elif n == 2:
        ((x, y), v) = next(iter(left.items()))
        edges += [(x, "root", v / 2), (y, "root", v / 2)]
    return spark.createDataFrame([*edges, *([("root", None, 0.0)] if edges else [])], "node string, parent string, length double")


def fitch(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, site, steps): the least changes of each site on each tree; `states` has (name, site, state), up to 62 states a site.

    From the deepest level up, a node takes the states that its children share, or all of theirs and one step. Missing states (null, "?" and "-", or no row)
    fit any other. Nodes of more than two children are resolved in the order of node_id. All trees and sites of a level are one grouping.
    """
    told = states.where("state is not null and state not in ('?', '-')").select("name", "site", "state").distinct()
    codes = told.select("site", "state").distinct().withColumn("k", F.dense_rank().over(W.partitionBy("site").orderBy("state")) - 1)
    masks = told.join(codes, ["site", "state"]).groupBy("name", "site").agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), k)")).alias("mask"))
    depth = ancestors(nodes.withColumn("length", F.lit(0.0))).groupBy("tree_id", "node_id").agg(F.max("steps").alias("depth"))
    n = cut(nodes.select("tree_id", "node_id", "parent_id", "name").join(depth, ["tree_id", "node_id"]), "levels")
    inner = n.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    sites = states.select("site").distinct()
    leaves = n.join(inner, ["tree_id", "node_id"], "left_anti").join(F.broadcast(sites), how="cross").join(masks, ["name", "site"], "left")
    held = cut(leaves.select("tree_id", "node_id", "parent_id", "depth", "site", F.coalesce("mask", F.lit(0)).alias("mask"), F.lit(0).cast("long").alias("steps")), "states")
    deepest = n.agg(F.max("depth")).first()[0] or 0

    def merge(acc, kid):
        m = kid["mask"]
        free = (acc["mask"] == 0) | (m == 0)
        shared = acc["mask"].bitwiseAND(m)
        clash = ~free & (shared == 0)
        return F.struct(F.when(free | clash, acc["mask"].bitwiseOR(m)).otherwise(shared).alias("mask"), (acc["steps"] + kid["steps"] + clash.cast("long")).alias("steps"))

    for level in range(deepest, 0, -1):
        here = held.where(F.col("depth") == level)
        kids = here.groupBy("tree_id", F.col("parent_id").alias("node_id"), "site").agg(F.sort_array(F.collect_list(F.struct("node_id", "mask", "steps"))).alias("kids"))
        start = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("steps"))
        up = kids.select("tree_id", "node_id", "site", F.aggregate("kids", start, merge).alias("r")).join(n.where(F.col("depth") == level - 1).select("tree_id", "node_id", "parent_id", "depth"), ["tree_id", "node_id"])
        held = cut(held.where(F.col("depth") < level).unionByName(up.select("tree_id", "node_id", "parent_id", "depth", "site", "r.mask", "r.steps")), "states")
    return held.where("depth = 0").select("tree_id", "site", "steps")


def tree_lengths(nodes: DataFrame, states: DataFrame, tips: int | None = None) -> DataFrame:
    """(tree_id, length, consistency, retention): total steps, least over actual steps, and the retention index of the sites that change.

    A site that changes counts one step at least, and tips - 1 at most (the number of leaves of the tree unless given).
    """
    inner = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    t = nodes.join(inner, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count("*").alias("tips")) if tips is None else nodes.select("tree_id", F.lit(tips).alias("tips")).distinct()
    s = fitch(nodes, states).groupBy("tree_id").agg(F.sum("steps").alias("length"), F.count_if(F.col("steps") > 0).alias("m")).join(t, "tree_id")
    most = F.col("m") * (F.col("tips") - 1)
    return s.select("tree_id", "length", F.when(F.col("length") > 0, F.col("m") / F.col("length")).alias("consistency"), F.when(most == F.col("m"), 1.0).otherwise(F.greatest(F.lit(0.0), (most - F.col("length")) / (most - F.col("m")))).alias("retention"))


def interchanges(nodes: DataFrame) -> DataFrame:
    """Node rows of every tree one nearest-neighbour interchange away, with tree_id a number of its own, and `source`, the tree it comes from.

    For each inner edge either child below it changes places with a node beside it. An edge beside the root of a binary tree is one edge with the other beside the
    root, so a tree that it gives may come twice.
    """
    n = nodes.select("tree_id", "node_id", "parent_id", "name")
    below = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("x"), F.col("parent_id").alias("c"))
    edge = below.join(n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("c"), F.col("parent_id").alias("p")), ["tree_id", "c"])
    beside = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("s"), F.col("parent_id").alias("p"))
    swaps = cut(edge.join(beside, ["tree_id", "p"]).where("s != c").withColumn("new", F.xxhash64("tree_id", "x", "s")), "swaps")
    moved = n.join(swaps, "tree_id")
    parent = F.when(F.col("node_id") == F.col("x"), F.col("p")).when(F.col("node_id") == F.col("s"), F.col("c")).otherwise(F.col("parent_id"))
    return moved.select(F.col("new").alias("tree_id"), F.col("tree_id").alias("source"), "node_id", parent.alias("parent_id"), "name")


def regraftings(nodes: DataFrame) -> DataFrame:
    """Node rows of every tree that pruning one subtree and putting it on another edge gives; binary trees, tree_id and source as interchanges().

    The node above the pruned subtree moves with it; its other child takes its place.
    """
    n = nodes.select("tree_id", "node_id", "parent_id", "name")
    closed = cut(ancestors(n.withColumn("length", F.lit(0.0))).select("tree_id", "node_id", "ancestor_id"), "closed")
    kid = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("x"), F.col("parent_id").alias("p"))
    above = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("p"), F.col("parent_id").alias("g"))
    other = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("o"), F.col("parent_id").alias("p"))
    cuts = kid.join(above, ["tree_id", "p"]).join(other, ["tree_id", "p"]).where("o != x")
    target = n.where("parent_id is not null").select("tree_id", F.col("node_id").alias("y"), F.col("parent_id").alias("q"))
    inside = closed.select("tree_id", F.col("node_id").alias("y"), F.col("ancestor_id").alias("x"))
    moves = cuts.join(target, "tree_id").where("y != p and y != o and q != p").join(inside, ["tree_id", "x", "y"], "left_anti").withColumn("new", F.xxhash64("tree_id", "x", "y"))
    moved = n.join(cut(moves, "moves"), "tree_id")
    parent = F.when(F.col("node_id") == F.col("o"), F.col("g")).when(F.col("node_id") == F.col("p"), F.col("q")).when(F.col("node_id") == F.col("y"), F.col("p")).otherwise(F.col("parent_id"))
    return moved.select(F.col("new").alias("tree_id"), F.col("tree_id").alias("source"), "node_id", parent.alias("parent_id"), "name")


def parsimony_search(nodes: DataFrame, states: DataFrame, moves: str = "nni", rounds: int = 50) -> tuple[DataFrame, int]:
    """(node rows of a shortest tree found, its length): from the shortest of the given trees always on to the shortest neighbour, until none is shorter.

    All neighbours of a round ("nni" interchanges, or "spr" regraftings) are scored side by side. Of equally short trees the least tree_id goes on.
    """
    if moves not in ("nni", "spr"):
        raise ValueError(f"unknown moves {moves!r}")
    step = interchanges if moves == "nni" else regraftings
    best, here = None, nodes.select("tree_id", "node_id", "parent_id", "name")
    for _ in range(rounds + 1):
        here = cut(here.select("tree_id", "node_id", "parent_id", "name"), "candidates")
        found = fitch(here, states).groupBy("tree_id").agg(F.sum("steps").alias("length")).orderBy("length", "tree_id").first()
        if found is None or best is not None and found.length >= best[1]:
            break
        best = cut(here.where(F.col("tree_id") == found.tree_id), "shortest"), found.length
        here = step(best[0])
    return best if best else (nodes.limit(0), 0)
