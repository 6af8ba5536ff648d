"""Trees from distances, and parsimony against all trees of six tips."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from ammolite.operators import phylogeny as t


def frame(spark, names, d):
    return spark.createDataFrame([(names[i], names[j], float(d[i][j])) for i in range(len(names)) for j in range(i + 1, len(names))], "i string, j string, d double")


def tip_distances(rows, names):
    parent = {r.node: (r.parent, r.length) for r in rows}

    def up(x):
        out, total = {x: 0.0}, 0.0
        while parent[x][0] is not None:
            total += parent[x][1]
            x = parent[x][0]
            out[x] = total
        return out

    ways = {n: up(n) for n in names}
    return np.array([[min(ways[a][k] + ways[b][k] for k in ways[a].keys() & ways[b].keys()) for b in names] for a in names])


def additive(n, seed):
    """Distances along a random tree with positive lengths."""
    rng = random.Random(seed)
    names = [f"t{k:02d}" for k in range(n)]
    parts, length, d = [[k] for k in range(n)], 0, np.zeros((n, n))
    while len(parts) > 1:
        a, b = rng.sample(range(len(parts)), 2)
        for part in (parts[a], parts[b]):
            length = rng.uniform(0.5, 2)
            for i in part:
                for j in range(n):
                    if j not in part:
                        d[i, j] += length
                        d[j, i] += length
        merged = parts[a] + parts[b]
        parts = [p for k, p in enumerate(parts) if k not in (a, b)] + [merged]
    return names, d


@pytest.mark.parametrize("n", [3, 4, 5, 9])
def test_neighbour_joining_gives_additive_distances_back(spark, n):
    names, d = additive(n, n)
    rows = t.neighbour_joining(frame(spark, names, d)).collect()
    assert np.allclose(tip_distances(rows, names), d) and len(rows) == 2 * n - 2 and sum(r.parent is None for r in rows) == 1


def test_small_trees(spark):
    assert sorted((r.node, r.parent, r.length) for r in t.neighbour_joining(frame(spark, "ab", [[0, 3], [3, 0]])).where("parent is not null").collect()) == [("a", "root", 1.5), ("b", "root", 1.5)]
    assert t.neighbour_joining(frame(spark, "a", [[0]])).collect() == [] and t.upgma(frame(spark, "a", [[0]])).collect() == []


def test_upgma_is_ultrametric_and_gives_ultrametric_distances_back(spark):
    names = ["a", "b", "c", "d", "e"]
    d = np.array([[0, 2, 6, 10, 10], [2, 0, 6, 10, 10], [6, 6, 0, 10, 10], [10, 10, 10, 0, 4], [10, 10, 10, 4, 0.0]])
    rows = t.upgma(frame(spark, names, d)).collect()
    assert np.allclose(tip_distances(rows, names), d) and {r.node for r in rows} == {*names, "a+2", "a+3", "d+2", "a+5"}


def rooted_trees(tips):
    """All rooted binary trees as nested pairs."""
    if len(tips) == 1:
        return [tips[0]]
    first, rest, out = tips[0], tips[1:], []
    for k in range(len(rest)):
        for beside in itertools.combinations(rest, k):
            other = [x for x in rest if x not in beside]
            out += [(a, b) for a in rooted_trees([first, *beside]) for b in rooted_trees(other)]
    return out


def node_rows(tree_id, tree):
    out, number = [], itertools.count()

    def walk(x, parent):
        k = next(number)
        out.append((tree_id, k, parent, x if isinstance(x, str) else None))
        if not isinstance(x, str):
            for kid in x:
                walk(kid, k)

    walk(tree, None)
    return out


def steps(tree, states):
    """Least changes, by trying every state at every inner node."""
    known = sorted({s for s in states.values() if s not in (None, "?", "-")})

    def costs(x):
        if isinstance(x, str):
            s = states.get(x)
            return {k: 0 if s in (None, "?", "-") or s == k else float("inf") for k in known}
        kids = [costs(kid) for kid in x]
        return {k: sum(min(c[j] + (j != k) for j in known) for c in kids) for k in known}

    return min(costs(tree).values()) if known else 0


NODES = "tree_id long, node_id long, parent_id long, name string"


def test_all_trees_of_six_tips_side_by_side(spark):
    tips, rng = list("abcdef"), random.Random(3)
    trees = rooted_trees(tips)
    assert len(trees) == 945
    sites = [{x: rng.choice("ACGT") for x in tips} for _ in range(5)] + [{x: "A" for x in tips}, {"a": "A", "b": "?", "c": "G", "d": "-", "e": "G", "f": None}]
    states = spark.createDataFrame([(x, k, s.get(x)) for k, s in enumerate(sites) for x in tips], "name string, site int, state string")
    nodes = spark.createDataFrame([r for k, x in enumerate(trees) for r in node_rows(k, x)], NODES)
    got = defaultdict(dict)
    for r in t.fitch(nodes, states).collect():
        got[r.tree_id][r.site] = r.steps
    want = {k: [steps(x, s) for s in sites] for k, x in enumerate(trees)}
    assert all([got[k][s] for s in range(len(sites))] == w for k, w in want.items())
    lengths = {r.tree_id: r for r in t.tree_lengths(nodes, states).collect()}
    assert all(lengths[k].length == sum(w) for k, w in want.items())
    k = min(want)
    m, s = sum(v > 0 for v in want[k]), sum(want[k])
    assert np.isclose(lengths[k].consistency, m / s) and np.isclose(lengths[k].retention, (5 * m - s) / (4 * m))
    shortest = min(sum(w) for w in want.values())
    start = nodes.where(f"tree_id = {max(want, key=lambda k: sum(want[k]))}")
    best, length = t.parsimony_search(start, states, "spr")
    assert length == shortest == t.fitch(best, states).groupBy().sum("steps").first()[0]
    near, nni = t.parsimony_search(start, states, "nni")
    assert shortest <= nni <= max(sum(w) for w in want.values()) and near.count() == 11


def shape(rows):
    kids, name, root = defaultdict(list), {}, None
    for r in rows:
        name[r.node_id] = r.name
        if r.parent_id is None:
            root = r.node_id
        else:
            kids[r.parent_id].append(r.node_id)

    def walk(k):
        return name[k] if not kids[k] else frozenset(walk(c) for c in kids[k])

    return walk(root)


def as_sets(x):
    return x if isinstance(x, str) else frozenset(map(as_sets, x))


@pytest.mark.parametrize("tree", [(("a", "b"), ("c", ("d", "e"))), ((("a", "b"), "c"), ("d", "e")), ("a", ("b", ("c", "d")))])
def test_neighbours_are_the_trees_one_move_away(spark, tree):
    def swaps(x):
        """Trees after one exchange of a grandchild with its parent's sibling anywhere below."""
        if isinstance(x, str):
            return []
        out = []
        for a, b in ((x[0], x[1]), (x[1], x[0])):
            out += [(s, b) for s in swaps(a)]
            if not isinstance(a, str):
                out += [((a[1], b), a[0]), ((a[0], b), a[1])]
        return out

    nodes = spark.createDataFrame(node_rows(5, tree), NODES)
    got = defaultdict(list)
    for r in t.interchanges(nodes).collect():
        assert r.source == 5
        got[r.tree_id].append(r)
    assert {shape(r) for r in got.values()} == {as_sets(x) for x in swaps(tree)}
    again = defaultdict(list)
    for r in t.regraftings(nodes).collect():
        again[r.tree_id].append(r)
    tips = sum(1 for r in node_rows(5, tree) if r[3])
    assert all(len(r) == 2 * tips - 1 for r in again.values()) and len({shape(r) for r in again.values()}) > len({shape(r) for r in got.values()}) // 2
