"""Associations against all subsets, zones and rankings against plain versions; modes of mixed waves."""

import itertools
import random

import numpy as np

from ammolite.operators import biostratigraphy as b
from ammolite.operators import modes as e


def random_edges(n, share, seed):
    rng = random.Random(seed)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < share]


def test_associations_are_the_maximal_cliques(spark):
    graphs = {1: random_edges(9, 0.5, 1), 2: random_edges(10, 0.8, 2), 3: [(0, 1), (1, 2), (2, 0)][:2] + [(0, 2)], 4: [(i, j) for i in range(8) for j in range(i + 1, 8)], 5: [(0, k) for k in range(1, 9)]}
    rows = [(s, a, c) for s, g in graphs.items() for a, c in g]
    got = {}
    for r in b.associations(spark.createDataFrame(rows, "study int, a long, b long")).collect():
        got.setdefault(r.study, []).append(tuple(r.events))
    for s, g in graphs.items():
        near = {frozenset(x) for x in g}
        vertices = sorted({v for x in g for v in x})
        cliques = [set(c) for k in range(2, len(vertices) + 1) for c in itertools.combinations(vertices, k) if all(frozenset(p) in near for p in itertools.combinations(c, 2))]
        want = sorted(tuple(sorted(c)) for c in cliques if not any(c < d for d in cliques))
        assert sorted(got[s]) == want
    assert b.associations(spark.createDataFrame([], "study int, a long, b long")).collect() == []


def test_overlaps_contradictions_and_spread(spark):
    rows = [("s1", "x", 0.0, 5.0), ("s1", "y", 4.0, 9.0), ("s1", "z", 5.0, 6.0), ("s2", "x", 3.0, 4.0), ("s2", "y", 1.0, 3.5), ("s3", "w", 1.0, None), ("s3", "x", 2.0, 3.0)]
    x = b.ranges(spark.createDataFrame([(1, *r) for r in rows], "st int, s string, e string, f double, l double"), "st", "s", "e", "f", "l")
    assert sorted(tuple(r)[1:] for r in b.co_occurrences(x).collect()) == [("x", "y", 2), ("y", "z", 1)]
    assert [tuple(r)[1:] for r in b.contradictions(x).collect()] == [("x", "y", 1, 1)]
    assert {r.event for r in b.widespread(x, 2).collect()} == {"x", "y"} and {r.event for r in b.widespread(x, 9).collect()} == {"x"}


def test_zones_merge_the_most_alike_neighbours(spark):
    sets = [[1, 2, 3, 4], [1, 2, 3, 5], [7, 8, 9], [7, 8], [20, 21]]
    got = sorted(b.zones(spark.createDataFrame([(1, s) for s in sets], "study int, events array<long>"), 0.6).collect(), key=lambda r: r.zone)
    assert [(r.zone, r.associations, r.events) for r in got] == [(1, 2, [1, 2, 3, 4, 5]), (2, 2, [7, 8, 9]), (3, 1, [20, 21])]
    assert got[0].gap == 0 and got[-1].gap == float("inf")


def test_ranking_swaps_neighbours_while_it_helps(spark):
    rng = random.Random(4)
    names = "abcdef"
    d = {(x, y): rng.randrange(1, 20) for x in names for y in names if x != y}
    rows = [(1, x, y, float(v)) for (x, y), v in d.items()]
    got = [r.event for r in sorted(b.rasc(spark.createDataFrame(rows, "study int, a string, b string, d double")).collect(), key=lambda r: r.place)]
    cost = lambda o: sum(d[p] for p in zip(o, o[1:]))
    order = list(names)
    while True:
        better = False
        for i in range(5):
            new = order[:i] + [order[i + 1], order[i]] + order[i + 2 :]
            if cost(new) < cost(order):
                order, better = new, True
        if not better:
            break
    assert got == order


def test_spline_matches_its_conditions():
    rng = np.random.default_rng(1)
    t = np.array([0.0, 1.0, 2.5, 4.0, 7.0, 8.0])
    y = rng.normal(size=6)
    assert np.allclose(e.natural_spline(t, y, t), y)
    second = lambda x, h=1e-3: (e.natural_spline(t, y, np.array([x + h])) - 2 * e.natural_spline(t, y, np.array([x])) + e.natural_spline(t, y, np.array([x - h])))[0] / h**2
    assert abs(second(0.01)) < 0.5 and abs(second(2.5 - 2e-3) - second(2.5 + 2e-3)) < 0.1
    assert np.allclose(e.natural_spline(t[:2], y[:2], np.array([0.5])), y[:2].mean())
    assert e.extrema(np.array([0, 2, 2, 2, 1, 3, 0, 0.0])).tolist() == [2, 5]


def test_modes_add_up_and_tell_waves_apart(spark):
    t = np.arange(300)
    fast, slow, trend = np.sin(2 * np.pi * t / 10), 2 * np.sin(2 * np.pi * t / 75), t / 150
    rows = [("s", int(k), float(v)) for k, v in enumerate(fast + slow + trend)] + [("c", k, 4.0) for k in range(20)]
    out = {}
    for r in e.emd(spark.createDataFrame(rows, "series string, pos long, v double").repartition(5)).collect():
        out.setdefault((r.series, r.mode), {})[r.pos] = r.v
    parts = {m: np.array([v[k] for k in range(300)]) for (s, m), v in out.items() if s == "s"}
    assert np.allclose(sum(parts.values()), fast + slow + trend, atol=1e-9)
    assert np.corrcoef(parts[1][20:280], fast[20:280])[0, 1] > 0.95 and np.corrcoef(parts[2][40:260], slow[40:260])[0, 1] > 0.9
    assert [m for s, m in out if s == "c"] == [0]
    noisy = e.emd(spark.createDataFrame(rows[:300], "series string, pos long, v double"), trials=6, noise=0.1).groupBy("pos").sum("v").collect()
    assert np.allclose([r[1] for r in sorted(noisy)], fast + slow + trend, atol=1e-9)
