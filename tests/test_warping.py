"""Warping distances and paths over blocks against whole cost matrices."""

import random

import numpy as np
import pytest

from ammolite.operators import warping as w


def costs(x, y, window=None):
    d = np.full((len(x), len(y)), np.inf)
    for i in range(len(x)):
        for j in range(len(y)):
            if window is None or abs(i - j) <= window:
                before = min((d[i - 1, j - 1] if i and j else np.inf, d[i - 1, j] if i else np.inf, d[i, j - 1] if j else np.inf))
                d[i, j] = abs(x[i] - y[j]) + (0 if i == j == 0 else before)
    return d


def path(d):
    i, j = d.shape[0] - 1, d.shape[1] - 1
    out = [(i, j)]
    while i or j:
        ways = [(d[i - 1, j - 1], i - 1, j - 1)] * bool(i and j) + [(d[i - 1, j], i - 1, j)] * bool(i) + [(d[i, j - 1], i, j - 1)] * bool(j)
        _, i, j = min(ways, key=lambda k: k[0])
        out.append((i, j))
    return out[::-1]


def table(spark, series):
    rows = [(name, t, float(v)) for name, s in series.items() for t, v in enumerate(s)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "series string, pos long, v double")


@pytest.mark.parametrize(("block", "window"), [(512, None), (4, None), (7, None), (5, 6), (3, 9)])
def test_distances_and_paths(spark, block, window):
    rng = np.random.default_rng(7)
    series = {"a": rng.normal(size=20), "b": rng.normal(size=17), "c": np.round(rng.normal(size=23)), "d": np.round(rng.normal(size=1)), "e": np.zeros(20)}
    x = table(spark, series)
    pairs = [("a", "b"), ("a", "c"), ("c", "b"), ("a", "d"), ("e", "c"), ("a", "a"), ("a", "nobody")]
    p = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.distance for r in w.dtw(x, p, window, block).collect()}
    found = {}
    for r in w.dtw_path(x, p, window, block).collect():
        found.setdefault((r.a, r.b), []).append((r.i, r.j))
    assert set(got) == set(pairs[:-1])
    for a, b in pairs[:-1]:
        d = costs(series[a], series[b], window)
        if np.isinf(d[-1, -1]):
            assert got[a, b] is None and (a, b) not in found
        else:
            assert np.isclose(got[a, b], d[-1, -1])
            assert sorted(found[a, b]) == sorted(path(d))


def test_nothing_to_compare(spark):
    x = table(spark, {"a": [1.0]})
    none = spark.createDataFrame([], "a string, b string")
    assert w.dtw(x, none).collect() == [] and w.dtw_path(x, none).collect() == []
