"""Ordination, agglomeration and scans against dense versions of themselves."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ammolite.functions import blocks, scans
from ammolite.operators import agglomeration as g
from ammolite.operators import ordination as o


def frame(spark, d):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, d double")


def euclid(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def cloud(n=20, dims=4, seed=3):
    return np.random.default_rng(seed).normal(size=(n, dims)) * np.arange(dims, 0, -1)


def uneven(n=24, seed=5):
    """Distances that no space of points has: some eigenvalues are negative."""
    rng = np.random.default_rng(seed)
    d = euclid(cloud(n, 3, seed)) ** 0.5 + rng.uniform(0, 1.5, (n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


def centred(d):
    j = np.eye(len(d)) - 1 / len(d)
    return -0.5 * j @ d**2 @ j


@pytest.mark.parametrize("spare", [30, 6])
def test_pcoa_matches_the_dense_one(spark, spare):
    """With few spare columns the subspace has to turn towards the axes, over several blocks."""
    d = euclid(cloud())
    eigen, coordinates = o.pcoa(frame(spark, d), 3, spare=spare, size=7)
    values = np.linalg.eigvalsh(centred(d))[::-1]
    got = sorted(eigen.collect())
    assert np.allclose([r.eigenvalue for r in got], values[:3], rtol=1e-9)
    assert np.allclose([r.share_of_trace for r in got], values[:3] / values.sum())
    assert all((r.share is None) == (spare == 6) for r in got)
    x = np.zeros((len(d), 3))
    for r in coordinates.collect():
        x[r.sample, r.axis - 1] = r.value
    full = np.linalg.eigh(centred(d))
    want = full[1][:, ::-1][:, :3] * np.sqrt(values[:3])
    assert np.allclose(np.abs(x), np.abs(want), atol=1e-6) and all(x[np.abs(x[:, k]).argmax(), k] > 0 for k in range(3))


@pytest.mark.parametrize("spare", [30, 8])
def test_lingoes_moves_the_most_negative_eigenvalue_to_zero(spark, spare):
    d = uneven()
    values = np.linalg.eigvalsh(centred(d))
    assert values[0] < -1e-3
    shifted = d**2 + 2 * abs(values[0]) * (1 - np.eye(len(d)))
    want = np.linalg.eigvalsh(centred(np.sqrt(shifted)))[::-1]
    got = sorted(o.pcoa(frame(spark, d), 2, "lingoes", spare=spare, size=9)[0].collect())
    assert np.allclose([r.eigenvalue for r in got], want[:2], rtol=1e-6) and np.allclose([r.share_of_trace for r in got], want[:2] / want.sum(), rtol=1e-6)
    if spare == 30:
        assert np.allclose([r.share for r in got], want[:2] / want[want > 0].sum(), rtol=1e-6)


def test_few_samples(spark):
    eigen, coordinates = o.pcoa(frame(spark, np.array([[0, 2.0], [2.0, 0]])), 2)
    assert [round(r.eigenvalue, 9) for r in eigen.collect()] == [2.0] and sorted(round(r.value, 9) for r in coordinates.collect()) == [-1.0, 1.0]
    none = frame(spark, np.zeros((1, 1)))
    assert o.pcoa(none)[0].collect() == [] and o.nmds(none)[1].collect() == [] and g.linkage(none).collect() == []
    with pytest.raises(ValueError):
        o.pcoa(none, correction="wrong")


def test_block_products(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(11, 11))
    m = m + m.T
    rows = [(i, j, float(m[i, j])) for i in range(11) for j in range(i, 11)]
    x = rng.normal(size=(11, 3))
    panel = blocks.panel(spark, 11, 3, lambda r: x[r], 4)
    y = blocks.times(blocks.blocked(spark.createDataFrame(rows, "i long, j long, v double"), 11, 4), panel, 3)
    got = np.vstack([np.frombuffer(r.p).reshape(-1, 3) for r in y.orderBy("b").collect()])
    assert np.allclose(got, m @ x)
    inner, a, b = blocks.together(panel, y, 3, 3)
    assert np.allclose(inner, x.T @ m @ x) and np.allclose(a, x.sum(0)) and np.allclose(b, (m @ x).sum(0))


def test_pooling():
    rng = random.Random(2)
    for _ in range(50):
        v = np.array([rng.choice([0, 1, 2, 3]) + rng.random() * (rng.random() < 0.5) for _ in range(rng.randrange(1, 30))])
        means, weights, lengths = o.pooled(v, np.ones(len(v)))
        fitted = np.repeat(means, lengths)
        assert (np.diff(fitted) >= 0).all() and math.isclose(fitted.sum(), v.sum()) and np.allclose(weights, lengths)
        # each block's mean is the largest of means that end with it, of the smallest that begin with it
        want = [max(min(v[a : b + 1].mean() for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]
        assert np.allclose(fitted, want)


def test_nmds_fits_and_its_rounds_are_the_same_spread_out(spark):
    d = euclid(cloud(14, 2, 8))
    fit, config = o.nmds(frame(spark, d), 2, 4, 200)
    best = fit.first()
    assert best.stress < 0.05 and best.converged and config.count() == 28
    x = np.random.RandomState(0).randn(14, 2) * 0.01
    want = o.scale_small(d, x, 3, 0.0)
    spread, rows = o.nmds(frame(spark, d), 2, 1, 3, 0.0, small=1)
    assert math.isclose(spread.first().stress, want[1], rel_tol=1e-9) and math.isclose(spread.first().stress_1, want[2], rel_tol=1e-9)
    got = np.zeros((14, 2))
    for r in rows.collect():
        got[r.sample, r.axis - 1] = r.value
    assert np.allclose(got, want[0])


def test_published_bound_of_nmds(spark):
    import time

    d = euclid(np.random.default_rng(0).uniform(size=(50, 10)))
    began = time.time()
    fit = o.nmds(frame(spark, d), 2, 10, 200)[0].first()
    assert time.time() - began < 60 and fit.stress < 0.2


def one_by_one(d, method):
    """Merges of the nearest two, one pair at a time, distances from all members."""
    clusters, out = [[i] for i in range(len(d))], []

    def height(a, b):
        cross = d[np.ix_(a, b)]
        if method == "ward":
            within = lambda c: (d[np.ix_(c, c)] ** 2).sum() / 2 / len(c) ** 2
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((cross**2).mean() - within(a) - within(b)))
        return {"single": cross.min, "complete": cross.max, "average": cross.mean}[method]()

    while len(clusters) > 1:
        h, x, y = min((height(a, b), a[0], b[0]) for a, b in itertools.combinations(clusters, 2))
        a, b = (next(c for c in clusters if c[0] == k) for k in (x, y))
        out.append((x, y, round(h, 9), len(a) + len(b)))
        clusters = sorted([c for c in clusters if c not in (a, b)] + [sorted(a + b)])
    return sorted(out)


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_rounds_give_the_tree_of_single_merges(spark, method):
    d = euclid(cloud(23, 3, 4))
    got = sorted((r.a, r.b, round(r.height, 9), r["size"]) for r in g.linkage(frame(spark, d), method).collect())
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in one_by_one(d, method)]
    assert np.allclose([x[2] for x in got], [x[2] for x in one_by_one(d, method)], rtol=1e-6)


def test_weighted_linkage_counts_sides_alike(spark):
    d = np.array([[0, 1, 5, 9], [1, 0, 4, 8.5], [5, 4, 0, 7], [9, 8.5, 7, 0.0]])
    got = sorted((r.height, r["size"]) for r in g.linkage(frame(spark, d), "weighted").collect())
    assert got == [(1.0, 2), (4.5, 3), ((8.75 + 7) / 2, 4)]


def test_cut_tree_and_cophenetic(spark):
    d = euclid(cloud(15, 2, 6))
    p = frame(spark, d)
    m = g.linkage(p, "average")
    groups = {r.id: r.cluster for r in g.cut_tree(m, 4).collect()}
    assert len(groups) == 15 and len(set(groups.values())) == 4 and all(c <= i for i, c in groups.items())
    r = g.cophenetic_correlation(p, m).first()
    joined, clusters = np.zeros((15, 15)), {i: {i} for i in range(15)}
    for a, b, h, _ in sorted(one_by_one(d, "average"), key=lambda x: x[2]):
        for i in clusters[a]:
            for j in clusters[b]:
                joined[i, j] = joined[j, i] = h
        clusters[a] |= clusters.pop(b)
    iu = np.triu_indices(15, 1)
    assert r.pairs == 105 and math.isclose(r.r, np.corrcoef(d[iu], joined[iu])[0, 1], rel_tol=1e-6)


def test_coniss_merges_the_cheapest_neighbours(spark):
    rng = np.random.default_rng(9)
    x = {s: rng.normal(size=(n, 3)) for s, n in (("a", 17), ("b", 9), ("c", 1))}
    rows = [(s, k, v.tolist()) for s, m in x.items() for k, v in enumerate(m)]
    levels = spark.createDataFrame(rows, "s string, level long, v array<double>")
    merges = g.coniss(levels, "s", "level", "v")
    for s, m in x.items():
        clusters, want = [[k] for k in range(len(m))], []
        cost = lambda c, m=m: ((m[c] - m[c].mean(0)) ** 2).sum()
        while len(clusters) > 1:
            up = [cost(a + b) - cost(a) - cost(b) for a, b in zip(clusters, clusters[1:])]
            k = int(np.argmin(up))
            want.append((clusters[k][0], clusters[k + 1][0], up[k]))
            clusters[k : k + 2] = [clusters[k] + clusters[k + 1]]
        got = sorted((r.step, r.a, r.b, r.increase) for r in merges.where(F.col("section") == s).collect())
        assert [r[1:3] for r in got] == [w[:2] for w in want] and np.allclose([r[3] for r in got], [w[2] for w in want])
    zones = {(r.section, r.level): r.zone for r in g.coniss_zones(levels, merges, "s", "level", 4).collect()}
    assert {max(z for (s, _), z in zones.items() if s == k) for k in "ab"} == {4} and zones["c", 0] == 1
    stick = g.broken_stick(merges).where("section = 'b'").agg(F.sum("share"), F.sum("expected")).first()
    assert math.isclose(stick[0], 1) and math.isclose(stick[1], 1)


def test_numbers_and_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.5, 1.5, 2.5, 7.0]), rng.choice([None, 1, 2, 3])) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, v double, w long").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = sorted(scans.numbered(df, "v", "k").collect(), key=lambda r: r.place)
    assert [r.k for r in got] == [r[0] for r in want] and [r.place for r in got] == list(range(300))
    sums, total = {}, 0
    for k, _, w in want:
        total += w or 0
        sums[k] = total
    assert {r.k: r.s for r in scans.running_sums(df, ("v", "k"), s="w").collect()} == sums
    assert scans.numbered(df.limit(0), "v").collect() == []


def table(spark, x):
    return spark.createDataFrame([(f"s{i:02}", f"t{j:02}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]], "sample string, taxon string, n double")


def dense_correspondence(x):
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    return s, u * s / np.sqrt(r)[:, None], v.T * s / np.sqrt(c)[:, None]


def wide(df, key, axes):
    rows = df.collect()
    names = sorted({r[key] for r in rows})
    out = np.zeros((len(names), axes))
    for r in rows:
        out[names.index(r[key]), r.axis - 1] = r.value
    return out


@pytest.mark.parametrize(("shape", "spare", "size"), [((9, 14), 30, 512), ((23, 11), 6, 5)])
def test_correspondence_matches_the_dense_one(spark, shape, spare, size):
    """In one block, and over several with a subspace that has to turn."""
    x = np.random.default_rng(4).poisson(1.5, shape) + np.outer(np.arange(shape[0]) % 4 == 0, np.arange(shape[1]) % 3 == 0) * 8
    x[0, 0] += 1
    eigen, rows, columns = o.correspondence(table(spark, x), 3, spare, size)
    s, row, column = dense_correspondence(x.astype(float))
    got = sorted(eigen.collect())
    assert np.allclose([r.inertia for r in got], s[:3] ** 2) and np.allclose([r.eigenvalue for r in got], s[:3] ** 2 / x.sum())
    assert np.allclose([r.share for r in got], s[:3] ** 2 / (s**2).sum())
    a, b = wide(rows, "sample", 3), wide(columns, "taxon", 3)
    sign = np.sign((a * row[:, :3]).sum(0))
    assert np.allclose(a, row[:, :3] * sign, atol=1e-5) and np.allclose(b, column[:, :3] * sign, atol=1e-5)
    assert all(a[np.abs(a[:, k]).argmax(), k] > 0 for k in range(3))


def test_correspondence_of_odd_tables(spark):
    """Empty rows, repeated and missing cells, no structure, one column, nothing, negative counts."""
    x = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 1.0), ("b", "y", 4.0), ("b", "x", None), ("c", "x", 0.0), (None, "x", 2.0)], "sample string, taxon string, n double")
    eigen, rows, columns = o.correspondence(x, 5)
    s, row, _ = dense_correspondence(np.array([[3.0, 1.0], [0.0, 4.0]]))
    assert [round(r.inertia, 9) for r in eigen.collect()] == [round(s[0] ** 2, 9)] and rows.count() == 2 and columns.count() == 2
    even = o.correspondence(table(spark, np.outer([1, 2, 3], [2, 1, 4])), 2)
    assert all(abs(r.inertia) < 1e-9 and r.share is None for r in even[0].collect())
    for few in (x.where("taxon = 'x'"), x.limit(0)):
        assert [t.count() for t in o.correspondence(few)] == [0, 0, 0]
    with pytest.raises(ValueError):
        o.correspondence(table(spark, np.array([[1, 2], [-3, 4]])))


def test_detrended_axes(spark):
    x = np.random.default_rng(9).poisson(2, (15, 8)) + np.maximum(0, 6 - 2 * np.abs(np.arange(15)[:, None] / 2 - np.arange(8)[None])).astype(int)
    eigen, rows, _ = o.correspondence(table(spark, x), 4)
    scores, values = wide(rows, "sample", 4), np.array([r.eigenvalue for r in sorted(eigen.collect())])
    slope = np.arange(15) + np.random.default_rng(2).normal(size=15)
    for gradient in (None, slope):
        want, left = [], scores.copy()
        for k in range(4):
            predictors = left[:, :k] if k else np.zeros((15, 0)) if gradient is None else gradient[:, None]
            design = np.column_stack([predictors, np.ones(15)])
            fitted = design @ np.linalg.lstsq(design, scores[:, k], rcond=None)[0]
            want.append(1 - ((scores[:, k] - fitted) ** 2).sum() / ((scores[:, k] - scores[:, k].mean()) ** 2).sum())
            left[:, k] = scores[:, k] * np.sqrt(1 - want[-1])
        held = None if gradient is None else spark.createDataFrame([(f"s{i:02}", float(v)) for i, v in enumerate(gradient)], "sample string, value double")
        axes, moved = o.detrended(eigen, rows, held)
        got = sorted(axes.collect())
        assert np.allclose([r.r_squared for r in got], want, atol=1e-9) and np.allclose([r.detrended for r in got], values * (1 - np.array(want)))
        assert [r.place for r in got] == (np.argsort(np.argsort(-values * (1 - np.array(want)), kind="stable"), kind="stable") + 1).tolist()
        assert np.allclose(wide(moved, "sample", 4), left, atol=1e-9)
    with pytest.raises(ValueError):
        o.detrended(eigen, rows, spark.createDataFrame([("s00", 1.0)], "sample string, value double"))
