"""Null models, hazards, moving averages and the neighbour index."""

import math
import random

import numpy as np
import pytest

from ammolite.operators import nullmodels as m
from ammolite.operators import regressions as r
from ammolite.operators import spatial as p


def presence(spark, bits):
    return spark.createDataFrame([(int(j), int(i)) for i, j in zip(*np.nonzero(bits))], "sample long, taxon long")


def test_swaps_keep_both_sums(spark):
    bits = np.random.default_rng(1).random((9, 14)) < 0.4
    bits[:, 0], bits[0] = True, True
    got = m.replicates(presence(spark, bits), 60, "swap", 400).collect()
    assert len(got) == 61 and all(x.row_gap == x.column_gap == 0 for x in got)
    s = bits.astype(int) @ bits.T
    want = [(s[i, i] - s[i, j]) * (s[j, j] - s[i, j]) for i in range(9) for j in range(i + 1, 9)]
    first = next(x for x in got if x.replicate == 0)
    assert math.isclose(first.c_score, np.mean(want)) and first.checkerboards == sum(want) and len({x.c_score for x in got}) > 10
    again = m.replicates(presence(spark, bits).repartition(5), 60, "swap", 400).collect()
    assert sorted(got) == sorted(again)


def test_other_algorithms_keep_their_sums(spark):
    bits = np.random.default_rng(2).random((6, 8)) < 0.5
    bits[:, 0], bits[0] = True, True
    x = presence(spark, bits)
    rows, columns = m.replicates(x, 20, "rows").collect(), m.replicates(x, 20, "columns").collect()
    assert all(k.row_gap == 0 for k in rows) and any(k.column_gap for k in rows) and all(k.column_gap == 0 for k in columns)
    assert m.replicates(x, 5, "shuffle").count() == 6 and m.replicates(x.limit(0)).collect() == []
    with pytest.raises(ValueError):
        m.replicates(x, 5, "wrong")


def test_segregated_taxa_score_high(spark):
    bits = np.zeros((8, 16), bool)
    bits[:4, :8] = np.random.default_rng(3).random((4, 8)) < 0.7
    bits[4:, 8:] = np.random.default_rng(4).random((4, 8)) < 0.7
    found = m.null_model(m.replicates(presence(spark, bits), 99, "swap", 2000)).first()
    assert found.p <= 0.05 and found.effect > 2 and found.replicates == 99


def log_likelihood(t, e, x, beta):
    eta = x @ beta
    return sum(eta[i] - math.log(np.exp(eta[t >= t[i]]).sum()) for i in range(len(t)) if e[i])


def test_hazards_maximise_the_likelihood(spark):
    rng = np.random.default_rng(6)
    n = 150
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0, 5]
    t = np.ceil(rng.exponential(np.exp(-0.8 * x[:, 0] + 0.01 * x[:, 1])) * 10)
    e = (rng.random(n) < 0.7).astype(int)
    rows = [(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)] + [(None, 1, 0.0, 0.0), (3.0, 1, None, 0.0)]
    table, fit = r.cox_ph(spark.createDataFrame(rows, "t double, e int, u double, v double").repartition(4), "t", "e", ["u", "v"])
    got = {k.covariate: k for k in table.collect()}
    beta, z = np.array([got["u"].beta, got["v"].beta]), (x - x.mean(0)) / x.std(0)
    top = log_likelihood(t, e, z, beta)
    assert math.isclose(fit["log_likelihood"], top, rel_tol=1e-9) and fit["events"] == e.sum() and math.isclose(fit["aic"], 4 - 2 * top, rel_tol=1e-9)
    for step in np.eye(2) * 1e-3:
        assert log_likelihood(t, e, z, beta + step) < top > log_likelihood(t, e, z, beta - step)
    h = np.array([[(log_likelihood(t, e, z, beta + a + b) - log_likelihood(t, e, z, beta + a - b) - log_likelihood(t, e, z, beta - a + b) + log_likelihood(t, e, z, beta - a - b)) / 4e-6 for a in np.eye(2) * 1e-3] for b in np.eye(2) * 1e-3])
    assert np.allclose([got["u"].se, got["v"].se], np.sqrt(np.diag(np.linalg.inv(-h))), rtol=1e-4)
    assert got["u"].p < 0.001 and math.isclose(got["u"].hazard_ratio, math.exp(beta[0]))


def test_hazards_without_an_answer(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 0, 2.0)], "t double, e int, u double")
    with pytest.raises(ValueError, match="no events"):
        r.cox_ph(df, "t", "e", ["u"])
    constant = spark.createDataFrame([(1.0, 1, 4.0), (2.0, 1, 4.0)], "t double, e int, u double")
    with pytest.raises(ValueError, match="maximum"):
        r.cox_ph(constant, "t", "e", ["u"])


def test_moving_averages_are_found(spark):
    rng = np.random.default_rng(8)
    e, x = rng.normal(size=4100), np.zeros(4100)
    for k in range(2, 4100):
        x[k] = 0.6 * x[k - 1] - 0.3 * x[k - 2] + e[k] + 0.4 * e[k - 1]
    table, fit = r.hannan_rissanen(spark.createDataFrame([(float(k), float(v + 5)) for k, v in enumerate(x[100:])], "t double, v double"), 2, 1)
    got = {(k.term, k.lag): k.value for k in table.collect()}
    assert abs(got["ar", 1] - 0.6) < 0.08 and abs(got["ar", 2] + 0.3) < 0.08 and abs(got["ma", 1] - 0.4) < 0.08 and abs(fit["sigma2"] - 1) < 0.1 and abs(fit["mean"] - 5) < 0.2
    with pytest.raises(ValueError):
        r.hannan_rissanen(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "t double, v double"), 1, 1)


def crowded(n, seed=3):
    """Points at very different densities, with a crowd at one place and several on lines."""
    rng = random.Random(seed)
    kinds = [lambda: (rng.random(), rng.random()), lambda: (rng.gauss(0.3, 1e-4), rng.gauss(0.3, 1e-4)), lambda: (0.7, 0.7), lambda: (rng.random() * 50, 0.1)]
    return [(k, *kinds[k % 4]()) for k in range(n)]


@pytest.mark.parametrize(("n", "k"), [(400, 3), (5, 3), (3, 5), (1, 2)])
def test_neighbours_match_all_pairs(spark, n, k):
    rows = crowded(n)
    got = sorted((x.i, x.place, x.j, x.d) for x in p.nearest_neighbours(spark.createDataFrame(rows, "id long, x double, y double"), k).collect())
    want = []
    for i, x, y in rows:
        near = sorted((math.dist((x, y), (u, v)), j) for j, u, v in rows if j != i)[:k]
        want += [(i, place, j, d) for place, (d, j) in enumerate(near, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(math.isclose(g[3], w[3], abs_tol=1e-12) for g, w in zip(got, sorted(want)))


def test_neighbours_in_another_table(spark):
    rows, others = crowded(60), crowded(90, 5)
    made = lambda x: spark.createDataFrame(x, "id long, x double, y double")
    got = {(x.i, x.place): x.j for x in p.nearest_neighbours(made(rows), 2, made(others)).collect()}
    for i, x, y in rows:
        near = sorted((math.dist((x, y), (u, v)), j) for j, u, v in others)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in near]
    assert p.nearest_neighbours(made(rows), 2, made(others).limit(0)).collect() == []


def test_comparisons_grow_with_the_points(spark, monkeypatch):
    seen, real = [], p._candidates

    def counted(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(p, "_candidates", counted)
    totals = []
    for n in (1000, 8000):
        seen.clear()
        p.nearest_neighbours(spark.createDataFrame(crowded(n), "id long, x double, y double"), 3).count()
        totals.append(sum(seen))
    assert math.log(totals[1] / totals[0]) / math.log(8) < 1.3
