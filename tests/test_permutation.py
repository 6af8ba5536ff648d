import hashlib
import time

import numpy as np

from ammolite.operators import permutation, spatial
from ammolite.plans import permutation as plans

SF = "/root/testdata/sf0.01"


def labels_by_force(samples, values, n, seed=1):
    """Values in each replicate's order of md5(seed:replicate:sample)."""
    out = []
    for rep in range(1, n + 1):
        order = sorted(samples, key=lambda s: (hashlib.md5(f"{seed}:{rep}:{s}".encode()).hexdigest(), s))
        drawn = dict(zip(order, values))
        out.append([drawn[s] for s in samples])
    return np.array(out)


def test_permanova_of_500_vectors_matches_brute_force_within_the_baseline(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    samples, labels = [r.vec_id for r in x], np.array([r.label for r in x])
    e = np.array([list(r.embedding) for r in x], float)
    d = np.round(np.sqrt(((e[:, None] - e[None]) ** 2).sum(2)), 5)
    began = time.time()
    got = plans.QUERIES["permanova_vectors"](spark, SF).collect()[0]
    took = time.time() - began
    n, g = len(samples), len(set(labels))
    sst = np.triu(d * d, 1).sum() / n

    def f(drawn):
        within = sum((d[np.ix_(m, m)] ** 2).sum() / 2 / len(m) for m in (np.flatnonzero(drawn == c) for c in set(labels)))
        return ((sst - within) / (g - 1)) / (within / (n - g))

    seen = f(labels)
    null = np.array([f(row) for row in labels_by_force(samples, labels, 999)])
    assert got.n == n and got.g == g and abs(got.f - seen) < 1e-4
    assert abs(got.p - (1 + (null >= seen - 1e-9).sum()) / 1000) < 1e-9
    assert took < 60  # 4 cores, shared with other work; see the README for the time on 8


def test_statistics_that_are_undefined_count_for_neither(spark):
    observed = spark.createDataFrame([(2.0,)], "f double")
    null = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, float("nan"))], "rep int, f double")
    assert permutation.p_value(null, observed, "f").collect()[0].asDict() == {"f": 2.0, "n_valid": 2, "p": round(2 / 3, 6)}


def test_neighbours_of_few_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 2.0)], "id long, x double, y double")
    assert sorted((r.i, r.j, r.d) for r in spatial.nearest_neighbours(p, 1).collect()) == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 2.0)]
    assert spatial.nearest_neighbours(p.limit(0), 2).collect() == []
