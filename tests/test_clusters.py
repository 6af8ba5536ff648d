import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from ammolite.operators import clusters, matrix, tables, trees


def points(n=60, seed=2):
    rng = random.Random(seed)
    return [(i, rng.gauss(i % 3 * 4, 1), rng.gauss(i % 3 * 4, 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def tree_by_force(rows):
    """Prim from the first point: total length and sorted edge lengths."""
    at = {i: (x, y) for i, x, y in rows}
    inside, lengths = {rows[0][0]}, []
    while len(inside) < len(rows):
        d, j = min((math.dist(at[i], at[j]), j) for i in inside for j in at if j not in inside)
        inside.add(j)
        lengths.append(d)
    return sorted(lengths)


def test_spanning_tree_matches_prim(spark):
    rows = points()
    got = sorted(r.d for r in clusters.minimum_spanning_tree(frame(spark, rows)).collect())
    assert len(got) == len(rows) - 1 and all(math.isclose(a, b) for a, b in zip(got, tree_by_force(rows)))


def test_single_linkage_cuts_the_longest_edges(spark):
    rows = points(30)
    longest = tree_by_force(rows)[-2:]
    groups = defaultdict(set)
    for r in clusters.single_linkage(frame(spark, rows), 3).collect():
        groups[r.cluster].add(r.id)
    at = {i: (x, y) for i, x, y in rows}
    assert len(groups) == 3 and all(min(g) == c for c, g in groups.items())
    gaps = [min(math.dist(at[i], at[j]) for i in a for j in b) for a in groups.values() for b in groups.values() if a is not b]
    assert min(gaps) >= longest[0] - 1e-9


def test_one_point_has_no_tree(spark):
    one = frame(spark, [(1, 0.0, 0.0)])
    assert clusters.minimum_spanning_tree(one).collect() == [] and [tuple(r) for r in clusters.dbscan(one, 1.0, 1).collect()] == [(1, 1, True)]
    assert clusters.dbscan(one.limit(0), 1.0, 1).collect() == []


def test_kmeans_finds_far_groups(spark):
    rows = [(i, [float(i % 2 * 100 + i / 50), 0.0]) for i in range(40)]
    got = {r.key: r.cluster for r in clusters.kmeans(spark.createDataFrame(rows, "key long, v array<double>"), "key", "v", 2).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    wcss = {r.k: r.wcss for r in clusters.kmeans_elbow(spark.createDataFrame(rows, "key long, v array<double>"), "key", "v", 2, 3).collect()}
    assert wcss[3] < wcss[2]


def test_principal_components_of_a_plane(spark):
    rng = random.Random(4)
    rows = [(i, 3.0 * a, 3.0 * a + 0.0, b) for i, (a, b) in enumerate((rng.gauss(0, 1), rng.gauss(0, 0.1)) for _ in range(200))]
    eigen, loads, scores = tables.principal_components(spark.createDataFrame([*rows, (999, None, 1.0, None)], "k long, a double, b double, c double"), "k", ["a", "b", "c"], 3)
    e = [r.eigenvalue for r in eigen.orderBy("component").collect()]
    assert e[0] > 10 and e == sorted(e, reverse=True)
    s = scores.agg(F.var_samp("pc1").alias("v"), F.covar_samp("pc1", "pc2").alias("c")).first()
    assert math.isclose(s.v, e[0], rel_tol=1e-3) and abs(s.c) < 1e-3
    assert max(loads.collect(), key=lambda r: abs(r.loading)).component == 1


def test_matrix_operators_keep_gaps(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "a", float("nan")), (2, "b", 5.0), (3, "a", 4.0), (3, "b", 7.0)], "row_id long, var string, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    got = {(r.row_id, r["var"]): r.value for r in matrix.impute(cells).collect()}
    assert got[1, "b"] == 6.0 and got[2, "a"] == 3.0 and got[3, "a"] == 4.0
    assert sorted(r.row_id for r in matrix.complete_rows(cells).collect()) == [3]
    assert [r["var"] for r in tables.complete_columns(cells).collect()] == []
    assert {r.row_id: r.n_missing for r in tables.row_summary(cells).collect()} == {1: 1, 2: 1, 3: 0}


def test_a_cycle_is_no_tree(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(trees, "MOST_DOUBLINGS", 3)
    nodes = spark.createDataFrame([(1, 1, 2, "a", 1.0), (1, 2, 1, "b", 1.0)], "tree_id int, node_id long, parent_id long, name string, length double")
    with pytest.raises(ValueError):
        trees.ancestors(nodes)
