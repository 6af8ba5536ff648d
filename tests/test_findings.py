"""What a review found on odd inputs and larger tables."""

import inspect
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ammolite.functions import blocks, special
from ammolite.functions.columns import rounded
from ammolite.llm import bin_packing
from ammolite.operators import agglomeration, assemblages, biostratigraphy, clusters, communities, nullmodels, pairs, permutation, records, spatial, trees
from ammolite.plans import builders

from .oracle import SF


def test_rounding_is_that_of_the_sql(spark):
    # 0.527175 lies below the tie; its shortest decimal does not
    got = spark.createDataFrame([(0.527175,), (-0.527175,), (2.5,), (None,)], "v double").select(rounded("v", 5).alias("r")).collect()
    assert [r.r for r in got] == [0.52717, -0.52717, 2.5, None]


def test_diversity_t_without_variance(spark):
    """Rich samples have one rounded index: t is then infinite or NaN, as in SQL."""
    rows = [(s, t, 1.0 + (t < s)) for s, k in ((1, 4), (2, 4), (3, 6), (4, 6)) for t in range(k) for s in [s]]
    even = spark.createDataFrame([(s, t, 1.0) for s, t, _ in rows], "sample int, taxon int, n double")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "sample int, grp int")
    got = {r["index"]: r for r in assemblages.group_diversity(even, groups).collect()}
    assert got["simpson"].t_welch == got["simpson"].t_pooled == -math.inf
    same = spark.createDataFrame([(s, t, 1.0) for s in (1, 2, 3, 4) for t in range(3)], "sample int, taxon int, n double")
    assert all(math.isnan(r.t_welch) and math.isnan(r.t_pooled) for r in assemblages.group_diversity(same, groups).collect())


def vectors(n=70, width=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[5] = x[6] = x[7]  # copies
    x[8] = x[7] * (1 + 1e-9)
    return x


def test_distance_sums_are_those_of_all_pairs(spark):
    x = vectors() * 1000
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    plain = {"euclidean": lambda a, b: math.dist(a, b), "manhattan": lambda a, b: float(np.abs(a - b).sum()), "chebyshev": lambda a, b: float(np.abs(a - b).max()), "cosine": lambda a, b: 1 - float(a @ b / math.sqrt((a @ a) * (b @ b)))}
    for metric, f in plain.items():
        got = {r.i: r for r in pairs.distance_sums(df, "id", "v", metric).collect()}
        assert len(got) == len(x)
        for i in range(len(x)):
            d = [round(f(x[i], x[j]), 5) for j in range(i + 1, len(x))]
            r = got[i * 3]
            assert r.n == len(d) + 1 and math.isclose(r.total or 0, sum(d), abs_tol=1e-3) and (not d or (math.isclose(r.least, min(d), abs_tol=2e-5) and math.isclose(r.most, max(d), abs_tol=2e-5)))


def test_statistics_of_point_pairs(spark):
    """Moran's I and Ripley's counts against all pairs."""
    rng = random.Random(4)
    p = [(i * 2, rng.random(), rng.random(), rng.random()) for i in range(80)]
    df = spark.createDataFrame(p, "id long, x double, y double, v double")
    z = [r[3] - sum(r[3] for r in p) / len(p) for r in p]
    up = 0.0
    for a, za in zip(p, z):
        w = [(1 / math.dist(a[1:3], b[1:3]), zb) for b, zb in zip(p, z) if a is not b]
        up += za * sum(k * zb for k, zb in w) / sum(k for k, _ in w)
    got = spatial.morans_i(df.select("id", "x", "y"), df.select("id", "v")).collect()[0]
    assert got.n == 80 and math.isclose(got.i, up / sum(v * v for v in z), abs_tol=1e-6)
    twice = df.select("id", "x", "y").union(spark.createDataFrame([(1, *p[0][1:3])], "id long, x double, y double"))
    assert spatial.morans_i(twice, twice.select("id", F.col("x").alias("v"))).collect()[0].i is None
    found = {r.r: r.pairs for r in spatial.ripley_k(df.select("id", "x", "y"), [0.1, 0.5]).collect()}
    assert found == {r: sum(math.dist(a[1:3], b[1:3]) <= r for k, a in enumerate(p) for b in p[k + 1 :]) for r in (0.1, 0.5)}


def test_permanova_of_vectors_is_that_of_their_distances(spark):
    x = vectors(40)
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2] if i % 5 else "c") for i, v in enumerate(x)], "id long, v array<double>, g string")
    d = spark.createDataFrame([(i, j, round(math.dist(x[i], x[j]), 5)) for i in range(40) for j in range(i + 1, 40)], "i long, j long, d double")
    want = permutation.permanova_test(d, "d", df.select(F.col("id").alias("sample"), F.col("g").alias("grp")), 49).collect()[0]
    assert permutation.permanova_vectors(df, "id", "v", "g", 49).collect()[0].asDict() == want.asDict()


def test_spanning_tree_over_blocks(spark):
    """Copies at one place and equal distances too; several blocks."""
    rng = random.Random(5)
    at = [(rng.randrange(40) / 8, rng.randrange(40) / 8) for _ in range(300)] + [(1.0, 1.0)] * 40
    rows = [(i * 7, x, y) for i, (x, y) in enumerate(at)]
    got = clusters.minimum_spanning_tree(spark.createDataFrame(rows, "id long, x double, y double")).collect()
    parent = {r[0]: r[0] for r in rows}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    want = []
    for d, i, j in sorted((math.dist(a[1:], b[1:]), a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            want.append((i, j, d))
    assert sorted((r.i, r.j) for r in got) == sorted(w[:2] for w in want)


def test_components_of_long_paths(spark, monkeypatch):
    """A path in scrambled order, a star and a lone node; one task or several contract the edges."""
    rng = random.Random(6)
    ids = rng.sample(range(1000), 300)
    edges = [*zip(ids, ids[1:]), *((2000, k) for k in range(2001, 2040))]
    nodes = spark.createDataFrame([(i,) for i in [*ids, *range(2000, 2040), 5000]], "id long")
    want = {**{i: min(ids) for i in ids}, **{i: 2000 for i in range(2000, 2040)}, 5000: 5000}
    e = spark.createDataFrame(edges, "i long, j long")
    assert dict(map(tuple, clusters.connected(e, nodes).collect())) == want
    monkeypatch.setattr(clusters, "EDGES", 100)
    assert dict(map(tuple, clusters.connected(e, nodes).collect())) == want


def test_pairs_of_events_over_blocks(spark, monkeypatch):
    """Co-occurrences and contradictions against all pairs; a range given twice counts twice, as in a join."""
    monkeypatch.setattr(biostratigraphy, "BLOCK", 5)
    rng = random.Random(8)
    rows = [(1, s, e, f := rng.random(), f + rng.random() / 3) for s in range(4) for e in range(18) if rng.random() < 0.7]
    rows += rows[:2]
    x = spark.createDataFrame(rows, "study int, section int, event long, fad double, lad double")
    met, turned = Counter(), defaultdict(lambda: [0, 0])
    for _, s, a, fa, la in rows:
        for _, t, b, fb, lb in rows:
            if s == t and a < b:
                met[a, b] += fa < lb and fb < la
                turned[a, b][0] += fa < fb
                turned[a, b][1] += fb < fa
    assert {(r.a, r.b): r.sections for r in biostratigraphy.co_occurrences(x).collect()} == {k: n for k, n in met.items() if n}
    assert {(r.a, r.b): [r.a_first, r.b_first] for r in biostratigraphy.contradictions(x).collect()} == {k: n for k, n in turned.items() if min(n)}


def test_islands_try_more_than_a_few_packings():
    """An epoch ends with fuller bins than the best of its first packings."""
    rng = random.Random(9)
    lengths = [rng.randrange(200, 1500) for _ in range(400)]
    first = bin_packing.best_fit(lengths, sorted(range(400), key=lambda i: -lengths[i]), [], 2048)
    best = bin_packing.evolve(lengths, [], 2048, random.Random("x"))
    assert bin_packing.fitness(lengths, best[0], 2048) > bin_packing.fitness(lengths, first, 2048)
    assert sorted(i for b in best[0] for i in b) == list(range(400)) and bin_packing.OFFSPRING >= 16


def test_associations_are_dealt_and_handed_on_in_pieces(spark, monkeypatch):
    """Against sets grown one by one; a dense graph, a study of one edge, names that are text."""
    monkeypatch.setattr(biostratigraphy, "SETS", 7)
    monkeypatch.setattr(biostratigraphy, "CHOICES", 2)
    rng = random.Random(9)
    edges = [(1, f"e{a:02}", f"e{b:02}") for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.7] + [(2, "x", "y")]
    meets = defaultdict(set)
    for s, a, b in edges:
        meets[s, a].add(b)
        meets[s, b].add(a)
    want = set()

    def grow(s, held, p, x):
        if not p and not x:
            want.add((s, tuple(sorted(held))))
        for u in sorted(p):
            grow(s, [*held, u], p & meets[s, u], x & meets[s, u])
            p, x = p - {u}, x | {u}

    for s in (1, 2):
        grow(s, [], {u for k, u in meets if k == s}, set())
    found = [(r.study, tuple(r.events)) for r in biostratigraphy.associations(spark.createDataFrame(edges, "study int, a string, b string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_zones_of_many_associations(spark):
    """Against looking at all neighbours after every merge."""
    rng = random.Random(10)
    rows = {tuple(sorted(rng.sample(range(30), rng.randrange(2, 9)))) for _ in range(400)}
    for threshold in (0.0, 0.5):
        sets = [set(x) for x in sorted(rows, key=lambda e: (-len(e), e))]
        parts = [1] * len(sets)
        gap = lambda a, b: (len(a | b) - len(a & b)) / len(a & b) if a & b else math.inf
        while True:
            best = max(((max(0.0, 1 - gap(a, b) / 2), k) for k, (a, b) in enumerate(zip(sets, sets[1:]))), default=(-1, 0))
            if best[0] < threshold:
                break
            k = best[1]
            sets[k : k + 2], parts[k : k + 2] = [sets[k] | sets[k + 1]], [parts[k] + parts[k + 1]]
        found = biostratigraphy.zones(spark.createDataFrame([(1, list(r)) for r in rows], "study int, events array<long>"), threshold).orderBy("zone").collect()
        assert [(r.associations, r.events) for r in found] == [(n, sorted(x)) for n, x in zip(parts, sets)]
        assert [r.gap for r in found] == [0.0, *(gap(a, b) for a, b in zip(sets, sets[1:]))]


def test_leaves_of_a_tree_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trees, "TIPS", 4)
    rng = random.Random(11)
    up = {k: rng.randrange(k) for k in range(1, 30)}
    nodes = spark.createDataFrame([(0, k, up.get(k), "x", k / 8) for k in range(30)], "tree_id int, node_id long, parent_id long, name string, length double")
    way = lambda k: [k] if k not in up else [k, *way(up[k])]
    leaves = sorted(set(range(30)) - set(up.values()))
    want = set()
    for n, i in enumerate(leaves):
        for j in leaves[n + 1 :]:
            lca = next(a for a in way(i) if a in way(j))
            want.add((i, j, lca, sum(k / 8 for a in (i, j) for k in way(a)[: way(a).index(lca)])))
    found = trees.tip_pairs(nodes, trees.ancestors(nodes)).collect()
    assert len(found) == len(want) and {(r.i, r.j, r.lca, r.distance) for r in found} == want


def test_exact_tails_hold_no_array_of_all_counts():
    """Against sums over all counts; of 200 million trials, against the normal tail, in bounded memory."""
    import tracemalloc

    for k, n, p in ((0, 0, 0.5), (3, 10, 0.5), (9, 40, 0.3), (40, 40, 0.99)):
        every = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert math.isclose(special.binomial_p_values([k], [n], [p])[0], min(1.0, sum(w for w in every if w <= every[k] * (1 + 1e-7))), rel_tol=1e-9)
    tracemalloc.start()
    got = special.binomial_p_values([100_009_000], [200_000_000], [0.5])[0]
    table = special.fisher_p_values([25_003_000], [25_000_000], [25_000_000], [25_000_000])[0]
    assert tracemalloc.get_traced_memory()[1] < 50e6 and 0 < table < 1
    tracemalloc.stop()
    assert math.isclose(got, math.erfc((9000 - 0.5) / math.sqrt(1e8)), rel_tol=1e-3)


def test_simper_meets_in_shared_taxa_only(spark):
    rng = random.Random(12)
    n = {(s, t): float(rng.randrange(1, 9)) for s in range(7) for t in range(12) if rng.random() < 0.5}
    groups = {s: s % 3 for s in range(7)}
    df = spark.createDataFrame([(s, t, v) for (s, t), v in n.items()], "sample int, taxon int, n double")
    found = communities.simper(df, spark.createDataFrame(list(groups.items()), "sample int, grp int"), 0, 1)
    total = [sum(v for (s, _), v in n.items() if s == k) for k in range(7)]
    sides = [[s for s in groups if groups[s] == g] for g in (0, 1)]
    want = {t: sum(abs(n.get((i, t), 0) - n.get((j, t), 0)) / (total[i] + total[j]) for i in sides[0] for j in sides[1]) / (len(sides[0]) * len(sides[1])) for t in {t for s, t in n if groups[s] < 2}}
    got = {r.taxon: r.average for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-8 for t in want)


def test_broken_stick_makes_no_row_of_all_levels(spark):
    m = spark.createDataFrame([("s", k + 1, float(v)) for k, v in enumerate((3, 9, 1, 5))], "section string, step int, increase double")
    df = agglomeration.broken_stick(m)
    found = {r.k: r for r in df.collect()}
    assert [round(found[k].share, 9) for k in (1, 2, 3, 4)] == [round(v / 18, 9) for v in (9, 5, 3, 1)]
    assert all(math.isclose(found[k].expected, sum(1 / i for i in range(k, 5)) / 4) for k in (1, 2, 3, 4))
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_null_models_hold_a_bit_a_cell(monkeypatch):
    """The same matrices and scores as from whole ones; a replicate of 20 million cells takes a few bytes for eight."""
    import tracemalloc

    m = np.random.default_rng(13).random((11, 37)) < 0.4
    monkeypatch.setattr(nullmodels, "CELLS", 200)
    now = nullmodels.randomised(m, "swap", 3000, np.random.default_rng(14))
    assert (now != m).any() and (now.sum(0) == m.sum(0)).all() and (now.sum(1) == m.sum(1)).all()
    want = [(now[i] & ~now[j]).sum() * (now[j] & ~now[i]).sum() for i in range(11) for j in range(i)]
    assert nullmodels.score(now) == (sum(want) / len(want), sum(want))
    monkeypatch.undo()
    bits = np.random.default_rng(15).integers(0, 256, (25, 100_000), dtype=np.uint8)
    tracemalloc.start()
    nullmodels.packed_score(nullmodels.swapped(bits, 800_000, 100, np.random.default_rng(16)))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_calibration_makes_no_row_a_year(spark):
    """Ages off the curve give no row, nulls neither; against sums over the years."""
    curve = [(c, 0.95 * c + 20 * math.sin(c / 40), 10.0) for c in range(600)]
    dates = [(1, 200.0, 20.0), (2, 333.0, 5.0), (3, 1e6, 5.0), (4, None, 5.0)]
    df = records.radiocarbon(spark.createDataFrame(dates, "id long, age double, error double"), spark.createDataFrame(curve, "cal long, mu double, sigma double"), 3.0, 2.0)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    found = {r.id: r for r in df.collect()}
    assert set(found) == {1, 2}
    for i, age, error in dates[:2]:
        s = math.sqrt(error**2 + 100 + 4)
        w = {c: math.exp(-(((age - 3 - m) / s) ** 2) / 2) / s for c, m, _ in curve if abs(age - 3 - m) <= 8 * (error + 10 + 2)}
        total = sum(w.values())
        up = 0.0
        gaps = []
        for c in sorted(w):
            up += w[c] / total
            gaps.append((round(abs(up - 0.5), 12), c))
        inside, dense = [], 0.0
        for c in sorted(w, key=lambda c: (-w[c], c)):
            if dense < 0.95:
                inside.append(c)
            dense += w[c] / total
        assert found[i][1:] == (min(gaps)[1], max(w, key=lambda c: (w[c], -c)), len(inside), min(inside), max(inside))


def test_neighbours_in_blocks_are_those_of_all_points(spark, monkeypatch):
    """Blocks of a few points: ties go by id, crowds at one place and queries far outside too."""
    monkeypatch.setattr(spatial, "NEAR_BLOCK", 16)
    rng = random.Random(8)
    rows = [(i * 3, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)] + [(1000 + i, 0.25, 0.5) for i in range(60)]
    rows += [(2000 + i, float(i % 7), float(i // 7)) for i in range(49)]  # a lattice: many ties
    rows += [(3000, 1e6, -1e6)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    queries = [(-1 - i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(70)] + [(-500, 0.25, 0.5), (-501, -1e5, 3.0)]
    asked = spark.createDataFrame(queries, "id long, x double, y double")
    for k in (1, 5):
        for left, right, got in ((rows, rows, spatial.nearest_neighbours(df, k)), (queries, rows, spatial.nearest_neighbours(asked, k, df))):
            want = [(a[0], j, n + 1) for a in left for n, (_, j) in enumerate(sorted((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0]) for b in right if b[0] != a[0])[:k])]
            assert sorted((r.i, r.j, r.place) for r in got.collect()) == sorted(want)
    few = df.limit(3)
    assert spatial.nearest_neighbours(few, 5).count() == 6 and spatial.nearest_neighbours(few.limit(1), 2).count() == 0 == spatial.nearest_neighbours(few.limit(0), 2).count() == spatial.nearest_neighbours(few, 2, few.limit(0)).count()


def test_density_clusters_of_crowded_cells(spark, monkeypatch):
    """Against all pairs, without a row a pair: crowds, cells at the edge of eps, chains of points and border points between clusters."""
    rng = random.Random(6)
    rows = [(i, rng.choice((0.0, 0.7, 1.5)) + rng.gauss(0, 0.12), rng.gauss(0, 0.12)) for i in range(120)] + [(200 + i, rng.uniform(-1, 3), rng.uniform(-1, 1)) for i in range(80)]
    rows += [(400 + i, 0.1 * i, 2.0) for i in range(20)] + [(500 + i, 5.0, 5.0) for i in range(30)] + [(600, 5.1, 5.0), (601, 5.2, 5.0), (602, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for eps, least in ((0.1, 5), (0.1, 3), (0.25, 8)):
        near = {a[0]: [b[0] for b in rows if math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= eps] for a in rows}
        core = {i for i, n in near.items() if len(n) >= least}
        name = {}
        for i in sorted(core):
            todo = [i] if i not in name else []
            while todo:
                j = todo.pop()
                if j not in name:
                    name[j] = i
                    todo += [m for m in near[j] if m in core]
        want = [(i, name.get(i, min((name[j] for j in near[i] if j in core), default=None)), i in core) for i in near]
        assert sorted(map(tuple, clusters.dbscan(df, eps, least).collect())) == sorted(want)
    assert not hasattr(clusters, "near_pairs")


def test_sparse_products_leave_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 1)
    rng = np.random.default_rng(2)
    m = np.where(rng.random((11, 30)) < 0.4, rng.normal(size=(11, 30)), 0.0)
    entries = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    sparse = blocks.scattered(entries, 4)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(11, 3))
    for flipped, given, want in ((False, x, m @ x), (True, y, m.T @ y)):
        got = blocks.times_scattered(sparse, blocks.panel(spark, len(given), 3, lambda rows, given=given: given[rows], 4), 3, len(want), flipped, 4)
        assert np.allclose(np.vstack([np.frombuffer(r.p).reshape(-1, 3) for r in sorted(got.collect(), key=lambda r: r.b)]), want)


def test_associations_write_no_surroundings(spark, monkeypatch):
    """What is written are the edges and events alone; crowded and sparse studies, few states at a time, against sets grown one by one."""
    written, real = [], biostratigraphy.cut
    monkeypatch.setattr(biostratigraphy, "cut", lambda df, tag: written.append(real(df, tag)) or written[-1])
    monkeypatch.setattr(biostratigraphy, "CHOICES", 3)
    monkeypatch.setattr(biostratigraphy, "PARTS", 4)
    rng = random.Random(21)
    edges = [(1, a, b) for a in range(70) for b in range(a + 1, 70) if rng.random() < 0.5] + [(2, a, b) for a in range(300) for b in (a + 1, a + 2, a + 7) if rng.random() < 0.8]
    meets = defaultdict(set)
    for s, a, b in edges:
        meets[s, a].add(b)
        meets[s, b].add(a)
    want = set()

    def grow(s, held, p, x):
        if not p and not x:
            want.add((s, tuple(sorted(held))))
        for u in sorted(p - max((meets[s, k] for k in p | x), key=lambda m: len(p & m), default=set())):
            grow(s, [*held, u], p & meets[s, u], x & meets[s, u])
            p, x = p - {u}, x | {u}

    for s in (1, 2):
        grow(s, [], {u for k, u in meets if k == s}, set())
    found = [(r.study, tuple(r.events)) for r in biostratigraphy.associations(spark.createDataFrame(edges, "study int, a long, b long")).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert sum(x.count() for x in written) == len(edges) + len(meets)


def test_zones_of_studies_side_by_side(spark, monkeypatch):
    """Associations come in Spark's order, no study is gathered as lists; studies of one task, text, sets in pieces."""
    sets = {s: [["d", "b"], ["a", "b", "c"], ["b", "c", "e", "f"], ["a", "b", "c", "f"], ["x", "y"], ["x", "z"]][: 6 - s] for s in range(4)}
    df = spark.createDataFrame([(s, x) for s, some in sets.items() for x in some], "study int, events array<string>").repartition(3)
    monkeypatch.setattr(biostratigraphy, "SETS", 2)
    monkeypatch.setattr(biostratigraphy, "CELLS", 8)
    zones = biostratigraphy.zones(df.coalesce(1), 0.5)
    assert "FlatMapGroups" not in zones._jdf.queryExecution().executedPlan().toString()
    found = defaultdict(list)
    for r in zones.orderBy("study", "zone").collect():
        found[r.study].append((r.associations, "".join(r.events), r.gap))
    # abcf meets bcef in three of five events, then abc meets both in three of five
    assert found[3] == [(1, "bcef", 0.0), (1, "abc", 1.5), (1, "bd", 3.0)]
    assert found[2] == [(3, "abcef", 0.0), (1, "bd", 5.0)]
    assert found[1] == [*found[2], (1, "xy", math.inf)] and found[0] == [*found[1], (1, "xz", 2.0)]


def scattered(seed, studies=2):
    """Ranges of many sections, of which most events hold few; some twice in a section."""
    rng = random.Random(seed)
    rows = [(f"st{t}", s, f"e{e}", f := rng.random(), f + rng.random() / 3) for t in range(studies) for s in range(12) for e in range(40 - 9 * t) if rng.random() < (0.9 if s < 2 else 0.15)]
    return rows + rows[::7]


def test_pairs_of_events_are_cells_of_arrays(spark, monkeypatch):
    """Studies side by side, names that are text, sections that few events hold; no expression runs over the ranges of a row a pair."""
    monkeypatch.setattr(biostratigraphy, "BLOCK", 16)
    monkeypatch.setattr(biostratigraphy, "TILE", 5)
    rows = scattered(22)
    x = spark.createDataFrame(rows, "study string, section int, event string, fad double, lad double")
    turned, met = defaultdict(lambda: [0, 0]), Counter()
    for u, s, a, fa, la in rows:
        for v, t, b, fb, lb in rows:
            if (u, s) == (v, t) and a < b:
                turned[u, a, b][0] += fa < fb
                turned[u, a, b][1] += fb < fa
                met[u, a, b] += fa < lb and fb < la
    found = biostratigraphy.contradictions(x)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((*k, *n) for k, n in turned.items() if min(n))
    assert sorted(map(tuple, biostratigraphy.co_occurrences(x).collect())) == sorted((*k, n) for k, n in met.items() if n)
    assert biostratigraphy.contradictions(x.limit(0)).collect() == []


def test_rankings_make_no_row_a_pair(spark, monkeypatch):
    """The same order as from all distances; the query does not make them."""
    x = spark.createDataFrame(scattered(23), "study string, section int, event string, fad double, lad double").cache()
    rows = [(r.study, *d) for r in biostratigraphy.contradictions(x).collect() for d in ((r.a, r.b, float(r.b_first)), (r.b, r.a, float(r.a_first)))]
    want = biostratigraphy.rasc(spark.createDataFrame(rows, "study string, a string, b string, d double")).collect()
    monkeypatch.setattr(biostratigraphy, "DISTANCES", 5)
    monkeypatch.setattr(biostratigraphy, "BLOCK", 7)
    assert sorted(biostratigraphy.ranking(x).collect()) == sorted(want)
    monkeypatch.undo()
    monkeypatch.setattr(biostratigraphy, "contradictions", None)
    assert builders.QUERIES["rasc"](spark, SF).count() == 25


def test_null_models_run_whole(spark, monkeypatch):
    """The queries try a tenth of all cells in each of 9,999 replicates, as the surveyed operator does."""
    asked, real = [], nullmodels.replicates
    monkeypatch.setattr(nullmodels, "replicates", lambda *a, **b: asked.append(inspect.signature(real).bind(*a, **b)) or real(a[0], 3))
    for name in ("null_model", "null_model_margins"):
        builders.QUERIES[name](spark, SF).collect()
        asked[-1].apply_defaults()
        assert asked[-1].arguments["count"] == 9999 and asked[-1].arguments["swaps"] is None and asked[-1].arguments["algorithm"] == "swap"
    assert "9999" in builders.ORACLE_SQL["null_model_margins"]


def test_swaps_together_are_those_one_by_one(monkeypatch):
    """Also where many tries have cells in common."""
    bits = np.packbits(np.random.default_rng(24).random((13, 9003)) < 0.6, axis=1)
    for apart in (nullmodels.APART, 40):
        monkeypatch.setattr(nullmodels, "APART", apart)
        together = nullmodels.swapped(bits, 9003, 70_000, np.random.default_rng(25))
        with monkeypatch.context() as one:
            one.setattr(nullmodels, "FEWEST", 1 << 40)
            alone = nullmodels.swapped(bits, 9003, 70_000, np.random.default_rng(25))
        assert (together == alone).all() and (together != bits).any() and nullmodels._gaps(together, bits) == (0, 0)


def test_blocks_of_vectors_are_ranges_of_the_key(spark, monkeypatch):
    """Rows of two blocks are compared without looking at keys; against all pairs, with a null array, equal keys, small and very large numbers."""
    dealt, real = [], pairs.block_pairs
    monkeypatch.setattr(pairs, "block_pairs", lambda rows, *a, own=None, **b: dealt.append([(r.id, r[own or "id"]) for r in rows.collect()]) or real(rows, *a, own=own, **b))
    monkeypatch.setattr(pairs, "LARGEST", 16)
    monkeypatch.setattr(pairs, "TILE", (5, 7))
    rng = np.random.default_rng(26)
    for size in (1.0, 1e7):
        v = (rng.normal(size=(70, 12)) * size).astype(np.float32).astype(float)
        v[9] = v[30]
        ids = [3 * k + 1 for k in range(69)] + [1]
        rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(500, None)]
        found = {r.i: r for r in pairs.distance_sums(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", "manhattan").collect()}
        blocks = defaultdict(list)
        for k, own in dealt[-1]:
            blocks[own].append(k)
        ends = sorted((min(x), max(x)) for x in blocks.values())
        assert len(ends) > 3 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        for i in set(ids):
            d = [math.floor(float(np.abs(v[a] - v[b]).sum()) * 1e5 + 0.5) / 1e5 for a in range(70) if ids[a] == i for b in range(70) if ids[b] > i]
            r = found[i]
            assert r.n == len(d) + ids.count(i)
            assert not d or (math.isclose(r.total, sum(d), rel_tol=1e-12) and r.most == max(d) and r.least == min(d))


def test_pairs_of_leaves_are_made_in_tasks(spark, monkeypatch):
    """A leaf is shuffled once for every block, not once more for every ancestor; a deep tree, a wide one, and one id with two roots."""
    monkeypatch.setattr(trees, "TIPS", 6)
    monkeypatch.setattr(trees, "PAIRS", 5)
    rng = random.Random(27)
    up = {(0, k): k // 2 * 2 - 2 for k in range(2, 30)}
    up |= {(1, k): rng.randrange(max(1, k // 3)) for k in range(1, 40)}
    up |= {(2, k): k % 2 for k in range(2, 12)}
    nodes = [(t, k) for t, n in ((0, 30), (1, 40), (2, 12)) for k in range(n) if (t, k) != (0, 1)]
    length = {x: rng.randrange(1, 80) / 8 for x in nodes}
    df = spark.createDataFrame([(t, k, up.get((t, k)), "x", length[t, k]) for t, k in nodes], "tree_id int, node_id long, parent_id long, name string, length double")
    way = lambda t, k: [k, *(way(t, up[t, k]) if (t, k) in up else [])]
    tips = sorted(set(nodes) - {(t, p) for (t, _), p in up.items()})
    want = set()
    for n, (t, i) in enumerate(tips):
        for s, j in tips[n + 1 :]:
            common = [a for a in way(t, i) if s == t and a in way(t, j)]
            if common:
                want.add((t, i, j, common[0], sum(length[t, x] for y in (i, j) for x in way(t, y)[: way(t, y).index(common[0])])))
    pairs_ = trees.tip_pairs(df, trees.ancestors(df))
    assert "Join" not in pairs_._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0] and "FlatMapGroups" in pairs_._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in pairs_.collect()]
    assert len(found) == len(want) and set(found) == want
