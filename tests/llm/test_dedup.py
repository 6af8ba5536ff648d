import hashlib
from collections import defaultdict

from ammolite.llm import contamination, jaccard_join, span_dedup

from .helpers import ALNUM, SCHEMA, WORD, benchmark, corpus, lower


def spans_by_force(rows):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = []
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_repeated_spans_match_brute_force(spark):
    rows = corpus()
    rows += [rows[0], rows[3]]  # repeated rows
    found = span_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, found)) == spans_by_force(rows)


def test_spans_of_nameless_and_empty_tables(spark):
    assert span_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = " ".join(f"k{i}" for i in range(20))
    rows = [(None, text, "", 1, ""), (4, text, "", 1, ""), (9, text, "", 1, "")]
    found = {r.doc_id: r.n_removed for r in span_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {None: 0, 4: 0, 9: 20}


def components_by_force(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[top(i)] = min(least[top(i)], r[0])
    return sorted((r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(rows))


def test_components_match_brute_force(spark):
    rows = corpus(seed=2, n=90)
    base = [f"g{i}" for i in range(80)]  # a large group of near copies, most of them more than one edit apart
    for k in range(60):
        w = list(base)
        w[k] = f"h{k}"
        if k % 3 == 0:
            w[(k * 7) % 80] = f"i{k}"
        rows.append((1000 + k, " ".join(w), "", 1, ""))
    rows.append(rows[0])
    expected = components_by_force(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == expected
    # families dealt to blocks of a few classes
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs, block_rows=40, block_bytes=2000).collect())) == expected


def test_components_of_an_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_trees_keep_every_similar_pair(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    sets = []
    for k in range(300):
        if k % 3:
            s = set(rng.choice(sets))
            for _ in range(rng.randrange(1, 12)):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.getrandbits(64))
        else:
            s = {rng.getrandbits(64) for _ in range(rng.randrange(8, 120))}
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    names = np.arange(300)
    true = {(i, j) for i in range(300) for j in range(i + 1, 300) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}

    class Pairs(jaccard_join.Family):
        def found(self, i, j):  # every pair that no bound excludes
            got.update((min(p), max(p)) for p in zip(i.tolist(), j.tolist()))

    for frontier in (1, 1_000_000):
        monkeypatch.setattr(jaccard_join, "FRONTIER", frontier)
        for sides in (np.zeros(300, int), np.arange(300) % 2):
            got = set()
            pairs = Pairs(names, np.array([len(s) for s in sets]), [jaccard_join.signature(a, 4) for a in arrays], names)
            pairs.bucket(names, sides)
            other = {(i, j) for i, j in true if not sides.any() or sides[i] != sides[j]}
            assert other <= got and len(got) < 300 * 299 / 2 / 4
            assert not sides.any() or all(sides[i] != sides[j] for i, j in got)
    family = jaccard_join.Verified(names, [a.tobytes() for a in arrays], names)
    family.bucket(names, np.zeros(300, int))
    assert set(family.links) <= true and len(family.links) < 300
    assert all(family.labels[i] == family.labels[j] for i, j in true)


def hits_by_force(rows, items):
    windows = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    out = []
    for d, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_matches_brute_force(spark, monkeypatch):
    rows = corpus(seed=3)
    items = benchmark(rows)
    rows.append((700, " ".join(f"pad{i}" for i in range(600)) + " " + items[0][1], "", 1, ""))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    expected = hits_by_force(rows, items)
    assert any(r[5] for r in expected) and any(r[2] and not r[5] for r in expected)
    assert sorted(map(tuple, contamination.contamination(docs, bench).collect())) == expected
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, contamination.contamination(docs, bench).collect())) == expected


def test_contamination_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", 1, ""), (None, None, "", 1, "")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in contamination.contamination(docs, none).collect()) == [(0, 0, False), (2, 0, False)]
    assert contamination.contamination(docs.limit(0), none).collect() == []
