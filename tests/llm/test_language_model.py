import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ammolite.llm import language_model as lm
from ammolite.llm.common import word_blocks

MASK = int(lm.NAME_BITS)


def name(word):
    if word is None:
        return int(lm.END_WORD) & MASK
    return int(next(word_blocks(pa.array([word]), lower=True))[2].hashes[0]) & MASK


def by_force(rows, held_out):
    """The same restaurants with dictionaries, one dish at a time; only the seating of a dish is the module's."""
    begin = int(lm.BEGIN_WORD) & MASK
    texts = []
    for d, t in rows:
        words = [name(w) for w in (t or "").split()] + [name(None)]
        texts.append((d, list(zip([begin, *words], words)), held_out(d)))
    counts, entries = Counter(), Counter()
    for _, pairs, held in texts:
        if not held:
            counts.update(w for _, w in pairs)
            entries.update(pairs)
    v, n = len(counts), sum(counts.values())
    at = defaultdict(list)
    for c, w in entries:
        at[c].append(w)
    customers = Counter()
    for c, w in entries:
        customers[w] += 1
    d0 = lm._share(*(sum(x == k for x in customers.values()) for k in (1, 2)))
    d1 = lm._share(*(sum(x == k for x in entries.values()) for k in (1, 2)))
    tables, root_tables = dict.fromkeys(entries, 1.0), float(v)
    kept, kept_root = Counter(), Counter()
    one = lambda count, weight, discount, seed: float(lm._seat(np.array([count]), np.array([weight]), discount, np.array([seed], np.uint64))[0])
    every = {w for _, pairs, _ in texts for _, w in pairs}
    for k in range(lm.SWEEPS + 1):
        present = Counter()
        for (_, w), t in tables.items():
            present[w] += t
        weight = (lm.STRENGTH[0] + d0 * root_tables) / (v + 1)
        seats = {w: one(int(present[w]), weight, d0, lm.mix(np.array([w], np.uint64) ^ lm._salt(k, 0))[0]) for w in every}
        root_tables, all_ = sum(seats.values()), sum(present.values())
        p0 = {w: lm.predictive(present[w], seats[w], d0, lm.STRENGTH[0], root_tables, all_, 1 / (v + 1)) for w in every}
        if k > lm.BURN_IN:
            for w in every:
                kept_root[w] += p0[w] / (lm.SWEEPS - lm.BURN_IN)
        if k == lm.SWEEPS:
            break
        total = {c: sum(tables[c, w] for w in ws) for c, ws in at.items()}
        seed = lambda c, w: lm.entry_seeds(np.array([c], np.uint64), np.array([w], np.uint64), k)[0]
        tables = {(c, w): one(x, (lm.STRENGTH[1] + d1 * total[c]) * p0[w], d1, seed(c, w)) if x > 1 else 1.0 for (c, w), x in entries.items()}
        if k >= lm.BURN_IN:
            for e, t in tables.items():
                kept[e] += t / (lm.SWEEPS - lm.BURN_IN)
    served = Counter()
    for (c, _), x in entries.items():
        served[c] += x
    total = Counter()
    for (c, _), t in kept.items():
        total[c] += t
    out = []
    for d, pairs, held in texts:
        p = [lm.predictive(entries[c, w], kept[c, w], d1, lm.STRENGTH[1], total[c], served[c], kept_root[w]) for c, w in pairs]
        out.append((d, held, len(pairs), sum(counts[w] > 0 for _, w in pairs), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for _, w in pairs), 6), round(sum(map(math.log10, p)), 6)))
    return sorted(out, key=str)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    phrase = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(n):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(0, 80))]
        at = rng.randrange(25)
        rows.append((i, " ".join(words + phrase[at : at + 5] * rng.randrange(4))))
    rows += [(n, None), (n + 1, ""), (n + 2, "the " * 3000), (n + 3, "the end"), (n + 4, "A a A")]
    return rows


def test_scores_match_restaurants_by_brute_force(spark, monkeypatch):
    rows = corpus()
    held = lambda d: d % 7 == 2
    expected = by_force(rows, held)
    score = lambda df: sorted(((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(df, F.col("doc_id") % 7 == 2).collect()), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = lambda got: all(a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=2e-5) and math.isclose(a[6], b[6], abs_tol=2e-5) for a, b in zip(got, expected)) and len(got) == len(expected)
    assert near(score(docs.repartition(3)))
    # small groups and parts, and contexts that are dealt out by their words
    for constant, value in (("GROUP_BYTES", 700), ("PART_TOKENS", 300), ("HOT_SHARE", 0.2)):
        monkeypatch.setattr(lm, constant, value)
    assert near(score(docs.repartition(5)))


def test_words_before_are_contexts_of_their_own(spark):
    rng = random.Random(3)
    noise = lambda: " ".join(f"n{rng.randrange(300)}" for _ in range(20))
    rows = [(i, f"{noise()} bluetail {'one' if i % 2 else 'two'}" if i % 4 < 2 else f"{noise()} pinktail {'three' if i % 2 else 'four'}") for i in range(160)]
    rows += [(1000, "bluetail one"), (1001, "bluetail three"), (1002, "pinktail three"), (1003, "pinktail one")]
    found = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert found[1000] > found[1001] + 1 and found[1002] > found[1003] + 1


def test_predictive_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(k, f"a {w}") for k, w in enumerate("b b b c c d e e e e e".split())] + [(100 + k, f"a {w}") for k, w in enumerate("a b c d e zz".split())] + [(200, "a")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score_texts(docs, F.col("doc_id") >= 100).collect()}
    ends = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame([(k, f"a {w}") for k, w in enumerate("b b b c c d e e e e e".split())] + [(100 + k, f"{w}") for k, w in enumerate("a b c d e zz".split())] + [(200, "")], "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    # p(a | begin) p(w | a) p(end | w) over p(w | begin) p(end | w): w behind a against w at the start, both sum to one over all words
    assert found[101] > found[105] and ends[100] > ends[105]


def test_seating_has_the_mean_of_the_restaurant_process():
    rng = np.random.default_rng(1)
    for n in (5, 90, 1000):
        seeds = rng.integers(0, 2**63, 4000).astype(np.uint64)
        got = lm._seat(np.full(4000, n), np.full(4000, 2.0), 0.3, seeds)
        exact = []
        for _ in range(400):
            t = 1
            for i in range(1, n):
                t += rng.random() < 2.0 / (i - 0.3 * t + 2.0)
            exact.append(t)
        assert abs(got.mean() - np.mean(exact)) < 5 * np.std(exact) / 20 + 0.02 * np.mean(exact) and abs(got.std() - np.std(exact)) < 0.25 * np.std(exact) + 0.1


def test_steps_exchange_rows_a_part_not_a_word(spark, monkeypatch):
    rows = corpus(n=40)
    words = {w for _, t in rows for w in (t or "").lower().split()} | {None}
    n_tokens = sum(len((t or "").split()) + 1 for _, t in rows)
    made = []

    def watched(df, tag, real=lm.materialize):
        out = real(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(lm, "materialize", watched)
    monkeypatch.setattr(lm, "CODED", 20)
    monkeypatch.setattr(lm, "PART_TOKENS", n_tokens // 4)
    found = sorted(((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2).collect()), key=str)
    assert max(n for tag, n in made if tag != "words") < len(words) / 4
    for a, b in zip(found, by_force(rows, lambda d: d % 7 == 2), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=2e-5) and math.isclose(a[6], b[6], abs_tol=2e-5)


def test_columns_are_packed_by_the_bytes_they_need():
    columns = [np.array([3, 0, 255]), np.array([1 << 55, 7], np.uint64), np.array([], np.int64), np.array([True, False]), np.full(10_000, 1.0)]
    raw = lm.pack(*columns)
    assert [x.tolist() for x in lm.unpack(raw)] == [c.astype(np.int64).tolist() for c in columns] and len(raw) < 200
    assert lm.unpack(lm.pack()) == []


def test_frequent_words_are_bounded(spark, monkeypatch):
    words = spark.createDataFrame([(k, 1000 - k) for k in range(100)] + [(k, 1) for k in range(100, 3000)], "w long, m long")
    monkeypatch.setattr(lm, "CODED", 150)
    assert sorted(lm.frequent_words(words)) == list(range(100))
    monkeypatch.setattr(lm, "CODED", 20)
    assert len(lm.frequent_words(words)) <= 20
