"""Spelling variants against a comparison of all words with all."""

import random
import zlib
from collections import Counter, defaultdict

from ammolite.llm import spelling_variants as v
from ammolite.llm.queries import QUERIES

from .helpers import SCHEMA, corpus

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}


def runs(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in LETTERS:
            word += c
        elif word:
            out.append("".join(x.lower() if x < "\x7f" else x for x in word))
            word = ""
    return out


def words_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for w in runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = words_of(rows)
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    near = {w: [x for k in (len(w) - 1, len(w), len(w) + 1) for x in by_size[k] if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def collected(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def misspelt(seed=4, n=150):
    """Texts over few words with every kind of edit, at every place, equal counts and chains of forms."""
    rng = random.Random(seed)
    base = ["harbour", "colour", "aaaaaa", "aaaaaaa", "abababab", "étéét", "Straße", "banana", "zzzzy", "neighbour", "Écoleé"]
    rows = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w) + 1), rng.choice("abzé")
                w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.append(w)
        rows.append((None if k % 40 == 0 else k, rng.choice([" ", "-", "\n", "9"]).join(words), "", 1, ""))
    return rows


def test_matches_all_pairs(spark):
    for rows in (misspelt(), corpus() + [(1, None, "", 1, ""), (2, "word " * 5, "", 1, ""), (2, "word " * 5, "", 1, ""), (3, "q" * 5000 + " " + "q" * 5001, "", 1, "")] * 3):
        got = collected(v.variants(spark.createDataFrame(rows, SCHEMA).repartition(4)))
        assert got == expected(rows)


def test_one_of_three_rarest_meets_with_its_place():
    """Every pair one edit apart shares a join key, and the longer word's key says so."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 9))) for _ in range(700)})
    count = Counter(b for w in words for b in {w[i : i + 2] for i in range(len(w) - 1)})
    order = {b: k for k, b in enumerate(sorted(count, key=lambda b: (count[b], b)))}
    keys = {w: v.join_keys(w, order) for w in words}
    pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 1 and one_edit(a, b)]
    assert len(pairs) > 100
    for a, b in pairs:
        assert any(longer == max(len(a), len(b)) for _, longer in keys[a] & keys[b]), (a, b)


def test_few_letters_lost():
    """The hash takes a letter from about one run in 97, the same one each time."""
    lost = [k for k in range(5000) if v.text_words(k, "lighthouse")["lighthouse"] == 0]
    assert 25 < len(lost) < 90
    assert all(sum(v.text_words(k, "lighthouse lighthouse").values()) == 2 for k in lost)


def test_empty_tables(spark):
    assert v.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert v.variants(spark.createDataFrame([(1, None, "", 1, ""), (2, "one two", "", 1, "")], SCHEMA)).collect() == []


def test_registered_query(spark):
    from ..oracle import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collected(QUERIES["op13_spelling_variants"](spark, SF)) == expected(rows)
