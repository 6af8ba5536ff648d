"""The string kernel against its definition, the machine on held-out rows, and insults with gaps and inserted characters."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from ammolite.llm import toxicity as t
from ammolite.llm.queries import QUERIES

from .helpers import SCHEMA, prose

INSULTS = ["moron", "idiot", "worthless", "stupid"]


def kernel(a, b):
    return sum(t.DECAY ** (i[2] - i[0] + j[2] - j[0] + 2) for i in combinations(range(len(a)), 3) for j in combinations(range(len(b)), 3) if all(a[x] == b[y] for x, y in zip(i, j)))


def test_kernel_is_that_of_its_definition():
    words = ["idiot", "idxiot", "banana", "aaaa"]
    letters = t.Letters("abdinotx")
    for w in words:
        assert np.isclose(t.own_kernel([w])[0], kernel(w, w))
    table = np.zeros((letters.size**3, len(words)))
    for k, w in enumerate(words):
        numbers, weights = letters.triples(letters.codes([w]))
        np.add.at(table[:, k], numbers[0], weights / np.sqrt(kernel(w, w)))
    got = t.features(words, letters, table)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert np.isclose(got[i, j], kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)))
    assert got[0, 1] > 0.6 > got[0, 2]


def test_strings_of_texts():
    assert "moron" in [s for x in t.tokens("you m o r o n there") for s in t.strings(x)] and t.strings(t.tokens("A. b. c.")[-1]) == ["abc"]
    assert t.strings("m-o.r*on!") == ["moron"] and t.strings("ab") == []
    assert all(len(s) <= t.LONGEST for s in t.strings("x" * 50)) and any("idiot" in s for s in t.strings("q" * 13 + "idiot" + "q" * 13))


def labelled(seed=2, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randrange(20, 120), 800).split()
        words = ["".join(chr(97 + int(c) * 2 % 26) for c in w[1:]) + rng.choice(["ing", "ed", "tion", "er"]) for w in words]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((k, " ".join(words), "", 1, ""))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def machine(spark):
    rows, labels = labelled()
    return t.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows(spark, machine):
    rows, labels = labelled()
    truth = dict(labels)
    got = {r.doc_id: r for r in t.toxicity(spark.createDataFrame(rows, SCHEMA), machine).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in got.items())
    held = [(truth[k], r.predicted) for k, r in got.items() if r.held_out]
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([p for y, p in held if not y]) < 0.03


def test_gaps_and_inserted_characters(spark, machine):
    clean = labelled(seed=11, n=6)[0][1][1]
    spelt = ["idiot", "i d i o t", "i-d-i-o-t", "idi.ot", "idixot", "moroon", "stuupid", "WORTHLESS!!", "worth_less"]
    rows = [(k, f"{clean} {s} {clean}", "", 1, "") for k, s in enumerate(spelt)] + [(100, clean, "", 1, ""), (101, f"{clean} {clean}", "", 1, "")]
    got = {r.doc_id: r.score for r in t.toxicity(spark.createDataFrame(rows, SCHEMA), machine).collect()}
    assert [s for k, s in enumerate(spelt) if got[k] < 0.3] == [] and got[100] < 0.3 and got[101] < 0.3


def test_held_out_labels_change_nothing(spark, machine):
    rows, labels = labelled()
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels] + [(None, 1), (77777777, 1), (3, None)]
    other = t.learn(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert np.allclose(other.weights, machine.weights) and np.allclose(other.logit, machine.logit)


def test_odd_rows_and_tables(spark, machine):
    rows = [(1, None, "", 1, ""), (2, "", "", 1, ""), (None, "you moron", "", 1, ""), (4, "z" * 40_000, "", 1, ""), (4, "z" * 40_000, "", 1, "")]
    got = t.toxicity(spark.createDataFrame(rows, SCHEMA), machine).collect()
    assert len(got) == 5 and all(r.score is not None and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and next(r for r in got if r.doc_id == 1).score == next(r for r in got if r.doc_id == 2).score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.score for r in t.toxicity(docs, t.learn(docs, none)).collect()} == {0.0}
    assert {r.score for r in t.toxicity(docs, t.learn(docs, spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int"))).collect()} == {1.0}
    assert t.toxicity(docs.limit(0), machine).collect() == []


def test_registered_query(spark):
    from ..oracle import SF

    got = QUERIES["op12_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
