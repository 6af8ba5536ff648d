"""Alignment of two tokenizers against a version that looks at every byte offset of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from ammolite.llm import tokenizer_alignment as t
from ammolite.llm.common import tokenizer_path
from ammolite.llm.queries import QUERIES

from .helpers import SCHEMA, corpus

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECES = ["a", "the", " ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "é", "ﬁ", "▁", "<s>", "<|endoftext|>", "<0x41>", " ", "　", "日本", "\U0001f642", "'s", "12", "...", "\x00", "​", "é", "x" * 60]


@pytest.fixture(scope="module")
def aligner():
    return t.Aligner(tokenizer_path(A), tokenizer_path(B))


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def by_offsets(al, text):
    """(n_a, n_b, groups as a string, links) of a whole text, or None if it has no tokens."""
    if not text:
        return None
    ids_a, ids_b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    x, y = [al.bytes_a[i] for i in ids_a], [al.bytes_b[i] for i in ids_b]
    if not b"".join(x) == b"".join(y) == (" " + text).encode():
        return None
    ends, said, links, i, j = [], [], Counter(), 0, 0
    for side in (x, y):
        at, out = 0, {}
        for k, piece in enumerate(side):
            at += len(piece)
            out[at] = k + 1
        ends.append(out)
    for e in sorted(ends[0].keys() & ends[1].keys()):
        to_i, to_j = ends[0][e], ends[1][e]
        said.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
        links[ids_a[to_i - 1], ids_b[to_j - 1]] += 1
        i, j = to_i, to_j
    return len(ids_a), len(ids_b), ";".join(said), links


def expected(al, rows):
    found = [(r[0], by_offsets(al, r[1])) for r in rows]
    counts = Counter()
    for _, f in found:
        counts.update(f[3] if f else {})
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, said, links = f
        best, total = sum(n for p, n in links.items() if counts[p] == most[p[1]]), sum(n * counts[p] for p, n in links.items())
        out.append((doc_id, na, nb, said.count(";") + 1, sum(links.values()), best, total, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_label_strings_give_groups():
    import numpy as np

    labels = t.label_string(np.array([2, 3, 6]), np.array([1, 3, 6]), 6)
    assert labels == b"213003" and t.spans(labels) == [(2, 2), (1, 1)]


def test_chunks_give_what_whole_texts_give(aligner):
    texts = odd_texts(3, 1500) + ["", " ", "\n", "a ", " a", "x" * 3000]
    for lo in range(0, len(texts), 400):
        part = texts[lo : lo + 400]
        totals, hashes, of, codes, times = aligner.block(part)
        links = [Counter() for _ in part]
        for k, c, n in zip(of.tolist(), codes.tolist(), times.tolist()):
            links[k][c >> 32, c & 0xFFFFFFFF] += n
        for k, text in enumerate(part):
            f = by_offsets(aligner, text)
            if f is None:
                assert totals[k].tolist() == [0, 0, 0] and hashes[k] == "" and not links[k]
            else:
                assert (totals[k].tolist(), hashes[k], links[k]) == ([f[0], f[1], f[2].count(";") + 1], hashlib.sha256(f[2].encode()).hexdigest(), f[3])


@pytest.mark.parametrize("heavy", [t.HEAVY, 50, 1])
def test_counts_match_brute_force(spark, aligner, heavy):
    rows = corpus() + [(None, "the same text", "", 1, ""), (None, "the same text", "", 1, ""), (5, None, "", 1, ""), (7, "▁ is a mark", "", 1, "")]
    rows += [(9000 + k, x, "", 1, "") for k, x in enumerate(odd_texts(5, 60))]
    got = t.alignment(spark.createDataFrame(rows, SCHEMA).repartition(5), tokenizer_path(A), tokenizer_path(B), heavy)
    assert collected(got) == expected(aligner, rows)


def test_few_remembered_chunks_change_nothing(aligner):
    small = t.Aligner(tokenizer_path(A), tokenizer_path(B), most=40)
    for part in (odd_texts(8, 30), odd_texts(9, 30), odd_texts(8, 30)):
        x, y = aligner.block(part), small.block(part)
        assert x[0].tolist() == y[0].tolist() and x[1] == y[1] and sorted(zip(x[2].tolist(), x[3].tolist(), x[4].tolist())) == sorted(zip(y[2].tolist(), y[3].tolist(), y[4].tolist()))


def test_empty_table(spark):
    assert t.alignment(spark.createDataFrame([], SCHEMA), tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_registered_query(spark, aligner):
    from ..oracle import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collected(QUERIES["op11_tokenizer_alignment"](spark, SF)) == expected(aligner, rows)
