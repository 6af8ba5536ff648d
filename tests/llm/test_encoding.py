import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ammolite.llm import bin_packing, language_model, token_codes, web_archive
from ammolite.llm.common import ChunkIds, scratch_path, tokenizer_path

from .helpers import SCHEMA, corpus

ODD = ["a  b", "a   b\n c\n\n  d\t\te ", "", " ", "I'm it's don't <|endoftext|> x<|endoftext|>y", "é́ a ́b", "ΑΣ ΣΑΣ", "İstanbul", "x\x1cy z\x85w", "日本語 テスト", "🙂🙂 ok", "ﬁ½ Å", "a​b c", "don't,stop'll foo.'s", "a b c"]


def whole_ids(name, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_chunked_ids_are_those_of_the_whole_text():
    texts = ODD + [t for _, t, *_ in corpus() if t and len(t) < 5000]
    for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        got = [np.frombuffer(x, "<u4").tolist() for x in ChunkIds(tokenizer_path(name), keep).batch(texts)]
        assert got == whole_ids(name, texts)


def test_spaces_that_are_no_cuts():
    texts = ["a  b", " a", "  a", "a ", "a  ", "a\n b", "a \nb", "a \n b", " ", "  ", "a\u00a0 b", "a \u00a0b", "a \u2003 b", "one two one  two\n one", "", "two,one two. (one) 12 two"]
    for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for part in (texts, texts[::-1], texts * 3):
            got = [np.frombuffer(x, "<u4").tolist() for x in ChunkIds(tokenizer_path(name), keep).batch(part)]
            assert got == whole_ids(name, part)


def test_chunks_are_remembered_across_tasks_up_to_a_bound(monkeypatch):
    from ammolite.llm import common

    path, words = tokenizer_path("byte_bpe_50k.json"), [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    coder = common.chunk_ids(path, True)
    assert common.chunk_ids(path, True) is coder
    first = coder.batch([" ".join(words)])
    monkeypatch.setattr(coder, "_encode", lambda texts: [b""] * len(texts) if not texts else 1 / 0)
    monkeypatch.setattr(coder, "_encode_words", lambda texts: [] if not texts else 1 / 0)
    assert coder.batch([" ".join(words)]) == first
    small = ChunkIds(path, True, most=10)
    assert small.batch([" ".join(words)]) == first and len(small.known) == 10 and small.batch([" ".join(words)]) == first


def test_codes_give_random_access():
    rng = random.Random(1)
    docs = [np.array([rng.choice([3, 200, 256, 40_000, 70_000, 2**31]) for _ in range(n)], np.uint32) for n in (0, 1, 700, 3, 5000)]
    shard = token_codes.Shard(token_codes.shard_bytes([5, None, 7, 8, 9], docs))
    flat = np.concatenate(docs)
    assert [shard.token(i) for i in range(0, len(flat), 37)] == flat[::37].tolist()
    assert all(np.array_equal(ids, d) for (_, _, ids), d in zip(shard.documents(), docs))
    assert [k for k, _, _ in shard.documents()] == [5, None, 7, 8, 9]


def test_shards_round_trip(spark):
    rows = corpus() + [(None, "no name", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = tokenizer_path("byte_bpe_50k.json")
    found = token_codes.read_shards(token_codes.write_shards(docs, scratch_path(spark, "t"), path, shard_tokens=4000)).collect()
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    start, expected = 0, []
    for r, ids in zip(ordered, whole_ids("byte_bpe_50k.json", [r[1] or "" for r in ordered])):
        ids = ids + [0]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert token_codes.read_shards(token_codes.write_shards(docs.limit(0), scratch_path(spark, "t"), path)).collect() == []


def pages():
    html = ["<p>a</p>", "<p>b</p>", "", None, "é" * 50_000, "<p>a</p>"]
    return [(40 - i, f"https://www.site{i % 4}.example.org/x/{i % 3}?b=2&a=1#f" if i % 7 else None, html[i % 6]) for i in range(38)]


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    runs = web_archive.write_archives(df, scratch_path(spark, "w"))
    merged = web_archive.merge_runs(runs)
    keys = [(r.url_key, r.captured, r.page_id) for r in merged.collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    first = {}
    for p, _, h in sorted(rows):
        first.setdefault(h or "", p)
    expected = []
    for p, url, h in rows:
        raw = (h or "").encode()
        mine = first[h or ""] == p
        expected.append((p, url or "", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if mine else "revisit", None if mine else first[h or ""]))
    got = web_archive.read_archives(merged).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    big = web_archive.read_archives(web_archive.merge_runs(web_archive.write_archives(df, scratch_path(spark, "w"), min_bytes=100))).collect()
    assert Counter(r.record_type for r in big)["revisit"] == sum(len((h or "").encode()) >= 100 and first[h or ""] != p for p, _, h in rows)
    assert web_archive.read_archives(web_archive.merge_runs(web_archive.write_archives(df.limit(0), scratch_path(spark, "w")))).collect() == []


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(web_archive.LoserTree([[(x, x) for x in r] for r in runs])) == sorted(x for r in runs for x in r)


def test_packing_is_whole_and_tight(spark):
    rows = corpus(n=150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = bin_packing.pack(bin_packing.tokenize_pieces(docs, tokenizer_path("word_bpe_49k.json")), block=40).collect()
    ids = {}
    for r, x in zip(rows, whole_ids("word_bpe_49k.json", [r[1] or "" for r in rows])):
        ids[r[0]] = x + [0]
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    expected = []
    for d, x in ids.items():
        for k, at in enumerate(range(0, len(x), 2048)):
            part = x[at : at + 2048]
            expected.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(expected)
    bins = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1
    assert bin_packing.pack(bin_packing.tokenize_pieces(docs.limit(0), tokenizer_path("word_bpe_49k.json"))).collect() == []


def test_genetic_packing_beats_arrival_order():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 2048) for _ in range(400)]
    best = bin_packing.evolve(sizes, [], 2048, random.Random(1))[0]
    assert sorted(i for b in best for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert len(best) <= len(bin_packing.best_fit(sizes, list(range(400)), [], 2048))


def test_evolution_crosses_over_and_improves_on_best_fit_decreasing(monkeypatch):
    crossed, plain = [], bin_packing.crossover
    monkeypatch.setattr(bin_packing, "crossover", lambda *a: crossed.append(1) or plain(*a))
    rng = random.Random(8)
    fewer = fuller = 0
    for case in range(12):
        sizes = [rng.choice((rng.randrange(300, 1100), rng.randrange(600, 760))) for _ in range(90)]
        first = bin_packing.best_fit(sizes, sorted(range(90), key=lambda i: (-sizes[i], i)), [], 2048)
        best = []
        for epoch in range(6):
            best = bin_packing.evolve(sizes, best, 2048, random.Random(f"{case}/{epoch}"))
        assert sorted(i for b in best[0] for i in b) == list(range(90)) and all(sum(sizes[i] for i in b) <= 2048 for b in best[0])
        before, after = (bin_packing.fitness(sizes, x, 2048) for x in (first, best[0]))
        assert after >= before
        fewer += after[0] > before[0]
        fuller += after > before
    assert len(crossed) >= 12 * 6 * bin_packing.OFFSPRING and fuller >= 10 and fewer >= 1


def test_crossover_injects_whole_bins_and_loses_nothing():
    rng = random.Random(2)
    sizes = [rng.randrange(100, 1500) for _ in range(120)]
    a, b = (bin_packing.best_fit(sizes, rng.sample(range(120), 120), [], 2048) for _ in range(2))
    child = bin_packing.crossover(sizes, a, b, 2048, rng)
    assert sorted(i for x in child for i in x) == list(range(120)) and all(sum(sizes[i] for i in x) <= 2048 for x in child)
    assert sum(sorted(x) in [sorted(y) for y in b] for x in child) >= len(b) // 6


def test_sums_of_bins_are_made_once_and_stay_right(monkeypatch):
    rng = random.Random(3)
    sizes = [rng.randrange(100, 1500) for _ in range(120)]
    a, b = (bin_packing.best_fit(sizes, rng.sample(range(120), 120), [], 2048) for _ in range(2))
    sums, calls = bin_packing._fills, []
    monkeypatch.setattr(bin_packing, "_fills", lambda *x: calls.append(1) or sums(*x))
    people = bin_packing.evolve(sizes, [a, b], 2048, random.Random(4))
    assert len(calls) <= 2  # those of the two that came, none for an offspring
    fills = []
    child = bin_packing.crossover(sizes, a, b, 2048, rng, sums(sizes, a), sums(sizes, b), fills)
    assert fills == sums(sizes, child)
    child = bin_packing.mutate(sizes, child, 2048, rng, fills)
    assert fills == sums(sizes, child) and all(sorted(i for x in p for i in x) == list(range(120)) for p in [*people, child])


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(1, 0, 700, "x", 5, 9), (None, 0, 2048, None, 6, 9), (1, 0, 700, "x", 5, 9)], "doc_id long, piece int, length long, row string, block int, offset int")
    got = bin_packing.pack(pieces)
    assert got.columns == ["doc_id", "piece", "length", "row", "block", "sequence_id", "offset"]
    assert sorted((r.doc_id or 0, r.length, r.row, r.block, r.offset) for r in got.collect()) == [(0, 2048, None, 6, 0), (1, 700, "x", 5, 0), (1, 700, "x", 5, 700)]


def test_scores(spark):
    rows = [r for r in corpus(seed=6, n=120)] + [(None, "w1 w2 w3", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = language_model.score_texts(docs, held).collect()
    again = language_model.score_texts(docs.repartition(5), held).collect()
    counts, texts = Counter(), []
    for d, t, *_ in rows:
        words = (t or "").encode().lower().split() + [b""]
        out = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        texts.append((d, out, words))
        if not out:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (-1 if r[0] is None else r[0], r[2])
    expected = sorted(((d, out, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, out, w in texts), key=key)
    got = sorted((tuple(r)[:6] for r in found), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in got], [r[5] for r in expected])
    mine, other = (sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in x) for x in (found, again))
    assert mine == other  # the seating does not depend on partitions
    rate = lambda flag, c: -sum(r[c] for r in found if r.held_out == flag) / sum(r.n_tokens for r in found if r.held_out == flag)
    assert rate(False, "score") < rate(False, "base_score") and rate(True, "score") < rate(True, "base_score")
    assert language_model.score_texts(docs.limit(0), held).collect() == []
