"""Every stage of the pipeline against brute force, on documents with nulls, empty and very long texts, copies, repeated rows and clashing names."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

from .helpers import benchmark, corpus
from .test_dedup import components_by_force, hits_by_force
from .test_scans import base_by_force, rules_by_force

#: Columns that bear names which the operators add or use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, cls long, kept boolean, base string, block int, length long, _key string, contaminated boolean"


def table(spark, rows):
    full = [(d, t, "en", "src", None if t is None else len(t), "r", 7, True, "b", 3, 9, "k", False) for d, t, *_ in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    found = corpus(seed=11, n=72)
    found += [(5000 + k, f"some ordinary words here token = \"{'%040x' % (k * 7**30 % 16**40)}\" and more of them {k}") for k in range(40)]
    return found + [found[0], found[0], (None, "nobody knows this one", ""), (None, None, "")]


@pytest.fixture(scope="module")
def sf_dir(rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows[:60]], pa.int64()), "quality": pa.array([k % 2 for k in range(60)], pa.int32()), "toxic": pa.array([0] * 60, pa.int32())}), folder / "labels.parquet")
    items = benchmark(rows)
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    return str(folder)


def pairs(found):
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)


def test_quality_rejects_what_the_base_rule_rejects_and_changes_nothing(spark, rows, sf_dir):
    docs = table(spark, rows)
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = pairs(kept)
    passing = sorted(((d, t) for d, t, *_ in rows if not rules_by_force(t)[5]), key=str)
    assert all(got.count(x) <= passing.count(x) for x in got) and got


def test_one_document_of_each_group_stays(spark, rows, sf_dir):
    docs = table(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    named = [r for r in rows if r[0] is not None]
    firsts = {d for d, _, first in components_by_force(named) if d == first}
    got = pairs(kept)
    assert [x for x in got if x[0] is not None] == sorted({(d, t) for d, t, *_ in named if d in firsts}, key=str)
    assert (None, None) in got and (None, "nobody knows this one") in got


def test_contaminated_documents_go(spark, rows, sf_dir):
    docs = table(spark, rows)
    kept = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    named = [(k, t) for k, (_, t, *_) in enumerate(rows)]
    dirty = {k for k, *_, contaminated in hits_by_force(named, benchmark(rows)) if contaminated}
    assert dirty and kept.columns == docs.columns
    assert pairs(kept) == sorted(((d, t) for k, (d, t, *_) in enumerate(rows) if k not in dirty), key=str)


def test_secrets_are_masked_and_the_rest_is_not(spark, rows, sf_dir):
    docs = table(spark, rows)
    got = pairs(corpus_pipeline.secrets(spark, docs, sf_dir))
    masked = []
    for d, t, *_ in rows:
        out, at = [], 0
        for start, _, end in sorted(base_by_force(t or "")):
            if start >= at:
                out += [t[at:start], "[SECRET]"]
            at = max(at, end)
        masked.append((d, "".join([*out, t[at:]]) if t and out else t))
    assert got == sorted(masked, key=str)
    assert all(n == (None if t is None else len(t)) for n, t in corpus_pipeline.secrets(spark, docs, sf_dir).select("n_chars", "text").collect())


def test_packing_holds_every_document_whole(spark, rows, sf_dir):
    packed = corpus_pipeline.packing(spark, table(spark, rows), sf_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_stages_of_an_empty_table(spark, rows, sf_dir):
    empty = table(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_names_of_stages():
    assert [re.sub("_", "", n) for n, _ in corpus_pipeline.STAGES] == ["qualityrules", "nearduplicates", "decontamination", "secretscan", "packing"]
