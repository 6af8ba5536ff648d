import pytest

import __spark_entry__
import corpus_pipeline
from ammolite.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import SF, check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text_of = {r.doc_id: r.text for r in docs.collect()}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        path = corpus_pipeline.scratch_path(spark, name)
        stage.write.parquet(path)
        stage = spark.read.parquet(path)
        assert stage.columns == docs.columns
    kept = {r.doc_id: r.text for r in stage.collect()}
    assert 0 < len(kept) < len(text_of)
    packed = corpus_pipeline.packing(spark, stage, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept)
