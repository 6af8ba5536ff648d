"""From raw documents to packed training sequences: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns the columns of `docs`, the last one the packed pieces. Between stages
the result is written as Parquet and read again. Labels and benchmark come from `sf_dir`.

Defined results: a document that the quality rules reject goes; of each group of near duplicates the document with the
smallest doc_id stays, once if its row is repeated; a contaminated document goes; secrets are masked in the text (and
n_chars follows); all that is left is packed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm import bin_packing, contamination, jaccard_join, quality_rules, secret_scan
from ammolite.llm.common import materialize, scratch_path, tokenizer_path


def _wrapped(docs: DataFrame) -> DataFrame:
    """The row as one column beside doc_id and text, so that no column an operator adds can clash with it."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(_wrapped(docs), rules, carry=("_row",)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_duplicates(docs)
    # one key without nulls, so that the documents are dealt once for both the join and the repeated rows
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    firsts = materialize(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key).distinct(), "group-firsts")
    kept = docs.select(F.struct("*").alias("_row"), key, F.xxhash64("text").alias("_text_hash")).join(firsts, "_key", "left_semi")
    return kept.dropDuplicates(["_key", "_text_hash"]).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_row",))
    return found.where("not contaminated").select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.learn(secret_scan.scan(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack(bin_packing.tokenize_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secret_scan", secrets), ("packing", packing)]

#: Learned rules, tokenizing and the packing's evolution have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
