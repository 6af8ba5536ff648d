"""Alpha diversity of communities held in long form (sample, taxon, abundance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alpha_diversity(abundances: DataFrame, sample: str, taxon: str, count: str) -> DataFrame:
    """Richness, Shannon, Simpson, Pielou, Margalef and Chao1 of each sample.

    Absent taxa (zero or null) do not count. Pielou and Margalef are null where richness is 1; Chao1 uses the
    bias-corrected form where there are no doubletons.
    """
    rows = abundances.groupBy(F.col(sample).alias("sample"), F.col(taxon).alias("taxon")).agg(F.sum(count).cast("long").alias("n")).where("n > 0")
    s = rows.groupBy("sample").agg(
        F.count("*").alias("s_obs"), F.sum("n").alias("n_total"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_n2"),
        F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"),
    )
    n, richness = F.col("n_total"), F.col("s_obs")
    shannon = F.log(n) - F.col("_nlogn") / n
    chao = richness + F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2.0 * F.col("f2"))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2.0)
    return s.select(
        "sample", "s_obs", "n_total", F.round(shannon, 6).alias("shannon"), F.round(1 - F.col("_n2") / (n.cast("double") * n), 6).alias("simpson"),
        F.when(richness > 1, F.round(shannon / F.log(richness), 6)).alias("pielou"), F.when(richness > 1, F.round((richness - 1) / F.log(n), 6)).alias("margalef"), F.round(chao, 6).alias("chao1"),
    )
