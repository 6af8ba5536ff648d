"""Writers of text formats as DataFrames of lines, so that Spark's text writer commits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, sep: str = ",") -> DataFrame:
    """One line a row, without a header: fields quoted where they hold a separator, quote or line break; missing ones empty."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike(f'[{sep}"\\r\\n]'), quoted).otherwise(text)

    return df.select(F.array_join(F.array(*(field(F.col(f"`{c}`")) for c in df.columns)), sep).alias("value"))


def latex(df: DataFrame) -> DataFrame:
    """Rows of a tabular, special signs escaped."""

    def field(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")

    return df.select(F.concat(F.array_join(F.array(*(field(F.col(f"`{c}`")) for c in df.columns)), " & "), F.lit(r" \\")).alias("value"))


def nexus_matrix(cells: DataFrame) -> DataFrame:
    """Lines of a NEXUS MATRIX from (taxon, pos, state): one for each taxon, states in order of pos, missing ones `?`.

    Every taxon needs a row for each position; a taxon's states are one line, so its length is the number of characters.
    """
    name = F.when(F.col("taxon").rlike(r"[\s()\[\]{}/\\,;:=*'\"`+<>-]"), F.concat(F.lit("'"), F.replace("taxon", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.col("taxon"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("state", F.lit("?")).alias("s")))), lambda x: x["s"]), "")
    return cells.groupBy("taxon").agg(row.alias("row")).select(F.concat(F.lit("    "), name, F.lit("  "), F.col("row")).alias("value"))
