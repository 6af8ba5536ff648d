"""Quality rules learned as an ordered decision list, in DataFrame functions only.

`features` computes a document's statistics inside its own row: no shuffle. `learn` runs sequential covering over a
bounded sample of labelled rows: it grows a conjunction of thresholds that best separates low quality from the rest,
prunes it on rows held back, removes what it covers and goes on. `verdict` turns the list into one conditional
expression, so that applying it costs no more than a projection.

Defined results: a null text has no words and fails the base rule; labels that are null or whose document is missing are
not used; a document labelled more than once counts with its mean label; with no usable labels the list is empty and the
base rule alone decides. Repeated and null doc_ids keep all their rows, a null one is never labelled; very long texts count whole;
equally good conditions go to the earlier statistic and the lower cut; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import SPACE_CLASS, ensure_columns, materialize

WINDOW = 5
#: Labelled documents that the list is fitted on, at most: those whose hashed ids are lowest.
MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must be right this often on the rows held back, and cover so many of the rows it is grown on.
MIN_PRECISION, MIN_COVER = 0.97, 8
CUTS = [0.01, 0.02, 0.05, *(k / 20 for k in range(2, 19)), 0.95, 0.98, 0.99]
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_upper", "f_exclaim", "f_dup_lines", "f_repeats", "f_digits")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the array of window hashes."""

    def from_sorted(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.coalesce(x["h"] == F.get(s, i + 1)["h"], x["h"] == F.get(s, i - 1)["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
        return F.transform(F.array(starts), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))[0]

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    counted = F.transform(F.array(ordered), from_sorted)[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once a row, wherever the optimizer moves or copies the expression."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """Hashes of all windows of words; none if there are fewer words than a window and one more has."""
    every = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > WINDOW, every(h)).otherwise(F.array().cast("array<bigint>")))


def features(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics and the features of each row; `carry` names further columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _let(_windows(w), _repeat_words).alias("repeats"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    step = documents.select(
        *carry, F.col("doc_id").cast("long").alias("doc_id"), _let(words, of_words).alias("_w"), _let(lines, of_lines).alias("_l"),
        count("[^#*$%&|<>]+").cast("long").alias("n_symbols"), count(r"[^\p{Lu}]+").alias("_upper"), count("[^!]+").alias("_exclaim"), count("[^0-9]+").alias("_digits"),
    )
    step = step.select("*", F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), F.col("_w.repeats").alias("n_repeat_words"), F.col("_l.dup").alias("n_dup_lines"))
    share = lambda x, of: F.round(F.col(x) / F.greatest(F.col(of), F.lit(1)), 6)
    return step.select(
        *carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.col("n_words").cast("double").alias("f_words"), share("word_chars", "n_words").alias("f_word_chars"), share("n_symbols", "word_chars").alias("f_symbols"), share("_upper", "word_chars").alias("f_upper"),
        share("_exclaim", "n_words").alias("f_exclaim"), share("_l.dup", "_l.n").alias("f_dup_lines"), share("n_repeat_words", "n_words").alias("f_repeats"), share("_digits", "word_chars").alias("f_digits"),
    )


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[tuple[int, int], dict[Condition, tuple[int, int]]]:
    """(low-quality rows, others) in all, and of those that meet each condition.

    One aggregate makes a histogram over the cuts of every feature, at most a few hundred rows; sums over its bins give the
    counts of both sides of each cut.
    """

    def place(feature: str, at: list[float]) -> Column:
        return F.struct(F.lit(feature).alias("f"), F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= F.col(feature))).alias("b"))

    bins = F.array(*(place(f, c) for f, c in cuts.items()))
    found = rows.select("low", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.count_if(F.col("low") == 1).alias("p"), F.count_if(F.col("low") == 0).alias("n")).collect()
    table: dict[str, list[list[int]]] = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
    for f, b, p, n in found:
        table[f][b] = [p, n]
    out = {}
    for f, c in cuts.items():
        for j, cut in enumerate(c):
            for above, part in ((True, table[f][j + 1 :]), (False, table[f][: j + 1])):
                out[Condition(f, above, cut)] = (sum(x[0] for x in part), sum(x[1] for x in part))
    total = next(iter(table.values()))
    return (sum(x[0] for x in total), sum(x[1] for x in total)), out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """The decision list: each item is a conjunction that rejects what it covers, tried in order."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") < 0.5).cast("int").alias("low"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # a bounded table, so it may be broadcast
    docs = ensure_columns(documents, doc_id="long", text="string")
    rows = features(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")), carry=("low",))
    rows = materialize(rows.select("low", "base_failed", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held"), *FEATURES), "labelled-features").where(~F.col("base_failed"))
    grow, held = rows.where(~F.col("held")), rows.where(F.col("held"))

    found = grow.agg(*(F.percentile_approx(F.when(F.col("low") == y, F.col(f)) if y else F.col(f), CUTS, 10_000).alias(f"{f}_{y}") for f in FEATURES for y in (0, 1))).first().asDict()
    cuts = {f: c for f in FEATURES if (c := sorted({*(found[f"{f}_0"] or ()), *(found[f"{f}_1"] or ())}))}
    rules: list[list[Condition]] = []
    while cuts and len(rules) < MAX_RULES:
        rest = F.lit(True)
        for r in rules:
            rest = rest & ~_all(r)
        left, left_held = grow.where(rest), held.where(rest)
        rule: list[Condition] = []
        (p0, n0), each = _counts(left, cuts)
        while p0 and n0 and len(rule) < MAX_CONDITIONS:
            if rule:
                _, each = _counts(left.where(_all(rule)), cuts)
            c = max(each, key=lambda c: (round(_gain(*each[c], p0, n0), 9), -FEATURES.index(c.feature), -c.cut))
            if _gain(*each[c], p0, n0) <= 0 or each[c][0] < MIN_COVER:
                break
            rule.append(c)
            p0, n0 = each[c]
        if not rule:
            break
        row = left_held.agg(*(F.count_if(_all(rule[: k + 1]) & (F.col("low") == y)).alias(f"c{k}_{y}") for k in range(len(rule)) for y in (1, 0))).first()
        seen = list(zip(row[::2], row[1::2]))
        best = max(range(len(rule)), key=lambda k: ((seen[k][0] - seen[k][1]) / max(1, sum(seen[k])), -k))
        p, n = seen[best]
        if (p + 1) / (p + n + 1) < MIN_PRECISION or not p and p0 < 4 * MIN_COVER:
            break
        rules.append(rule[: best + 1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional: the number of the first rule that rejects a row, 0 if none does."""
    out = F.when(F.col("base_failed"), F.lit(-1))
    for k, rule in enumerate(rules):
        out = out.when(_all(rule), F.lit(k + 1))
    return out.otherwise(F.lit(0))


def judge(documents: DataFrame, rules: list[list[Condition]], carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, base_failed, rule (-1 base, 0 none) and kept for each row."""
    # rand() only keeps the optimizer from copying the features into filters on the verdict, which would compute them twice
    rule = F.when(F.rand(0) < 2, verdict(rules))
    return features(documents, carry).withColumn("rule", rule).withColumn("kept", F.col("rule") == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = learn(documents, labels)
    return judge(ensure_columns(documents, doc_id="long", text="string"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
