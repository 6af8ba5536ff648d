"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Bigrams of all words are put into one order, rare ones first. An edit touches at most two of a word's bigrams, so two
words that are one edit apart share one of the three rarest of each, and that bigram lies at the same distance from the
start in both (the edit is behind it) or from the end (the edit is before it). Words are joined on such a bigram with its
place. That alone would put too many words together, so the key also holds what the edit cannot have touched: everything on
the bigram's other side, and of the side with the edit either the half next to the bigram or the half beyond, as one of the
two is whole. The pairs that meet are verified by their edit distance.

Words are counted in tasks and then by a grouping; the order of the bigrams has at most as many entries as there are
pairs of the 90 letters. Groups of near words are followed to their last form by pointer jumping, one join a round.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one before the colon; repeated rows
count again; of equally frequent forms the smallest in code-point order is taken; very long runs are words like others; an
empty table, or one without words, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import discard, ensure_columns, materialize

LETTERS = re.compile("[A-Za-z\u00c0-\u00ff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHORTEST, LEAST, PREFIX = 5, 3, 3
#: A run whose hash this number divides loses a letter.
DROP = 97
#: Distinct words that a task counts before it hands the counts on.
HELD = 300_000


def text_words(doc_id: int | None, text: str | None) -> Counter:
    """Runs of letters of one text, A-Z lower-cased, those that the hash picks without one of their letters."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(LETTERS.findall(text or "")).items():
        word = run.translate(_LOWER)
        h = zlib.crc32(word.encode(), start)
        if h % DROP == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= SHORTEST:
            out[word] += n
    return out


def count_words(documents: DataFrame) -> DataFrame:
    """word, n of every word with enough letters and occurrences."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            rows = pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in text_words(doc_id, text.as_py()).items():
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    docs = ensure_columns(documents, doc_id="long", text="string")
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the common order, rare ones first: one entry a pair of letters at most."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.update({word[i : i + 2] for i in range(len(word) - 1)})
        yield pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["bigram", "n"])

    found = words.select("word").mapInArrow(run, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect()
    return {r.bigram: k for k, r in enumerate(sorted(found, key=lambda r: (r.n, r.bigram)))}


def rarest(word: str, order: dict[str, int]) -> list[int]:
    """Places of the word's three rarest bigrams; equal ones from the left."""
    return sorted(range(len(word) - 1), key=lambda i: (order[word[i : i + 2]], i))[:PREFIX]


def join_keys(word: str, order: dict[str, int]) -> set[tuple[int, int]]:
    """(key, letters of the longer of two words that meet there): the word is that long, or one letter shorter."""
    out, size = set(), len(word)
    for longer in (size, size + 1):
        for p in rarest(word, order):
            tail = size - p - 2
            # the edit is behind the bigram: of the rest, one of two halves is the same in both words
            rest = longer - p - 2
            if rest >= 1:
                half = rest // 2
                out.add((f"<{p}:{word[: p + 2 + half]}", longer))
                out.add((f"<{p}:{word[: p + 2]}~{word[max(p + 2, size - (rest - half)) :]}", longer))
            # the edit is before it: the same, seen from the word's end
            rest = longer - tail - 2
            if rest >= 1:
                half = rest // 2
                out.add((f">{tail}:{word[max(0, p - half) :]}", longer))
                out.add((f">{tail}:{word[p:]}~{word[: min(p, rest - half)]}", longer))
    return {(xxhash.xxh3_64_intdigest(k.encode(), longer) - (1 << 63), longer) for k, longer in out}


def near_words(words: DataFrame) -> DataFrame:
    """Every pair of words one edit apart, once: word (smaller), other."""
    order = words.sparkSession.sparkContext.broadcast(bigram_order(words))

    def run(batches):
        ranks = order.value
        for batch in batches:
            names, keys, longs = [], [], []
            for word in batch.column(0).to_pylist():
                for key, longer in join_keys(word, ranks):
                    names.append(word)
                    keys.append(key)
                    longs.append(len(word) == longer)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(longs, pa.bool_())], names=["key", "word", "long"])

    keys = words.select("word").mapInArrow(run, "key long, word string, long boolean")
    # a word has up to two dozen keys, which the sizes that a planner estimates do not tell: never broadcast
    x, y = keys.alias("x"), keys.alias("y").hint("merge")
    # of two shorter words the pair meets under their own length
    together = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")) & (F.col("x.long") | F.col("y.long")) & (F.levenshtein("x.word", "y.word", 1) == 1))
    return together.select(F.col("x.word").alias("word"), F.col("y.word").alias("other")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """word, root of every row of `forms` (word, form): pointers jump until none points to a word with a form.

    A form is at least twice as frequent as its word, so there are no circles, and rounds are as many as the logarithm of the longest chain.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = state.join(further, "root", "left")
        state = materialize(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not state.where("moved").head(1):
            return state.drop("moved")


def variants(documents: DataFrame) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word of the documents."""
    words = materialize(count_words(documents), "words")
    pairs = materialize(near_words(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    told = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = told.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = follow(found.where("form is not null"))
    discard(pairs)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
