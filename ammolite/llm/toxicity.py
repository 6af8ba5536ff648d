"""Toxicity by a subsequence string kernel, a support vector machine over Nyström landmarks and a calibrated score.

The kernel of two strings is the sum over the subsequences of three letters that both have, each weighted by DECAY to the
power of the letters that it spans, divided by the strings' own norms: "idiot" stays near "idxiot" and "i d i o t". Strings
are the tokens of a text, lower-cased, without signs; letters that stand alone in a row are one string, long tokens are
several overlapping ones. LANDMARKS strings are chosen among those of labelled texts; the strings' kernels with them, times
the inverse root of the landmarks' own kernel matrix, are the features (Nyström) of a linear machine with squared hinge loss,
whose examples are strings with the labels of the texts that hold them. As all of the kernel's features are triples of
letters, the machine comes down to one weight a triple, so any number of landmarks costs the same when texts are scored.

A text's score is a logistic function of how many of its strings lie beyond which margins, fitted on other labelled texts
than the machine was. At most SAMPLE labelled texts, those with the smallest hashes of their ids, take part in fitting, and
the machine sees at most STRINGS strings, those with the most evidence; every text is scored whole.

Defined results: null and empty texts, and texts without strings of three letters, get the score of no evidence; repeated
rows are scored alike; labels that are null or belong to no document are left out, of several labels of one id the highest
counts; with no labels, or labels of one kind only, every score is the share of toxic labels (0 without any); empty tables
give no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import ensure_columns, materialize, release, text_blocks

SAMPLE, STRINGS, LANDMARKS = 20_000, 20_000, 96
DECAY = 0.7
#: Letters of a string; a longer token is cut into strings that begin STEP letters apart.
LONGEST, STEP = 16, 8
#: Labels of these documents are never learned from: crc32(doc_id as text) mod FOLDS.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Margins beyond which strings are counted.
MARGINS = (0.1, 0.25, 0.5, 0.75, 1.0)
#: Tokens whose margins a task remembers.
REMEMBERED = 400_000
_SIGNS = re.compile(r"[\W_]+")
_APART = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?\s+){2,}[^\W\d_](?!\w)")
_TRIPLES = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3) for n in range(3, LONGEST + 1)}


def tokens(text: str) -> list[str]:
    """White space separated tokens, and one more for every row of at least three letters that stand alone."""
    lower = text.lower()
    out = lower.split()
    out += ["".join(run.split()) for run in _APART.findall(lower)]
    return out


def strings(token: str) -> list[str]:
    """The strings of a token: its letters and digits, in overlapping parts if they are many."""
    token = _SIGNS.sub("", token)
    if len(token) <= LONGEST:
        return [token] if len(token) >= 3 else []
    return [token[i : i + LONGEST] for i in range(0, len(token) - LONGEST + STEP, STEP)]


class Letters(dict):
    """The number of each letter of the given strings; all others are number 0."""

    def __init__(self, known: str):
        super().__init__((c, k + 1) for k, c in enumerate(known))
        self.size = len(known) + 1

    def codes(self, words: list[str]) -> np.ndarray:
        """A row of numbers for each of some strings of one length."""
        return np.array([[self.get(c, 0) for c in w] for w in words], np.int64).reshape(len(words), -1)

    def triples(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each subsequence of three letters, its weight)."""
        at = _TRIPLES[codes.shape[1]]
        return (codes[:, at[:, 0]] * self.size + codes[:, at[:, 1]]) * self.size + codes[:, at[:, 2]], DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def own_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each of some strings of one length with itself."""
    n = len(words[0])
    raw = np.array([[ord(c) for c in w] for w in words], np.int64)
    equal = {(i, j): (raw[:, i] == raw[:, j]).astype(np.float64) for i in range(n) for j in range(n)}
    # ends[i, j]: weight of the pairs of equal subsequences that end at i and j, without decay for the letters before them
    ends = {at: DECAY**2 * e for at, e in equal.items()}
    zero = np.zeros(len(words))
    for _ in range(2):
        upto, longer = {}, {}
        for i in range(n):
            for j in range(n):
                before = upto.get((i - 1, j - 1), zero)
                longer[i, j] = DECAY**2 * equal[i, j] * before
                upto[i, j] = ends[i, j] + DECAY * (upto.get((i - 1, j), zero) + upto.get((i, j - 1), zero)) - DECAY**2 * before
        ends = longer
    return sum(ends.values())


def by_length(words: list[str], most: int = 20_000):
    """(places, strings) of strings of one length, at most so many at a time."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for i in range(0, len(at), most):
            part = at[i : i + most]
            yield part, [words[k] for k in part]


def features(words: list[str], letters: Letters, table: np.ndarray) -> np.ndarray:
    """Normalised kernel of each string with each column of `table`, which holds weights by triple."""
    out = np.zeros((len(words), table.shape[1]))
    for at, part in by_length(words, max(1, 200_000 // table.shape[1])):
        numbers, weights = letters.triples(letters.codes(part))
        norm = np.sqrt(own_kernel(part))
        for k in range(numbers.shape[1]):
            out[at] += weights[k] * table[numbers[:, k]]
        out[at] /= norm[:, None]
    return out


@dataclass
class Machine:
    """Weights by triple of letters, the bias, and the score's logistic function (none while it is being fitted)."""

    letters: Letters
    weights: np.ndarray
    bias: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    logit: np.ndarray | None = None
    base: float = 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.logit is None:
            return np.full(len(evidence), self.base)
        z = (evidence - self.mean) / self.scale @ self.logit[:-1] + self.logit[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Evidence:
    """What a text's strings say, given a machine: tokens' margins are remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def _margins(self, missing: list[str]) -> list[float]:
        """The largest margin of each token's strings; 0 for one without strings."""
        parts = [strings(t) for t in missing]
        flat = [s for p in parts for s in p]
        if not flat:
            return [0.0] * len(missing)
        found = features(flat, self.machine.letters, self.machine.weights[:, None])[:, 0] + self.machine.bias
        ends = np.cumsum([len(p) for p in parts])
        return [float(found[e - len(p) : e].max()) if p else 0.0 for e, p in zip(ends, parts)]

    def block(self, texts: list[str]) -> np.ndarray:
        cut = [tokens(t) for t in texts]
        every = set().union(*cut)
        missing = [t for t in every if t not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(every)
        fresh = dict(zip(missing, self._margins(missing)))
        local = {t: fresh[t] if t in fresh else self.known[t] for t in every}
        self.known.update((t, m) for t, m in fresh.items() if len(t) <= 64)
        out = np.zeros((len(texts), 2 * len(MARGINS) + 2))
        for k, words in enumerate(cut):
            if words:
                m = np.fromiter(map(local.__getitem__, words), np.float64, len(words))
                beyond = (m[:, None] > MARGINS).sum(0)
                out[k] = np.concatenate((np.log1p(beyond), beyond / np.sqrt(len(words)), [max(0.0, m.max()), m.mean()]))
        return out


def _newton(x: np.ndarray, step, most: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(most):
        gradient, hessian = step(w)
        move = np.linalg.solve(hessian, gradient)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_machine(words: list[str], toxic: np.ndarray, clean: np.ndarray, most: int = LANDMARKS, cost: float = 1.0) -> Machine:
    """The machine over strings that so many toxic and clean texts hold; clean ones are weighted to the same total."""
    share = toxic.sum() / max(1.0, clean.sum())
    lean = (toxic - clean * share) / np.sqrt(toxic + clean * share**2)
    letters = Letters("".join(sorted({c for w in words for c in w}, key=lambda c: (-sum(c in w for w in words[:2000]), c))[:63]))

    def explicit(chosen: list[str]) -> np.ndarray:
        table = np.zeros((letters.size**3, len(chosen)))
        for k, w in enumerate(chosen):
            numbers, weights = letters.triples(letters.codes([w]))
            np.add.at(table[:, k], numbers[0], weights / np.sqrt(own_kernel([w])[0]))
        return table

    # landmarks: strings that lean to the toxic side, to the clean side, and frequent ones, each unlike those before it
    chosen: list[str] = []
    for order, upto in ((np.argsort(-lean, kind="stable"), most // 2), (np.argsort(lean, kind="stable"), most * 5 // 8), (np.argsort(-(toxic + clean), kind="stable"), most)):
        seen = explicit(chosen) if chosen else None
        for k in order[: 20 * most]:
            if len(chosen) >= upto:
                break
            one = explicit([words[k]])
            if seen is None or (features([words[k]], letters, seen) < 0.8).all():
                chosen.append(words[k])
                seen = one if seen is None else np.hstack([seen, one])
    table = explicit(chosen)
    values, vectors = np.linalg.eigh(features(chosen, letters, table))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = features(words, letters, table) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    signs, weights = np.repeat([1.0, -1.0], len(x)), cost * np.concatenate([toxic, clean * share])

    def step(w):
        margin = x @ w
        short = np.maximum(0, 1 - signs * np.concatenate([margin, margin])) * weights
        active = (short > 0) * weights
        both = active[: len(x)] + active[len(x) :]
        pull = (short * signs).reshape(2, -1).sum(0)
        ridge = np.append(np.ones(len(w) - 1), 1e-6)
        return ridge * w - 2 * x.T @ pull, np.diag(ridge) + 2 * (x * both[:, None]).T @ x

    w = _newton(x, step)
    return Machine(letters, table @ (root @ w[:-1]), float(w[-1]))


def fit_score(machine: Machine, evidence: np.ndarray, labels: np.ndarray) -> Machine:
    """The machine with a logistic function from evidence to the share of toxic labels."""
    machine.base = float(labels.mean()) if len(labels) else 0.0
    if not 0 < machine.base < 1:
        return machine
    mean, scale = evidence.mean(0), evidence.std(0) + 1e-9
    x = np.hstack([(evidence - mean) / scale, np.ones((len(evidence), 1))])
    ridge = np.append(np.full(x.shape[1] - 1, 1.0), 1e-6)

    def step(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (p - labels) + ridge * w, (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)

    machine.mean, machine.scale, machine.logit = mean, scale, _newton(x, step)
    return machine


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled documents that are not held out: half of them for the machine, half for the score."""
    told = ensure_columns(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(~_held_out())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # which ids: those with the smallest hashes, at most `sample` rows of 12 bytes, so that they can be broadcast
    picked = told.withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id").limit(sample).select("doc_id", "toxic", F.pmod("hash", F.lit(2)).cast("int").alias("part"))
    texts = materialize(ensure_columns(documents, doc_id="long", text="string").join(F.broadcast(picked), "doc_id").select("text", "toxic", "part"), "labelled-texts")

    def distinct(batches):
        for batch in batches:
            words, marks = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {s for t in set(tokens(text or "")) for s in strings(t)}
                words += own
                marks += [int(toxic > 0)] * len(own)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(marks, pa.int32())], names=["string", "toxic"])

    totals = texts.where("part = 0").agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    counts = texts.where("part = 0").select("text", "toxic").mapInArrow(distinct, "string string, toxic int").groupBy("string").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    share = totals.t / max(1, totals.n)
    evidence = (F.col("t") - F.col("n") * share) * (F.col("t") - F.col("n") * share) / F.col("n")
    found = counts.orderBy(evidence.desc(), "string").limit(STRINGS).toPandas()
    machine = Machine(Letters(""), np.zeros(1), 0.0)
    if 0 < totals.t < totals.n and len(found):
        machine = fit_machine(found["string"].tolist(), found["t"].to_numpy(float), (found["n"] - found["t"]).to_numpy(float))
    rows = _apply(texts.where("part = 1" if totals.t else "true").select(F.col("toxic").alias("doc_id"), "text"), machine, whole=True).toPandas()
    seen = np.array(rows["evidence"].tolist(), float).reshape(len(rows), 2 * len(MARGINS) + 2)
    return fit_score(machine, seen, (rows["doc_id"].to_numpy() > 0).astype(float))


def _apply(rows: DataFrame, machine: Machine, whole: bool) -> DataFrame:
    """doc_id and score of each of `rows` (doc_id, text), or the evidence itself."""
    told = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        judge = Evidence(told.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in text_blocks(texts):
                seen = judge.block(texts[lo:hi])
                value = pa.array(seen.tolist(), pa.list_(pa.float64())) if whole else pa.array(told.value.score(seen))
                yield pa.record_batch([batch.column(0)[lo:hi], value], names=["doc_id", "evidence" if whole else "score"])
        del judge
        release()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ("evidence array<double>" if whole else "score double"))


def toxicity(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`."""
    scored = _apply(ensure_columns(documents, doc_id="long", text="string"), machine, whole=False)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(documents, learn(documents, labels))
