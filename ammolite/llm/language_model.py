"""Scores of texts under a hierarchical Pitman-Yor language model learned from the training documents.

Every word is a dish. It is served in context restaurants, one for each word that stands before a word, which share one
parent, the root, whose base is uniform over the vocabulary and one unknown word. A restaurant's tables are customers of the
root. Gibbs sweeps sample the number of tables of every dish in every restaurant, given the tables of the sweep before and
the root's probabilities; tables, totals and root probabilities are averaged over the sweeps after the burn-in, and with
them the predictive probabilities.

Restaurants are named by 56-bit hashes of the actual words before, so there are as many as the corpus has. An entry
(context, word, customers) belongs to a part, by its context; the entries of contexts that very many tokens have are dealt
out by context and word, and only their totals and sums over the root go through the driver. Groups of documents are counted
before they are dealt and sent as compressed byte planes, in which a bounded number of frequent words have codes of two
bytes. A dish with one customer has one table in every sample, so sweeps visit the entries with more than one and add the
others as a constant. The root is dealt out in buckets of words; a part and a bucket exchange a row of numbers in the order of
the part's words there, not a row a word. For scoring, groups send their entries again with the documents of every token;
each part returns sums by document, in whole steps of 2**-26. Random numbers are hashes of entry and sweep: no seating depends
on partitions. Up to 128 customers are seated one by one; more in blocks of a 64th of those present, with a binomial number of
new tables for a block.

Defined results: a null text is empty and has one token, the end; a null doc_id is trained on (its remainder is taken as 0);
repeated rows are texts of their own; very long texts count whole; words of equal hash are one; with no training tokens every
word is unknown and both scores are logarithms of 1 / (V + 1) = 1; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import END_WORD, collect_garbage, discard, ensure_columns, materialize, mix, runs, signed, word_blocks

#: Sweeps in all, and how many of them are discarded.
SWEEPS, BURN_IN = 3, 1
#: Strengths of the root and of the context restaurants.
STRENGTH = (1.0, 1.0)
#: Bytes of text that are counted together, and tokens of a part: bounds on a task's memory.
GROUP_BYTES, PART_TOKENS = 2_000_000, 500_000
#: A context is dealt out by its words where it has this share of a part's tokens.
HOT_SHARE = 0.25

#: Words of a bucket of the root, on average.
BUCKET_WORDS = 200_000
#: So many of the most frequent words have codes of two bytes where entries are sent; others go by their names.
CODED = 65_534

#: What a group tells of each of its documents.
_NAME = np.dtype([("doc_id", "<i8"), ("nameless", "?"), ("held_out", "?"), ("n_tokens", "<i8")])
#: Stands before a text. Names of words and contexts have 56 bits.
BEGIN_WORD, NAME_BITS = np.uint64(0x9FB21C651E98DF25), np.uint64((1 << 56) - 1)
_RARE = 65_535
#: Sums of logarithms are sent as whole multiples of this.
_STEP = 2.0**-26
_CODEC = pa.Codec("zstd", 1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, each with its length, the bytes that its largest number takes, and the numbers, all lowest bytes first, compressed: planes of like bytes take little room."""
    out = []
    for x in columns:
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [struct.pack("<IB", len(x), width), np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(memoryview(body)[8:], struct.unpack_from("<Q", body)[0], asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, width = struct.unpack_from("<IB", raw, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += 5 + n * width
    return out


def _steps(v: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, the first from 0."""
    return np.diff(v, prepend=v.dtype.type(0))


def _groups(batches):
    """Groups of documents: (first key, names, word and document of every token)."""
    for b in batches:
        keys = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
        names = np.zeros(len(keys), _NAME)
        names["doc_id"], names["nameless"] = b.column(3).fill_null(0).to_numpy(zero_copy_only=False), b.column(3).is_null().to_numpy(zero_copy_only=False)
        names["held_out"] = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, block in word_blocks(b.column(2), lower=True, most=GROUP_BYTES):
            # an end after each text's last word
            counts = block.counts
            w = np.full(len(block.hashes) + len(counts), END_WORD)
            w[runs(counts, np.cumsum(counts + 1) - (counts + 1))] = block.hashes
            names["n_tokens"][lo:hi] = counts + 1
            yield int(keys[lo]), names[lo:hi], w & NAME_BITS, np.repeat(np.arange(hi - lo), counts + 1)


def _word_rows(batches):
    """(w, n, m): training tokens and all tokens of each word of a group."""
    for _, names, w, doc in _groups(batches):
        held = names["held_out"][doc]
        words, at = np.unique(w, return_inverse=True)
        all_ = np.bincount(at, minlength=len(words))
        yield pa.record_batch([signed(words), all_ - np.bincount(at, held, len(words)).astype(np.int64), all_], names=["w", "n", "m"])


def _bucket_order(words: np.ndarray, buckets: int):
    """Sorted words by the root's buckets: their order, and (bucket, from, to) of each bucket in it."""
    bucket = (mix(words ^ _salt(0, 2)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


_ROW = "part int, bucket int, kind int, n long, body binary, a double, b double"
_STATE, _ENTRIES, _NAMES, _HOT, _HOT_TABLES, _WORDS, _INDEX, _TABLES, _SEATED, _REPLY, _SUMS = range(11)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    """From (part, bucket, kind, n, body, a, b); the last ones may be left out."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64())
    columns = list(zip(*((*r, *(None,) * (7 - len(r))) for r in rows))) or [()] * 7
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "bucket", "kind", "n", "body", "a", "b"])


def _sorted_tokens(v: np.ndarray, w: np.ndarray, doc: np.ndarray, n_words: int, n_docs: int):
    """Numbers of context, word and document of all tokens, sorted by these: as one number each where they have room in it."""
    wide, narrow = n_words.bit_length(), n_docs.bit_length()
    if 2 * wide + narrow > 63:
        order = np.lexsort((doc, w, v))
        return v[order], w[order], doc[order]
    key = np.sort(((v << wide | w) << narrow) | doc)
    return key >> (wide + narrow), key >> narrow & ((1 << wide) - 1), key & ((1 << narrow) - 1)


def _entry_rows(parts: int, hot: np.ndarray, coded: np.ndarray, with_tokens: bool):
    """A row for each part that a group has entries in: entries of each context, contexts, words, training customers; with tokens also how many tokens an entry has and their documents."""

    def run(batches):
        for group, names, w, doc in _groups(batches):
            words, w = np.unique(np.append(w, BEGIN_WORD & NAME_BITS), return_inverse=True)
            # a word is the context of the next one, an empty place that of a text's first word
            v, w = np.concatenate((w[-1:], w[:-2])), w[:-1]
            v[np.flatnonzero(np.diff(doc, prepend=-1))] = np.searchsorted(words, BEGIN_WORD & NAME_BITS)
            v, w, doc = _sorted_tokens(v, w, doc, len(words), len(names))
            first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
            train = np.add.reduceat((~names["held_out"][doc]).astype(np.int64), first)
            sizes, v, w = np.diff(np.append(first, len(v))), v[first], w[first]
            # the part of each entry: by its context, by context and word where the context is hot
            name = mix(words)
            key, burning = name[v], np.isin(words, hot)[v]
            key[burning] = mix(words[v[burning]] ^ name[w[burning]])
            part = (key % np.uint64(parts)).astype(np.uint16 if parts <= 65_536 else np.int64)
            order = np.argsort(part, kind="stable")
            part, v, w, train, sizes, first = part[order].astype(np.int64), v[order], w[order], train[order], sizes[order], first[order]
            if with_tokens:
                doc, ends = doc[runs(sizes, first)], np.append(0, np.cumsum(sizes)).tolist()
            code = np.searchsorted(coded, words)
            code = np.where(coded[np.minimum(code, len(coded) - 1)] == words, code, _RARE)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                begins = np.flatnonzero(np.diff(v[lo:hi], prepend=-1))
                context, word = v[lo:hi][begins], w[lo:hi]
                vc, wc = code[context], code[word]
                body = [np.diff(np.append(begins, hi - lo)), vc, words[context[vc == _RARE]], wc, words[word[wc == _RARE]], train[lo:hi]]
                if with_tokens:
                    body += [sizes[lo:hi], doc[ends[lo] : ends[hi]], np.array([ends[hi] - ends[lo]])]
                rows.append((int(part[lo]), None, _ENTRIES, group, pack(*body)))
            if with_tokens:
                rows.append((group % parts, None, _NAMES, group, names.tobytes()))
            yield _row_batch(rows)

    return run


def _by_part(of_part):
    """Rows come sorted by their first column, a part or bucket: `of_part` gets those of each, as a table."""

    def run(batches):
        held, key = [], None
        for b in batches:
            part = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and key != part[lo]:
                        yield from of_part(int(key), pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(lo, hi - lo))
                    key = part[lo]
        if held:
            yield from of_part(int(key), pa.Table.from_batches(held))

    return run


def _of_kind(rows: pa.Table, kind: int, by: str) -> tuple[list, list]:
    """Values of the column `by`, in order, and bodies of the rows of a kind."""
    rows = rows.filter(pa.array(rows["kind"].to_numpy() == kind)).sort_by(by)
    return rows[by].to_pylist(), rows["body"].to_pylist()


def _joined(bodies: list, n: int) -> list[np.ndarray]:
    """`n` columns of all bodies, end to end."""
    found = [unpack(body) for body in bodies]
    return [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.uint64) for k in range(n)]


def _by_name(code: np.ndarray, rare: np.ndarray, coded: np.ndarray) -> np.ndarray:
    out = coded[np.minimum(code, np.uint64(len(coded) - 1)).astype(np.int64)]
    out[code == _RARE] = rare
    return out


class Entries:
    """Distinct entries of a part from those of its groups: context, word, customers; `of` names the entry of each one given. They are told apart by 64-bit hashes."""

    def __init__(self, each: np.ndarray, vc: np.ndarray, v_rare: np.ndarray, wc: np.ndarray, w_rare: np.ndarray, n: np.ndarray, coded: np.ndarray):
        v, w = np.repeat(_by_name(vc, v_rare, coded), each.astype(np.int64)), _by_name(wc, w_rare, coded)
        key = entry_seeds(v, w, 0)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.v, self.w = v[order[first]], w[order[first]]
        self.n = np.add.reduceat(n[order].astype(np.int64), first) if len(v) else np.empty(0, np.int64)
        self.of = np.empty(len(v), np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        self.context, self.at = np.unique(self.v, return_inverse=True)
        #: those with several customers, by context
        many = np.flatnonzero(self.n > 1)
        self.many = many[np.argsort(self.at[many], kind="stable")]

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum over each context."""
        return np.bincount(self.at, values, len(self.context))


def _merge(hot: np.ndarray, coded: np.ndarray, buckets: int):
    """From a part's entries: the state of those with several customers (a and b count entries of one and of two), the words of each bucket of the root, single entries and customers of hot contexts, and at how many tables others are at first."""

    def of_part(part, rows):
        e = Entries(*_joined(_of_kind(rows, _ENTRIES, "n")[1], 6), coded)
        single, many = e.n == 1, e.many
        alone, customers = e.totals(single).astype(np.int64), e.totals(e.n)
        ones = np.ones(len(many), np.int64)
        out = [(part, None, _STATE, None, pack(_steps(e.v[many]), e.w[many], e.n[many], ones, 0 * ones, alone[e.at[many]]), float(single.sum()), float((e.n == 2).sum()))]
        words, at = np.unique(e.w, return_inverse=True)
        order, cuts = _bucket_order(words, buckets)
        counts = [np.bincount(at, x, len(words)).astype(np.int64)[order] for x in (e.n, single, e.n > 1)]
        words = words[order]
        out += [(part, bucket, _WORDS, None, pack(_steps(words[lo:hi]), *(c[lo:hi] for c in counts))) for bucket, lo, hi in cuts]
        several = e.totals(e.n > 1)
        for k in np.flatnonzero(np.isin(e.context, hot)).tolist():
            out += [(part, None, _HOT, int(e.context[k]), None, float(alone[k]), float(customers[k])), (part, None, _HOT_TABLES, int(e.context[k]), None, float(several[k]))]
        yield _row_batch(out)

    return of_part


def _index(bucket, rows):
    """From the words of a bucket's parts: its words with training tokens, single entries and others (a and b count words of one and of two customers); and for each part the places of its words, and which have entries of several customers there."""
    parts, bodies = _of_kind(rows, _WORDS, "part")
    found = [unpack(body) for body in bodies]
    names = [np.cumsum(x[0]) for x in found]
    words, at = np.unique(np.concatenate(names), return_inverse=True)
    c, fixed, moving = (np.bincount(at, np.concatenate([x[k] for x in found]), len(words)).astype(np.int64) for k in (1, 2, 3))
    out = [(None, bucket, _WORDS, None, pack(_steps(words), c, fixed, moving), float((fixed + moving == 1).sum()), float((fixed + moving == 2).sum()))]
    lo = 0
    for part, name, x in zip(parts, names, found):
        out.append((part, bucket, _INDEX, None, pack(_steps(at[lo : lo + len(name)]), x[3] > 0)))
        lo += len(name)
    yield _row_batch(out)


def _root(k: int, weight: float, discount: float):
    """A bucket's step of the root: from its parts' tables (at first one an entry) its words' customers and tables (a and b: their sums), and for each part those of the words that it seats.

    After the last sweep each part gets training tokens and the customers and tables of all sweeps kept, of all its words.
    """

    def of_bucket(bucket, rows):
        steps, c, fixed, moving = unpack(_of_kind(rows, _WORDS, "part")[1][0])
        words = np.cumsum(steps)
        parts, bodies = _of_kind(rows, _INDEX, "part")
        places = []
        for body in bodies:
            at, seats = unpack(body)
            places.append((np.cumsum(at).astype(np.int64), seats > 0))
        if k:
            sent = dict(zip(*_of_kind(rows, _TABLES, "part")))
            moving = np.zeros(len(words), np.uint64)
            for part, (at, seats) in zip(parts, places):
                if part in sent:
                    moving[at[seats]] += unpack(sent[part])[0]
        customers = (fixed + moving).astype(np.int64)
        tables = _seat(customers, np.full(len(words), weight), discount, mix(words ^ _salt(k, 0))).astype(np.int64)
        out = [(None, bucket, _SEATED, k, pack(customers, tables), float(customers.sum()), float(tables.sum()))]
        told = [customers, tables] if k < SWEEPS else [c, *(x for body in _of_kind(rows, _SEATED, "n")[1] for x in unpack(body)), customers, tables]
        for part, (at, seats) in zip(parts, places):
            if k == SWEEPS or seats.any():
                at = at if k == SWEEPS else at[seats]
                out.append((part, bucket, _REPLY, None, pack(*(x[at] for x in told))))
        yield _row_batch(out)

    return of_bucket


def predictive(n, tables, discount, strength, all_tables, all_customers, parent):
    """Probability of a dish with `n` customers at `tables` tables."""
    return (n - discount * tables + (strength + discount * all_tables) * parent) / (strength + all_customers)


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    return (mix(seeds + np.uint64(step)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _seat(counts: np.ndarray, weight: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables that `counts` customers of each dish take; weight: (strength + discount * tables) * parent's probability."""
    tables = np.minimum(counts, 1).astype(np.float64)
    live = np.flatnonzero(counts > 1)
    seated = 1
    while len(live):
        step = max(1, seated // 64)
        block = np.minimum(step, counts[live] - seated)
        p = weight[live] / (seated - discount * tables[live] + weight[live])
        u = _uniform(seeds[live], 2 * seated)
        tables[live] += (u < p) if step == 1 else _binomial(block, p, u, seeds[live], 2 * seated + 1)
        seated += step
        live = live[counts[live] > seated]
    return tables


def _binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, seeds: np.ndarray, step: int) -> np.ndarray:
    """Binomial numbers from uniform ones: the distribution's steps are counted up to u; where the mean is over 20, its normal limit."""
    out = np.zeros(len(n))
    large = n * p > 20
    if large.any():
        normal = np.sqrt(-2 * np.log(np.maximum(u, 2.0**-54))) * np.cos(2 * np.pi * _uniform(seeds, step))
        out = np.where(large, np.clip(np.rint(n * p + normal * np.sqrt(n * p * (1 - p))), 0, n), 0.0)
    chance = np.where(large, 1.0, np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12))))
    below, odds = chance.copy(), p / np.maximum(1 - p, 1e-12)
    live = np.flatnonzero(~large & (u >= below))
    k = 0
    while len(live) and k < 200:
        chance[live] *= (n[live] - k) / (k + 1) * odds[live]
        below[live] += chance[live]
        k += 1
        out[live] = np.minimum(k, n[live])
        live = live[(u[live] >= below[live]) & (n[live] > k)]
    return out


def _salt(sweep: int, level: int) -> np.uint64:
    return np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)


def entry_seeds(v: np.ndarray, w: np.ndarray, sweep: int) -> np.ndarray:
    return mix(mix(v ^ _salt(sweep, 1)) + w)


def _sweep(sweep: int, keep: bool, discount: float, hot: np.ndarray, hot_tables: np.ndarray, buckets: int, p_root):
    """A part's sweep, from its state and what the root told it: the new state, tables by word for each bucket, and by hot context. `p_root` is the root's probability by customers and tables."""

    def of_part(part, rows):
        v, w, customers, tables, kept, alone = unpack(_of_kind(rows, _STATE, "n")[1][0])
        v, tables, kept = np.cumsum(v), tables.astype(np.float64), kept.astype(np.float64)
        context, at = np.unique(v, return_inverse=True)
        total = np.bincount(at, tables, len(context)) + _once(alone, at, len(context))
        burning = np.isin(context, hot)
        total[burning] = hot_tables[np.searchsorted(hot, context[burning])]
        own, word = np.unique(w, return_inverse=True)
        order, cuts = _bucket_order(own, buckets)
        p0 = np.empty(len(own))
        p0[order] = p_root(*_joined(_of_kind(rows, _REPLY, "bucket")[1], 2))
        weight = (STRENGTH[1] + discount * total[at]) * p0[word]
        new = _seat(customers.astype(np.int64), weight, discount, entry_seeds(v, w, sweep))
        out = [(part, None, _STATE, None, pack(_steps(v), w, customers, new, kept + new if keep else kept, alone))]
        sums = np.bincount(word, new, len(own))[order]
        out += [(part, bucket, _TABLES, None, pack(sums[lo:hi])) for bucket, lo, hi in cuts]
        burnt = np.bincount(at, new, len(context))
        out += [(part, None, _HOT_TABLES, int(context[k]), None, float(burnt[k])) for k in np.flatnonzero(burning).tolist()]
        yield _row_batch(out)

    return of_part


def _once(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The value of each group, which all its members have."""
    out = np.zeros(n)
    out[at] = values
    return out


def _score(n_training: int, vocabulary: int, discount: float, hot: np.ndarray, hot_tables: np.ndarray, hot_customers: np.ndarray, coded: np.ndarray, buckets: int, p_roots: list):
    """For each group its names, and sums by document of its tokens in the part: known words, base and score, the latter negative and in whole steps."""
    samples = len(p_roots)

    def of_part(part, rows):
        out = [(None, None, _NAMES, group, body) for group, body in zip(*_of_kind(rows, _NAMES, "n"))]
        groups, bodies = _of_kind(rows, _ENTRIES, "n")
        if groups:
            *given, tokens, doc, sizes = _joined(bodies, 9)
            ends = [0, *np.cumsum(sizes.astype(np.int64)).tolist()]
            e = Entries(*given, coded)
            words, at = np.unique(e.w, return_inverse=True)
            order, _ = _bucket_order(words, buckets)
            told = _joined(_of_kind(rows, _REPLY, "bucket")[1], 1 + 2 * samples)
            c, p = np.empty(len(words)), np.empty(len(words))
            c[order], p[order] = told[0], sum(p_root(*told[1 + 2 * k : 3 + 2 * k]) / samples for k, p_root in enumerate(p_roots))
            c, p0 = c[at], p[at]
            tables = np.minimum(e.n, 1).astype(np.float64)
            # the same entries in the same order
            tables[e.many] = unpack(_of_kind(rows, _STATE, "n")[1][0])[4] / samples
            total, customers = e.totals(tables), e.totals(e.n)
            burning = np.isin(e.context, hot)
            place = np.searchsorted(hot, e.context[burning])
            total[burning], customers[burning] = hot_tables[place], hot_customers[place]
            p = predictive(e.n, tables, discount, STRENGTH[1], total[e.at], customers[e.at], p0)
            values = [(c > 0).astype(np.float64), -np.log10((c + 1) / (n_training + vocabulary + 1)) / _STEP, -np.log10(p) / _STEP]
            which = np.repeat(e.of, tokens.astype(np.int64))
            for group, lo, hi in zip(groups, ends, ends[1:]):
                there, d, x = None, doc[lo:hi].astype(np.int64), which[lo:hi]
                if d.max() > 4 * len(d):
                    there, d = np.unique(d, return_inverse=True)
                counts = np.bincount(d)
                present = np.flatnonzero(counts)
                sums = [np.rint(np.maximum(np.bincount(d, y[x])[present], 0)) for y in values]
                out.append((None, None, _SUMS, group, pack(_steps(present if there is None else there), *sums)))
        yield _row_batch(out)

    return of_part


def _documents(n_training: int):
    """The documents of each group from its names and sums."""

    def of_group(group, rows):
        for body in _of_kind(rows, _NAMES, "n")[1]:
            names = np.frombuffer(body, _NAME)
            out = [np.zeros(len(names), np.int64) for _ in range(3)]
            for sums in _of_kind(rows, _SUMS, "n")[1]:
                there, *values = unpack(sums)
                there = np.cumsum(there).astype(np.int64)
                for total, x in zip(out, values):
                    total[there] += x.astype(np.int64)
            yield pa.record_batch(
                [pa.array(names["doc_id"], mask=names["nameless"]), pa.array(names["held_out"].tolist(), pa.bool_()), names["n_tokens"].astype(np.int64), out[0], np.full(len(names), n_training, np.int64), -_STEP * out[1], -_STEP * out[2]],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return of_group


def _share(one, two) -> float:
    """A discount from how many entries have one and two customers."""
    return float(min(0.95, max(0.05, one / (one + 2 * two)))) if one else 0.5


def frequent_words(words: DataFrame) -> list[int]:
    """At most CODED words, the most frequent ones, from rows (w, m): those from a sixteenth of an octave of m upwards that has room for all of them."""
    level = F.floor(16 * F.log2("m"))
    room, least = CODED, None
    for at, n in sorted(words.groupBy(level.alias("at")).agg(F.count("*")).collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, at
    return [] if least is None else [r.w for r in words.where(level >= least).select("w").collect()]


def score_texts(documents: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; `held_out` is a boolean Column over doc_id."""
    col, total = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0))
    docs = ensure_columns(documents, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", "doc_id")
    words = materialize(docs.mapInArrow(_word_rows, "w long, n long, m long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "words")
    n_training, vocabulary, tokens, names = words.agg(total("n"), total((col("n") > 0).cast("long")), total("m"), F.count("*")).first()
    parts, buckets = max(1, -(-tokens // PART_TOKENS)), max(1, -(-names // BUCKET_WORDS))
    begin = int(BEGIN_WORD & NAME_BITS)
    coded = np.unique(np.array([begin, *frequent_words(words)], np.uint64))
    often = words.where(col("m") >= HOT_SHARE * PART_TOKENS).select("w").collect()  # fewer than tokens / (HOT_SHARE * PART_TOKENS)
    hot = np.unique(np.array([begin, *(r.w for r in often)], np.uint64))
    discard(words)

    dealt = lambda df, key, n: df.select(key, *(c for c in df.columns if c != key)).repartition(n, key).sortWithinPartitions(key)
    by_part = lambda df, of_part, tag: materialize(dealt(df, "part", parts).mapInArrow(_by_part(of_part), _ROW), tag)
    by_bucket = lambda df, of_bucket, tag: materialize(dealt(df, "bucket", buckets).mapInArrow(_by_part(of_bucket), _ROW), tag)
    of_kind = lambda df, *kinds: df.where(col("kind").isin(*kinds))
    learned = by_part(docs.mapInArrow(_entry_rows(parts, hot, coded, False), _ROW), _merge(hot, coded, buckets), "learned")
    collect_garbage(docs)
    ones, twos = of_kind(learned, _STATE).agg(total("a"), total("b")).first()
    root = by_bucket(of_kind(learned, _WORDS), _index, "root")
    single, double = of_kind(root, _WORDS).agg(total("a"), total("b")).first()
    d0, d1 = _share(single, double), _share(ones, twos)

    def by_context(rows, *columns):
        """Sums over the hot contexts, a bounded list, in its order."""
        found = {r[0]: r[1:] for r in rows.groupBy("n").agg(*(F.sum(c) for c in columns)).collect()}
        return [np.array([float(found.get(int(h), (0,) * len(columns))[k]) for h in hot]) for k in range(len(columns))]

    hot_single, hot_customers = by_context(of_kind(learned, _HOT), "a", "b")
    # at first every dish has one table in every restaurant that serves it
    state, rows = learned, root
    (hot_moving,) = by_context(of_kind(learned, _HOT_TABLES), "a")
    root_tables, kept_tables, samples, p_roots, kept = float(vocabulary), np.zeros(len(hot)), SWEEPS - BURN_IN, [], []
    for k in range(SWEEPS + 1):
        for before in kept if k == SWEEPS else []:
            rows = rows.unionByName(of_kind(before, _SEATED))
        seated = by_bucket(rows, _root(k, (STRENGTH[0] + d0 * root_tables) / (vocabulary + 1), d0), "root-seated")
        root_customers, root_tables = (float(x) for x in of_kind(seated, _SEATED).agg(total("a"), total("b")).first())
        p_root = partial(_root_probability, discount=d0, tables=root_tables, customers=root_customers, vocabulary=vocabulary)
        if k > BURN_IN:
            p_roots.append(p_root)
            kept.append(seated)
        if k == SWEEPS:
            break
        swept = by_part(of_kind(state, _STATE).unionByName(of_kind(seated, _REPLY)), _sweep(k, k >= BURN_IN, d1, hot, hot_single + hot_moving, buckets, p_root), "swept")
        (hot_moving,) = by_context(of_kind(swept, _HOT_TABLES), "a")
        if k >= BURN_IN:
            kept_tables += (hot_single + hot_moving) / samples
        discard(state)
        if k <= BURN_IN:
            discard(seated)
        state, rows = swept, root.unionByName(of_kind(swept, _TABLES))
        collect_garbage(docs)
    asked = docs.mapInArrow(_entry_rows(parts, hot, coded, True), _ROW).unionByName(of_kind(seated, _REPLY)).unionByName(of_kind(state, _STATE))
    sums = dealt(asked, "part", parts).mapInArrow(_by_part(_score(n_training, vocabulary, d1, hot, kept_tables, hot_customers, coded, buckets, p_roots)), _ROW)
    sums = sums.select("n", "kind", "body").repartition("n").sortWithinPartitions("n")
    return sums.mapInArrow(_by_part(_documents(n_training)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _root_probability(n, t, discount: float, tables: float, customers: float, vocabulary: int):
    return predictive(n.astype(np.float64), t.astype(np.float64), discount, STRENGTH[0], tables, customers, 1 / (vocabulary + 1))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(documents, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
