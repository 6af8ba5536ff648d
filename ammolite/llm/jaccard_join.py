"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more, by signature trees.

Documents with the same set are one class; classes are joined. Two similar classes share one of their first
n - ceil(0.75 n) + 1 tokens in any order common to all, so classes are dealt to tokens of that prefix. With a prefix longer by
extra(n) tokens they share as many more, so only classes go on that have enough tokens there which two classes hold. The
order puts tokens that very many documents hold last: a passage or licence that a third of the table repeats makes no
bucket, unless documents consist of it.

First each class is only compared with its neighbours and the first class of its bucket in a few buckets, which connects
groups of copies without pairing them all. Then come the buckets in which classes of different components meet. Those with
the same smallest component are a family, and a task gets a family's buckets and the signatures of its classes, each once.
In a bucket a signature tree is built: leaves hold the bitmap of a class's tokens, inner nodes the OR of theirs with the range
of their sizes and of the components they belong to. A dual traversal starts from (root, root) and drops every pair of
nodes whose sizes are too far apart, whose bitmaps leave too little overlap, or whose classes are already connected. Classes
that are in a remaining pair get their whole sets, and the same traversal over them verifies pairs: each link that it finds
connects its classes at once, so a task returns fewer links than it has classes. The classes of a family too large for a
task are dealt to blocks, and every pair of blocks is a task. What is verified, together with what is connected, leaves out no link between components, so components
are exact.

Shingles are 64-bit hashes. Defined results: null, empty and blank texts have no shingles and are components of their own;
texts of fewer than five words have one, whatever their length; very long texts count whole; texts at exactly 0.75 are
linked; repeated rows have the same set and so one component, and each keeps its row; a null doc_id never gives a
component its name unless all of its documents are nameless; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import WordBlock, discard, ensure_columns, gram_hashes, in_bitmap, key_bitmap, materialize, mix, runs, signed, word_blocks

GRAM = 5
#: A token counts as frequent when tasks that hold it at least LOCAL times hold it FREQUENT times together.
LOCAL, FREQUENT = 8, 64
#: Buckets in which a class is compared with its neighbours in the first run.
FIRST_BUCKETS = 4
#: Tokens by which a prefix is longer, at least and by share of its set: they spare classes that share a few by chance.
EXTRA, EXTRA_SHARE = 7, 12
#: Bits of a signature for each token, at least: of those that are sent, and where the sets are at hand.
SIGNATURE_BITS, FINE_BITS = 4, 16
#: Classes in a leaf, nodes below a node; pairs of nodes that are looked at together.
LEAF, FANOUT, FRONTIER = 32, 4, 1_000_000
#: Rows, and bytes of sets, of a block of a family's classes; two blocks are a task.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 16_000_000


def extra(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(EXTRA, sizes // EXTRA_SHARE)


def partnered(sizes: np.ndarray) -> np.ndarray:
    """Tokens in its longer prefix that a class shares with any similar class, at least; that may be as small as 0.75 n."""
    least = -(-3 * sizes // 4)
    return np.minimum(least, 1 + extra(least))


class Sets:
    """The sorted distinct shingle hashes of every text of a block, end to end: text k has tokens[ends[k] - sizes[k] : ends[k]]."""

    def __init__(self, block: WordBlock):
        first = np.cumsum(block.counts) - block.counts
        long = np.maximum(block.counts - GRAM + 1, 0)
        grams = gram_hashes(block.hashes, GRAM, salt=GRAM)[runs(long, first)]
        sets, at = [], 0
        for k, n in enumerate(long.tolist()):
            c = int(block.counts[k])
            x = grams[at : at + n] if n or not c else gram_hashes(block.hashes[first[k] : first[k] + c], c, salt=c)
            at += n
            if len(x) > 1:
                x = np.sort(x)
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            sets.append(x)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.tokens ^ np.uint64(0x5851F42D4C957F2D)))))
        #: A hash of each set.
        self.classes = signed(mix(sums[self.ends] - sums[self.ends - self.sizes] + self.sizes.astype(np.uint64)))

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.ends[k] - self.sizes[k] : self.ends[k]]

    def prefixes(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, text of each, whether it makes buckets): the first n - ceil(0.75 n) + 1 + extra(n) of each set, frequent ones last; the extra ones make no buckets."""
        late = in_bitmap(frequent, self.tokens)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((late, text)) if late.any() else np.arange(len(text))  # stable: hashes stay in order
        least = np.where(self.sizes > 0, self.sizes - -(-3 * self.sizes // 4) + 1, 0)
        wanted = np.minimum(self.sizes, least + extra(self.sizes))
        place = runs(wanted, self.ends - self.sizes)
        at = order[place]
        return self.tokens[at], text[at], (place - (self.ends - self.sizes)[text[at]]) < least[text[at]]


def _sets(batches):
    """(doc_id column, Sets) of blocks of texts."""
    for b in batches:
        for lo, hi, block in word_blocks(b.column(1), lower=True, most=2_000_000):
            yield b.column(0).slice(lo, hi - lo), Sets(block)


def signature(tokens: np.ndarray, each: int) -> bytes:
    """A bitmap of at least so many bits for each token, a power of two."""
    bits = 64
    while bits < each * len(tokens):
        bits *= 2
    held = np.zeros(bits, bool)
    held[((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def required(sizes: np.ndarray) -> np.ndarray:
    """Overlap that two sets of so many tokens together need: ceil(3 / 7 of the sum)."""
    return -(-3 * sizes // 7)


class SignatureTree:
    """Nodes by level, leaves first: OR-combined bitmaps, size ranges, component ranges, and the most tokens that share a bit with others."""

    def __init__(self, order: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, components: np.ndarray):
        self.order = order
        slack = sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.levels = [(bitmaps[order], sizes[order], sizes[order], components[order], components[order], slack[order])]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, c_lo, c_hi, s = self.levels[-1]
            cut = np.arange(0, len(lo), width)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(c_lo, cut), np.maximum.reduceat(c_hi, cut), np.maximum.reduceat(s, cut)))
            width = FANOUT

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of each node."""
        width = LEAF if level == 1 else FANOUT
        first = nodes * width
        return first, np.minimum(width, len(self.levels[level - 1][0]) - first)


def _possible(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a similar pair of classes of different components."""
    bx, lo_x, hi_x, cl_x, ch_x, s_x = x
    by, lo_y, hi_y, cl_y, ch_y, s_y = y
    ok = (4 * hi_x[i] >= 3 * lo_y[j]) & (4 * hi_y[j] >= 3 * lo_x[i]) & ~((cl_x[i] == ch_y[j]) & (ch_x[i] == cl_y[j]))
    at = np.flatnonzero(ok)
    for part in np.array_split(at, max(1, len(at) * bx.shape[1] // 2_000_000)):
        both = np.bitwise_count(bx[i[part]] & by[j[part]]).sum(1).astype(np.int64)
        most = np.minimum(both + np.minimum(s_x[i[part]], s_y[j[part]]), np.minimum(hi_x[i[part]], hi_y[j[part]]))
        ok[part] = most >= required(lo_x[i[part]] + lo_y[j[part]])
    return ok


def traverse(a: SignatureTree, b: SignatureTree):
    """Positions (in a, in b) of class pairs that no bound excludes, some at a time; with a is b each pair once."""
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        keep = _possible(a.levels[la], b.levels[lb], i, j)
        i, j = i[keep], j[keep]
        if la == lb == 0:
            if a is b:
                keep = i < j
                i, j = i[keep], j[keep]
            yield a.order[i], b.order[j]
            continue
        if len(i) * LEAF * LEAF > FRONTIER and len(i) > 1:  # what this many pairs of nodes lead to: a part at a time
            width = max(1, FRONTIER // (LEAF * LEAF))
            parts = [(i[lo : lo + width], j[lo : lo + width]) for lo in range(0, len(i), width)]
        else:
            parts = [(i, j)]
        for i, j in reversed(parts):
            ka, kb = la, lb
            if la >= lb and la:
                first, n = a.children(la, i)
                j = np.repeat(j, n)
                i = runs(n, first)
                ka -= 1
            if lb >= la and lb:
                first, n = b.children(lb, j)
                i = np.repeat(i, n)
                j = runs(n, first)
                kb -= 1
            if a is b:
                keep = i <= j
                i, j = i[keep], j[keep]
            if len(i):
                todo.append((ka, kb, i, j))


class Family:
    """The classes of a task: signatures, what is connected, and which are in a pair that no bound excludes."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray, marks: list[bytes], components: np.ndarray):
        self.classes, self.sizes, self.marks = classes, sizes, marks
        self.width = np.array([len(x) for x in marks], np.int64)
        self.labels = np.unique(components, return_inverse=True)[1]
        self.involved = np.zeros(len(classes), bool)

    def found(self, i: np.ndarray, j: np.ndarray) -> None:
        self.involved[i] = self.involved[j] = True

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.labels[i] != self.labels[j]

    def small(self, i: np.ndarray, j: np.ndarray) -> None:
        """The pairs of small buckets."""
        ok = self.apart(i, j) & (4 * self.sizes[i] >= 3 * self.sizes[j]) & (4 * self.sizes[j] >= 3 * self.sizes[i])
        low, high = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
        key, n = np.unique(low * len(self.classes) + high), max(1, len(self.classes))
        i, j = key // n, key % n
        ok = _signatures_allow(self.sizes[i], [self.marks[k] for k in i.tolist()], self.sizes[j], [self.marks[k] for k in j.tolist()])
        self.found(i[ok], j[ok])

    def tree(self, members: np.ndarray, bits: int) -> SignatureTree:
        rows = [np.frombuffer(self.marks[m], np.uint64) for m in members.tolist()]
        rows = np.stack([np.bitwise_or(r[: len(r) // 2], r[len(r) // 2 :]) if 8 * len(r) > bits else r for r in rows])
        labels = self.labels[members]
        return SignatureTree(np.lexsort((self.classes[members], self.sizes[members], labels)), rows, self.sizes[members], labels)

    def bucket(self, members: np.ndarray, side: np.ndarray) -> None:
        """All pairs of `members`, or those of one of either side where there are two, that may be similar. Larger signatures are folded once."""
        two = len(members) and side.min() != side.max()
        sides = [members[side == 0], members[side == 1]] if two else [members]
        widths = [self.width[m] for m in sides]
        for w in np.unique(np.concatenate(widths)).tolist():
            here = [m[width == w] for m, width in zip(sides, widths)]
            below = [m[width == w // 2] for m, width in zip(sides, widths)]
            jobs = [(here[0], here[-1], w), (below[0], here[-1], w // 2)]
            if two:
                jobs.append((here[0], below[1], w // 2))
            for x, y, bits in jobs:
                if len(x) and len(y):
                    a = self.tree(x, bits)
                    b = a if x is y else self.tree(y, bits)
                    for i, j in traverse(a, b):
                        i, j = x[i], y[j]
                        keep = self.apart(i, j)
                        self.found(i[keep], j[keep])


class Verified(Family):
    """A family with its classes' sets: pairs that nothing connects yet are verified, and connected at once."""

    def __init__(self, classes: np.ndarray, sets: list[bytes], components: np.ndarray):
        self.sets = [np.frombuffer(x, np.uint64) for x in sets]
        super().__init__(classes, np.array([len(x) for x in self.sets], np.int64), [signature(x, FINE_BITS) for x in self.sets], components)
        self.links: list[tuple[int, int]] = []

    def found(self, i: np.ndarray, j: np.ndarray) -> None:
        labels = self.labels
        for x, y in zip(i.tolist(), j.tolist()):
            one, two = labels[x], labels[y]
            if one != two and similar(self.sets[x], self.sets[y]):
                labels[labels == two] = one
                self.links.append((int(self.classes[x]), int(self.classes[y])))


def _class_rows(batches):
    """Rows (kind, a, b, c): 0, doc_id, size, class of each document; 1, token, count, 0 of tokens frequent within a block."""
    for names, sets in _sets(batches):
        n = len(names)
        yield pa.record_batch([np.zeros(n, np.int32), names, sets.sizes, sets.classes], names=["kind", "a", "b", "c"])
        x = np.sort(sets.tokens)
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
        counts = np.diff(np.append(at, len(x)))
        often = counts >= LOCAL
        n = int(often.sum())
        if n:
            yield pa.record_batch([np.ones(n, np.int32), signed(x[at[often]]), counts[often], np.zeros(n, np.int64)], names=["kind", "a", "b", "c"])


def _prefix_rows(frequent: np.ndarray, live: np.ndarray | None):
    """(token, cls, size, core) for the prefix of every document; with `live` only for the tokens in it."""

    def run(batches):
        for _, sets in _sets(batches):
            tokens, text, core = sets.prefixes(frequent)
            if live is not None:
                keep = in_bitmap(live, tokens)
                # a class that shares too few tokens of its prefix has no partner
                keep &= (np.bincount(text[keep], minlength=len(sets.sizes)) >= partnered(sets.sizes))[text]
                tokens, text, core = tokens[keep], text[keep], core[keep]
            yield pa.record_batch([signed(tokens), sets.classes[text], sets.sizes[text], core], names=["token", "cls", "size", "core"])

    return run


def _set_rows(wanted: np.ndarray, whole: bool):
    """(cls, tokens or signature) of the classes in `wanted`, once for every task that meets them."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches):
            names, values = [], []
            for k in np.flatnonzero(in_bitmap(wanted, sets.classes.view(np.uint64)) & (sets.sizes > 0)).tolist():
                if (name := int(sets.classes[k])) not in seen:
                    seen.add(name)
                    names.append(name)
                    values.append(sets[k].tobytes() if whole else signature(sets[k], SIGNATURE_BITS))
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(values, pa.binary())], names=["cls", "v"])

    return run


def _bounded(batches):
    """Pairs (a, size_a, u, c, size_c, v) whose signatures leave enough overlap."""
    for b in batches:
        a, n, c, m = (np.asarray(b.column(x).to_numpy(zero_copy_only=False), np.int64) for x in ("a", "n", "c", "m"))
        ok = _signatures_allow(n, b.column("u").to_pylist(), m, b.column("v").to_pylist())
        yield pa.record_batch([a[ok], c[ok]], names=["a", "c"])


def _signatures_allow(n: np.ndarray, u: list[bytes], m: np.ndarray, v: list[bytes]) -> np.ndarray:
    """Whether two sets of n and m tokens can overlap enough, given their signatures: larger ones are folded to the smaller."""
    ok = (4 * n >= 3 * m) & (4 * m >= 3 * n)
    width_u, width_v = np.array([len(x) for x in u], np.int64), np.array([len(x) for x in v], np.int64)
    for w, z in {(int(width_u[k]), int(width_v[k])) for k in np.flatnonzero(ok)}:
        pick = np.flatnonzero(ok & (width_u == w) & (width_v == z))
        least = min(w, z)
        for part in np.array_split(pick, max(1, len(pick) * max(w, z) // 8_000_000)):
            x, y = (np.bitwise_or.reduce(np.frombuffer(b"".join([values[k] for k in part]), np.uint64).reshape(len(part), -1, least // 8), axis=1) for values in (u, v))
            one, two = np.bitwise_count(x & ~y).sum(1).astype(np.int64), np.bitwise_count(y & ~x).sum(1).astype(np.int64)
            ok[part] = np.minimum(n[part] - one, m[part] - two) >= required(n[part] + m[part])
    return ok


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= 75 * (len(s) + len(t) - both)


def _verify(batches):
    """Pairs (a, c) whose whole sets u and v are similar; a few hundred sets are unpacked at a time."""
    for b in batches:
        for lo in range(0, len(b), 250):
            a, c, u, v = (b.column(x).slice(lo, 250).to_pylist() for x in ("a", "c", "u", "v"))
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(u, v)]
            yield pa.record_batch([pa.array([x for x, k in zip(a, ok) if k], pa.int64()), pa.array([x for x, k in zip(c, ok) if k], pa.int64())], names=["a", "c"])


def _broadcast(spark: SparkSession, bitmap: np.ndarray):
    return spark.sparkContext.broadcast(bitmap)


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, v): the whole sets of the distinct `classes` (cls)."""
    wanted = _broadcast(docs.sparkSession, key_bitmap(classes, "cls"))
    sets = docs.mapInArrow(lambda batches: _set_rows(wanted.value, True)(batches), "cls long, v binary")
    sets = materialize(sets.join(classes, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    wanted.unpersist()
    return sets


def verified(docs: DataFrame, pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the class pairs (a, c) those that are similar: signatures (cls, size, v) exclude most others, whole sets decide."""
    one, two = marks.select(F.col("cls").alias("a"), F.col("size").alias("n"), F.col("v").alias("u")), marks.select(F.col("cls").alias("c"), F.col("size").alias("m"), "v")
    likely = materialize(pairs.join(one, "a").join(two, "c").select("a", "n", "u", "c", "m", "v").mapInArrow(_bounded, "a long, c long"), "likely-pairs")
    sets = whole_sets(docs, likely.select(F.col("a").alias("cls")).union(likely.select("c")).distinct())
    joined = likely.join(sets.select(F.col("cls").alias("a"), F.col("v").alias("u")), "a").join(sets.select(F.col("cls").alias("c"), "v"), "c")
    links = materialize(joined.select("a", "c", "u", "v").mapInArrow(_verify, "a long, c long"), "links")
    discard(likely)
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(cls, component) of every class that has a link (a, c): alternating large-star and small-star until the edges stand."""
    edges = links.select(F.greatest("a", "c").alias("x"), F.least("a", "c").alias("y")).where("x != y").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y").where("x != y").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())
        if now == before:
            return edges.select(F.col("x").alias("cls"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("cls"), F.col("y").alias("component")).distinct())
        before = now


def _neighbours(batches):
    """Pairs of each class with the one before it and the first one of its bucket; rows come sorted by token, and in a bucket by how much a class shares."""
    last = None
    for b in batches:
        token, cls, size = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(3))
        if last is not None:
            token, cls, size = np.append(last[0], token), np.append(last[1], cls), np.append(last[2], size)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        first = np.repeat(starts, np.diff(np.append(starts, len(token))))
        here = np.arange(len(token))
        pairs = np.concatenate([np.stack([here[1:] - 1, here[1:]]), np.stack([first, here])], axis=1)
        x, y = pairs[:, (token[pairs[0]] == token[pairs[1]]) & (cls[pairs[0]] != cls[pairs[1]]) & (4 * size[pairs[0]] >= 3 * size[pairs[1]]) & (4 * size[pairs[1]] >= 3 * size[pairs[0]])]
        yield pa.record_batch([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])], names=["a", "c"])
        # the next batch goes on with this bucket's first class and its last
        keep = sorted({int(first[-1]), len(token) - 1})
        last = token[keep], cls[keep], size[keep]


def _by_family(of_rows):
    """Rows come sorted by (x, part): `of_rows` gets those of whole families, or pairs of blocks of one."""

    def run(batches):
        held, key = [], None
        for b in batches:
            x, part = np.asarray(b.column(0).to_numpy(), np.int64), np.asarray(b.column(1).to_numpy(), np.int64)
            cuts = (np.flatnonzero((x[1:] != x[:-1]) | (part[1:] != part[:-1])) + 1).tolist()
            if held and len(x) and key != (x[0], part[0]):
                yield of_rows(pa.Table.from_batches(held))
                held = []
            if cuts:
                yield of_rows(pa.Table.from_batches([*held, b.slice(0, cuts[-1])]))
                held = []
            if len(x):
                held.append(b.slice(cuts[-1] if cuts else 0))
                key = x[-1], part[-1]
        if held:
            yield of_rows(pa.Table.from_batches(held))

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _involved(rows: pa.Table) -> pa.RecordBatch:
    """(x, part, side, cls, component) of the classes in pairs that the signature trees leave. Rows (x, part, side, token, cls, component, size, v):
    of each family first its classes with their signatures (token null), then the buckets. Those of no more than a leaf are trees of one node and are compared together."""
    marked = rows["token"].is_null()
    told, rows = rows.filter(marked), rows.filter(pc.invert(marked)).combine_chunks()
    classes, first = np.unique(told["cls"].to_numpy(), return_index=True)
    once = told.take(first)
    family = Family(classes, once["size"].to_numpy(), once["v"].to_pylist(), once["component"].to_numpy())
    x, part, side, token, cls = (rows[c].to_numpy() for c in ("x", "part", "side", "token", "cls"))
    at, starts = np.searchsorted(classes, cls), _starts(x, part, token)
    sizes = np.diff(np.append(starts, len(token)))
    for n in np.unique(sizes[sizes <= LEAF]).tolist():
        i, j = np.triu_indices(n, 1)
        for begin in np.array_split(starts[sizes == n], max(1, int((sizes == n).sum()) * len(i) // FRONTIER)):
            family.small(at[(begin[:, None] + i).ravel()], at[(begin[:, None] + j).ravel()])
    for begin, n in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        family.bucket(at[begin : begin + n], side[begin : begin + n])
    keep = told.filter(pa.array(family.involved[np.searchsorted(classes, told["cls"].to_numpy())])).select(["x", "part", "side", "cls", "component"])
    return pa.record_batch([c.combine_chunks() for c in keep.columns], names=keep.column_names) if len(keep) else pa.record_batch([pa.array([], f.type) for f in keep.schema], names=keep.column_names)


def _links(rows: pa.Table) -> pa.RecordBatch:
    """The links (a, c) that connect the classes of each family. Rows (x, part, side, cls, component, v)."""
    x, part, side, cls, component = (rows[c].to_numpy() for c in ("x", "part", "side", "cls", "component"))
    found = []
    starts = _starts(x, part)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
        family = Verified(cls[lo:hi], rows["v"].slice(lo, hi - lo).to_pylist(), component[lo:hi])
        family.bucket(np.arange(hi - lo), side[lo:hi])
        found += family.links
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.record_batch([pairs[:, 0], pairs[:, 1]], names=["a", "c"])


def near_duplicates(documents: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents` (doc_id, text)."""
    spark = documents.sparkSession
    docs = ensure_columns(documents, doc_id="long", text="string")
    rows = materialize(docs.mapInArrow(_class_rows, "kind int, a long, b long, c long"), "classes")
    often = rows.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = _broadcast(spark, key_bitmap(materialize(often, "frequent"), "token"))

    entry = "token long, cls long, size long, core boolean"
    shared = docs.mapInArrow(lambda batches: _prefix_rows(frequent.value, None)(batches), entry).groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x < y").select("token")
    shared = materialize(shared, "shared-tokens")
    live = _broadcast(spark, key_bitmap(shared, "token"))
    entries = docs.mapInArrow(lambda batches: _prefix_rows(frequent.value, live.value)(batches), entry).groupBy("token", "cls").agg(F.first("size").alias("size"), F.first("core").alias("core")).join(shared, "token", "left_semi")
    entries = materialize(entries, "entries")
    discard(shared)
    for bitmap in (frequent, live):
        bitmap.unpersist()

    # the original of a group of edited copies shares more of its prefix than they do, so it comes first in its buckets
    held = entries.groupBy("cls").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.when(F.col("core"), F.col("token")))), 1, FIRST_BUCKETS).alias("t"))
    least = F.ceil(F.col("size") * 3 / 4)
    held = materialize(held.where(F.col("n") >= F.least(least, 1 + F.greatest(F.lit(EXTRA), F.floor(least / EXTRA_SHARE)))), "partnered")
    wanted = _broadcast(spark, key_bitmap(held, "cls"))
    marks = docs.mapInArrow(lambda batches: _set_rows(wanted.value, False)(batches), "cls long, v binary").dropDuplicates(["cls"])
    marks = materialize(marks.join(held.select("cls", "size"), "cls").select("cls", "size", "v"), "signatures")
    wanted.unpersist()

    # first run: neighbours in the few first buckets of each class
    few = held.select(F.explode("t").alias("token"), "cls", "size", (F.col("n") / F.col("size")).alias("shared"))
    near = few.repartition("token").sortWithinPartitions("token", F.desc("shared"), "size", "cls").select("token", "cls", "size").mapInArrow(_neighbours, "a long, c long").distinct()
    links = verified(docs, near, marks)
    known = components(links)

    # second run: buckets in which components still meet; those with the same smallest component are a family
    placed = materialize(entries.where("core").join(held.select("cls"), "cls", "left_semi").join(known, "cls", "left").select("token", "cls", F.coalesce("component", "cls").alias("component")), "placed")
    discard(entries)
    meeting = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").drop("y")
    dealt = materialize(placed.join(meeting, "token"), "dealt")
    discard(placed)
    members = dealt.groupBy("x", "cls").agg(F.count("*").alias("n"), F.first("component").alias("component")).join(marks, "cls")
    large = members.groupBy("x").agg(F.ceil(F.greatest(F.sum("n") / block_rows, F.sum("size") * 8 / block_bytes)).alias("blocks"))
    large = materialize(large, "families")
    # block b of k goes to the tasks of the pairs (b, b), (b, every other): a row for each
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct((F.least(o, block) * F.col("blocks") + F.greatest(o, block)).alias("part"), (block > o).cast("int").alias("side")))
    told = members.join(large, "x").select("x", F.explode(pair).alias("p"), F.lit(None).cast("long").alias("token"), "cls", "component", "size", "v")
    buckets = dealt.join(large, "x").select("x", F.explode(pair).alias("p"), "token", "cls", "component", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("v"))
    rows_in = told.unionByName(buckets).select("x", "p.part", "p.side", "token", "cls", "component", "size", "v")
    met = rows_in.repartition("x", "part").sortWithinPartitions("x", "part", F.col("token").asc_nulls_first()).mapInArrow(_by_family(_involved), "x long, part long, side int, cls long, component long")
    met = materialize(met, "involved")
    sets = whole_sets(docs, met.select("cls").distinct())
    rows_in = met.join(sets, "cls").select("x", "part", "side", "cls", "component", "v")
    more = materialize(rows_in.repartition("x", "part").sortWithinPartitions("x", "part", "cls").mapInArrow(_by_family(_links), "a long, c long"), "more-links")
    final = components(links.unionByName(more))
    for used in (held, marks, dealt, large, met, sets):
        discard(used)

    named = rows.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("cls"))
    named = named.join(final, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component"))
    full = named.where("n_shingles > 0")
    names = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(names, "component").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id"""
