"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are encoded, cut into pieces of at most one sequence, and the pieces dealt into blocks of bounded size by their
row number, so that a block's problem never grows with the input. Every block is worked on by several islands, each a task
of its own. An individual is a set of bins; crossover puts whole well-filled bins of one parent into the other, drops the
bins that then hold a piece twice, and puts the displaced pieces back by best fit. After an epoch each island passes its
best individual to the next one of its block; at the end the best of the block's islands stands: that of the fewest bins,
of those that of the fullest. What the blocks left in poorly filled bins is then packed once more, in blocks of its own.

Only lengths travel between epochs. Ties are broken by piece number and all randomness is seeded by block, island and
epoch, so a task that is run again gives the same bins.

Defined results: a null text is empty and has one piece, the end id; a very long text is cut into whole sequences and a rest;
documents with a null or a repeated doc_id are packed like others, each row for itself; equal lengths go by row number; an
empty table gives no rows; columns named as those that pack() adds are replaced, any others are kept, whatever their names.
"""

from __future__ import annotations

import bisect
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.llm.common import chunk_ids, ensure_columns, materialize, release, text_blocks, tokenizer_path

CAPACITY = 2048
#: Pieces in a block, on average; the islands of a block; epochs between migrations; individuals and offspring of an island.
BLOCK, ISLANDS, EPOCHS, POPULATION, OFFSPRING = 4096, 2, 2, 6, 16
#: Bins filled less than this are taken apart and packed again together with those of other blocks.
POOR = 0.97

Bins = list[list[int]]


def _fills(lengths: list[int], bins: Bins) -> list[int]:
    at = lengths.__getitem__
    return [sum(map(at, b)) for b in bins]


def best_fit(lengths: list[int], order: list[int], bins: Bins, capacity: int, fills: list[int] | None = None) -> Bins:
    """Put the pieces of `order` into the fullest bin that takes each, or a new one. `bins`, and their sums `fills` if given, are changed in place."""
    fills = _fills(lengths, bins) if fills is None else fills
    free = sorted([(capacity - x, k) for k, x in enumerate(fills)])
    for i in order:
        at = bisect.bisect_left(free, (lengths[i], -1))
        if at == len(free):
            bins.append([i])
            fills.append(lengths[i])
            left, k = capacity - lengths[i], len(bins) - 1
        else:
            left, k = free.pop(at)
            bins[k].append(i)
            fills[k] += lengths[i]
            left -= lengths[i]
        if left:
            bisect.insort(free, (left, k))
    return bins


def fitness(lengths: list[int], bins: Bins, capacity: int, fills: list[int] | None = None) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum([(x / capacity) ** 2 for x in (_fills(lengths, bins) if fills is None else fills)])


def crossover(lengths: list[int], a: Bins, b: Bins, capacity: int, rng: random.Random, fills_a: list[int] | None = None, fills_b: list[int] | None = None, fills: list[int] | None = None) -> Bins:
    """`a`, with some well-filled bins of `b` put in whole. Sums of bins that are known need not be made; the child's are added to `fills`."""
    fills_a, fills_b, fills = (_fills(lengths, a) if fills_a is None else fills_a), (_fills(lengths, b) if fills_b is None else fills_b), [] if fills is None else fills
    pool = sorted(range(len(b)), key=fills_b.__getitem__, reverse=True)[: max(1, len(b) // 2)]
    chosen = sorted(rng.sample(pool, max(1, len(pool) // 3)))
    injected = [list(b[k]) for k in chosen]
    fills += [fills_b[k] for k in chosen]
    taken = {i for bin_ in injected for i in bin_}
    kept, displaced = injected, []
    for bin_, filled in zip(a, fills_a):
        if taken.isdisjoint(bin_):
            kept.append(list(bin_))
            fills.append(filled)
        else:
            displaced += [i for i in bin_ if i not in taken]
    return best_fit(lengths, sorted(displaced, key=lambda i: (-lengths[i], i)), kept, capacity, fills)


def mutate(lengths: list[int], bins: Bins, capacity: int, rng: random.Random, fills: list[int] | None = None) -> Bins:
    """Take the emptiest bins and a few others apart and best-fit their pieces. `fills`, if given, is changed in place."""
    fills = _fills(lengths, bins) if fills is None else fills
    order = sorted(range(len(bins)), key=fills.__getitem__)
    out = {*order[: max(1, len(bins) // 20)], *rng.sample(order, min(len(order), 3))}
    loose = [i for k in out for i in bins[k]]
    fills[:] = [x for k, x in enumerate(fills) if k not in out]
    return best_fit(lengths, sorted(loose, key=lambda i: (-lengths[i], rng.random())), [list(b) for k, b in enumerate(bins) if k not in out], capacity, fills)


def evolve(lengths: list[int], seeds: list[Bins], capacity: int, rng: random.Random) -> list[Bins]:
    """An island's epoch: the best individuals, best first.

    Fewest bins are not the end: fuller bins leave the free places in fewer ones, which are packed again with those of
    other blocks. Only where every bin is full can nothing be gained.
    """
    people = [(list(x), _fills(lengths, x)) for x in seeds]
    while len(people) < POPULATION:
        noise = 0 if not people else 0.075 * len(people)
        order = sorted(range(len(lengths)), key=[-x * (1 + noise * rng.random()) for x in lengths].__getitem__)
        fills: list[int] = []
        people.append((best_fit(lengths, order, [], capacity, fills), fills))
    # scores and sums are kept beside the individuals: they cost as much as a crossover
    scored = sorted(((fitness(lengths, x, capacity, y), x, y) for x, y in people), key=lambda x: x[0], reverse=True)
    total = sum(lengths)
    for _ in range(OFFSPRING):
        if len(scored[0][1]) * capacity == total:
            break
        (_, a, fills_a), (_, b, fills_b), fills = scored[0], scored[1 + rng.randrange(len(scored) - 1)], []
        child = crossover(lengths, a, b, capacity, rng, fills_a, fills_b, fills)
        child = mutate(lengths, child, capacity, rng, fills)
        scored = sorted([*scored, (fitness(lengths, child, capacity, fills), child, fills)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [x for _, x, _ in scored]


def tokenize_pieces(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text (null: empty)."""

    def cut(batches):
        coder, end = chunk_ids(tokenizer, keep_space=False), struct.pack("<I", end_id)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in text_blocks(texts, 16_000_000):
                rows = []
                for key, raw in zip(keys[lo:hi], coder.batch(texts[lo:hi])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return ensure_columns(documents, doc_id="long", text="string").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_STATE = "block long, island int, lengths binary, rows binary, bins binary"


def _flat(bins: Bins) -> bytes:
    """A bin for each piece, as bytes."""
    return np.concatenate([np.array([len(bins)], "<i4"), np.array([len(b) for b in bins], "<i4"), np.array([i for b in bins for i in b], "<i4")]).tobytes()


def _bins(raw: bytes) -> Bins:
    x = np.frombuffer(raw, "<i4")
    ends = np.cumsum(x[1 : 1 + x[0]])
    return [p.tolist() for p in np.split(x[1 + x[0] :], ends[:-1])] if x[0] else []


def _evolve_states(epoch: int, capacity: int):
    def run(batches):
        for b in batches:
            out = []
            for block, island, lengths, rows, elites in zip(*(b.column(i).to_pylist() for i in range(5))):
                sizes = np.frombuffer(lengths, "<i4").tolist()
                seeds = [_bins(x) for x in elites if x]
                best = evolve(sizes, seeds, capacity, random.Random(f"{block}/{island}/{epoch}"))[0]
                out.append((block, island, lengths, rows, _flat(best), len(best), -fitness(sizes, best, capacity)[1]))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "island", "lengths", "rows", "bins", "n_bins", "slack"])

    return run


def pack_blocks(pieces: DataFrame, blocks: int, capacity: int = CAPACITY) -> DataFrame:
    """row, bin, offset, filled and block for pieces (row, length), each block packed on its own."""
    n_tasks = min(2000, max(1, blocks * ISLANDS))
    # a row's block is fixed by its number alone, so a block holds as many pieces whatever their documents
    dealt = pieces.groupBy((F.pmod(F.xxhash64("row"), F.lit(blocks))).alias("block"))
    listed = dealt.agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("x"))

    def pack_bytes(batches):
        for b in batches:
            rows, lengths = [], []
            for x in b.column(1).to_pylist():
                rows.append(np.array([y["row"] for y in x], "<i8").tobytes())
                lengths.append(np.array([y["length"] for y in x], "<i4").tobytes())
            yield pa.record_batch([b.column(0), pa.array(lengths, pa.binary()), pa.array(rows, pa.binary())], names=["block", "lengths", "rows"])

    state = listed.mapInArrow(pack_bytes, "block long, lengths binary, rows binary")
    state = state.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "lengths", "rows", F.array().cast("array<binary>").alias("elites"))
    for epoch in range(EPOCHS):
        state = state.repartition(n_tasks, "block", "island").mapInArrow(_evolve_states(epoch, capacity), "block long, island int, lengths binary, rows binary, bins binary, n_bins long, slack double")
        state = materialize(state, "packing-epoch")
        if epoch + 1 < EPOCHS:
            # elite migration: an island goes on with its own best and the best of the island before it
            sent = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("guest"))
            state = state.join(sent, ["block", "island"], "left").select("block", "island", "lengths", "rows", F.array("bins", "guest").alias("elites"))
    best = state.groupBy("block").agg(F.min_by(F.struct("lengths", "rows", "bins"), F.struct("n_bins", "slack", "island")).alias("s")).select("block", "s.*")

    def place(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for block, lengths, rows, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                sizes, names = np.frombuffer(lengths, "<i4"), np.frombuffer(rows, "<i8")
                for k, members in enumerate(_bins(raw)):
                    held = sizes[members]
                    ends = np.cumsum(held)
                    for column, values in zip(out, (names[members], np.full(len(members), k), ends - held, np.full(len(members), ends[-1]), np.full(len(members), block))):
                        column.append(values)
            yield pa.record_batch([pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for c in out], names=["row", "bin", "offset", "filled", "block"])

    return best.mapInArrow(place, "row long, bin long, offset long, filled long, block long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """`pieces` with sequence_id and offset. Needs a column length, at most `capacity` and at least 1; any other columns are kept.

    An empty table gives no rows. Repeated rows are pieces of their own.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    given = materialize(pieces.select(F.struct(*kept).alias("piece"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    full = given.where(F.col("length") >= capacity).select("row", (F.col("row") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = given.where(F.col("length") < capacity).select("row", "length")
    first = materialize(pack_blocks(short, max(1, -(-short.count() // block)), capacity).join(short, "row"), "packed")
    loose = first.where(F.col("filled") < POOR * capacity)
    second = pack_blocks(loose.select("row", "length"), max(1, -(-loose.count() // block)), capacity)
    number = lambda kind: ((F.col("block") * (1 << 24) + F.col("bin")) * 4 + kind).alias("sequence_id")
    placed = full.unionByName(first.where(F.col("filled") >= POOR * capacity).select("row", number(1), "offset")).unionByName(second.select("row", number(2), "offset"))
    return given.select("row", "piece").join(placed, "row").select("piece.*", "sequence_id", "offset")


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenize_pieces(documents, tokenizer_path("word_bpe_49k.json")))
