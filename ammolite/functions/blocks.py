"""Symmetric matrices as blocks and thin matrices as panels, so that no task holds a whole matrix.

A matrix is a table (bi, bj, m) of square blocks, a panel a table (b, p) of rows of a thin matrix; both hold doubles as
bytes. A product joins blocks with the panel on the block's column and sums by its row. What is as wide as the panel only
(Gram matrices, means) is summed to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammolite.functions.storage import cut

SIZE = 512
#: Bytes of products that a task gathers before they leave.
HELD = 8_000_000


def blocked(entries: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """Blocks of a symmetric matrix of n rows, from (i, j, v) with i < j or i = j, numbered from 0; what is not there is 0."""
    both = entries.unionByName(entries.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    both = both.select((F.col("i") / size).cast("int").alias("bi"), (F.col("j") / size).cast("int").alias("bj"), (F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), "v")

    def build(key, table):
        bi, bj = (k.as_py() for k in key)
        m = np.zeros((min(size, n - bi * size), min(size, n - bj * size)))
        m[table["r"].to_numpy(), table["c"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"bi": pa.array([bi], pa.int32()), "bj": pa.array([bj], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    return cut(both.groupBy("bi", "bj").applyInArrow(build, "bi int, bj int, m binary"), "blocks")


def panel(spark, n: int, width: int, make: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """A panel of n rows, made block by block from the row numbers."""

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x = np.ascontiguousarray(make(np.arange(b * size, min(n, (b + 1) * size))), np.float64)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["b", "p"])

    return cut(spark.range(-(-n // size)).mapInArrow(run, "b int, p binary"), "panel")


def _added(parts: DataFrame, key: str) -> DataFrame:
    def add(k, table):
        total = sum(np.frombuffer(x, np.float64) for x in table["p"].to_pylist())
        return pa.table({"b": pa.array([k[0].as_py()], pa.int32()), "p": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(key).applyInArrow(add, "b int, p binary")


def times(matrix: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """Matrix times panel."""

    def part(batches):
        for batch in batches:
            rows = []
            for m, p in zip(batch.column("m").to_pylist(), batch.column("p").to_pylist()):
                p = np.frombuffer(p, np.float64).reshape(-1, width)
                rows.append((np.frombuffer(m, np.float64).reshape(-1, len(p)) @ p).tobytes())
            yield pa.record_batch([batch.column("bi"), pa.array(rows, pa.binary())], names=["b", "p"])

    return cut(_added(matrix.join(x, matrix.bj == x.b).select("bi", "m", "p").mapInArrow(part, "b int, p binary"), "b"), "product")


def together(x: DataFrame, y: DataFrame, wx: int, wy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x'y, column sums of x, column sums of y), from one pass over both panels."""

    def run(batches):
        total = np.zeros((wx + 1, wy + 1))
        for batch in batches:
            for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist()):
                p, q = np.frombuffer(p, np.float64).reshape(-1, wx), np.frombuffer(q, np.float64).reshape(-1, wy)
                total += np.vstack([p.T, np.ones(len(p))]) @ np.hstack([q, np.ones((len(q), 1))])
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    found = x.join(y.withColumnRenamed("p", "q"), "b").select("p", "q").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros((wx + 1, wy + 1))
    for k, v in found.collect():
        total[k // (wy + 1), k % (wy + 1)] = v
    return total[:wx, :wy], total[:wx, wy], total[wx, :wy]


def mapped(x: DataFrame, width: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The panel whose blocks are f of x's blocks."""

    def run(batches):
        for batch in batches:
            rows = [np.ascontiguousarray(f(np.frombuffer(p, np.float64).reshape(-1, width)), np.float64).tobytes() for p in batch.column("p").to_pylist()]
            yield pa.record_batch([batch.column("b"), pa.array(rows, pa.binary())], names=["b", "p"])

    return x.mapInArrow(run, "b int, p binary")


def scattered(entries: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks (bi, bj, m) of a sparse matrix of any shape from (i, j, v), each the places and values of what is there."""
    at = entries.select((F.col("i") / size).cast("int").alias("bi"), (F.col("j") / size).cast("int").alias("bj"), (F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), F.col("v").cast("double").alias("v"))

    def build(key, table):
        m = b"".join(table[k].to_numpy().astype(t).tobytes() for k, t in (("v", np.float64), ("r", np.int32), ("c", np.int32)))
        return pa.table({"bi": pa.array([key[0].as_py()], pa.int32()), "bj": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([m], pa.binary())})

    return cut(at.groupBy("bi", "bj").applyInArrow(build, "bi int, bj int, m binary"), "scattered")


def times_scattered(matrix: DataFrame, x: DataFrame, width: int, rows: int, flipped: bool = False, size: int = SIZE) -> DataFrame:
    """Sparse matrix of that many rows times panel, or its transpose (of that many rows) if flipped; rows without entries are in no block, or 0."""
    own, other = ("bj", "bi") if flipped else ("bi", "bj")

    def part(batches):
        # rows are read where Arrow holds them, products of one block are added before they leave, and leave a few at a time
        held: dict[int, np.ndarray] = {}

        def gathered():
            out = pa.record_batch([pa.array(list(held), pa.int32()), pa.array([y.tobytes() for y in held.values()], pa.binary())], names=["b", "p"])
            held.clear()
            return out

        for batch in batches:
            own_, m_, p_ = (batch.column(c) for c in (own, "m", "p"))
            for k in range(batch.num_rows):
                b, m, p = own_[k].as_py(), m_[k].as_buffer(), p_[k].as_buffer()
                count = m.size // 16
                v, places = np.frombuffer(m, np.float64, count), np.frombuffer(m, np.int32, 2 * count, 8 * count).reshape(2, count)
                to, of = places[::-1] if flipped else places
                if b not in held:
                    if sum(y.nbytes for y in held.values()) >= HELD:
                        yield gathered()
                    held[b] = np.zeros((min(size, rows - b * size), width))
                x_ = np.frombuffer(p, np.float64).reshape(-1, width)
                for lo in range(0, count, size * 16):
                    t = slice(lo, lo + size * 16)
                    np.add.at(held[b], to[t], v[t, None] * x_[of[t]])
        if held:
            yield gathered()

    return cut(_added(matrix.join(x, matrix[other] == x.b).select(own, "m", "p").mapInArrow(part, "b int, p binary"), "b"), "product")


def largest(matrix: DataFrame, n: int, width: int, wanted: int, centred: bool = False, factor: float = 1.0, shift: float = 0.0, size: int = SIZE, rounds: int = 100, product: Callable[[DataFrame], DataFrame] | None = None) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues (descending) and vectors (a panel) within the subspace that `width` columns span when they are multiplied again and again.

    The matrix is `factor` times the given one plus `shift`, before and after which columns are centred if asked for.
    Rounds end when the `wanted` eigenvalues of largest size no longer change; those are then the matrix's own.
    `product` multiplies a panel where the symmetric matrix is not held as blocks.
    """
    spark = matrix.sparkSession

    def start(rows: np.ndarray) -> np.ndarray:
        # any fixed numbers that no eigenvector is likely to be at right angles to
        mixed = (rows[:, None].astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(width, dtype=np.uint64) + 1) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5

    x, old = panel(spark, n, width, start, size), None
    values = np.zeros(width)
    for _ in range(rounds):
        gram, sums, _ = together(x, x, width, width)
        mean = sums / n if centred else np.zeros(width)
        gram = gram - n * np.outer(mean, mean)
        # orthonormal columns; directions that are gone are replaced by nothing: their columns stay zero
        e, u = np.linalg.eigh((gram + gram.T) / 2)
        keep = e > max(e.max(), 1e-300) * 1e-13
        turn = np.where(keep, u / np.sqrt(np.where(keep, e, 1.0)), 0.0)
        x = cut(mapped(x, width, lambda p, mean=mean, turn=turn: (p - mean) @ turn), "panel")
        basis, y = x, product(x) if product else times(matrix, x, width)
        inner, _, sums = together(x, y, width, width)
        # x's columns are centred, so centring y changes nothing in the projection
        projected = factor * (inner + inner.T) / 2 + shift * np.diag((turn != 0).any(0).astype(float))
        values, turn = np.linalg.eigh(projected)
        order = np.argsort(-np.abs(values))[:wanted]
        now = np.sort(values[order])
        if old is not None and np.abs(now - old).max() <= 1e-13 * max(1e-300, np.abs(values).max()):
            vectors = cut(mapped(x, width, lambda p, turn=turn[:, ::-1]: p @ turn), "vectors")
            return values[::-1], vectors
        old, mean = now, (sums / n if centred else np.zeros(width))
        if shift:
            z = x.join(y.withColumnRenamed("p", "q"), "b")

            def both(batches, mean=mean):
                for batch in batches:
                    rows = [(factor * (np.frombuffer(q, np.float64).reshape(-1, width) - mean) + shift * np.frombuffer(p, np.float64).reshape(-1, width)).tobytes() for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())]
                    yield pa.record_batch([batch.column("b"), pa.array(rows, pa.binary())], names=["b", "p"])

            x = cut(z.select("b", "p", "q").mapInArrow(both, "b int, p binary"), "panel")
        else:
            x = y
    return values[::-1], cut(mapped(basis, width, lambda p, turn=turn[:, ::-1]: p @ turn), "vectors")
