"""Discrete Fourier transforms and convolutions of long series, with no task that holds a whole one.

A series is rows (series, pos, re, im), positions from 0 to n - 1; those that are not there are 0. n is factored into
classes times length: positions that are equal modulo the number of classes are transformed together, turned, and for each
frequency of the short transforms the classes are transformed across. Where n has no such factors, the transform is
written as a convolution with a chirp, padded to a power of two. All series of a call have the same n.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammolite.functions.storage import cut

#: Values that one task transforms at once, at most.
MOST = 1 << 16


def _classes(n: int, most: int) -> int | None:
    """The least number of classes, at most `most`, that divides n into lengths of at most `most`."""
    return next((r for r in range(1, most + 1) if n % r == 0 and n // r <= most), None) if n > most else 1


def _kind(x: DataFrame) -> str:
    return dict(x.dtypes)["series"]


def _rows(series, pos: np.ndarray, z: np.ndarray, kind: pa.DataType) -> pa.Table:
    return pa.table({"series": pa.array([series] * len(pos), kind), "pos": pa.array(pos.astype(np.int64)), "re": pa.array(np.ascontiguousarray(z.real)), "im": pa.array(np.ascontiguousarray(z.imag))})


def dft(x: DataFrame, n: int, inverse: bool = False, most: int = MOST) -> DataFrame:
    """(series, pos, re, im): the transform at each of the n frequencies pos / n, or its inverse."""
    x = x.select("series", F.col("pos").cast("long").alias("pos"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    kind = _kind(x)
    classes = _classes(n, most)
    if classes is None:
        return _chirp(x, n, inverse, most)
    length, sign = n // classes, 1 if inverse else -1
    transform = (lambda z, axis=-1: np.fft.ifft(z, axis=axis) * z.shape[axis]) if inverse else (lambda z, axis=-1: np.fft.fft(z, axis=axis))
    scale = 1 / n if inverse else 1.0
    width = max(1, most // classes)

    def inner(key, t):
        r = key[-1].as_py()
        z = np.zeros(length, complex)
        z[t["pos"].to_numpy() // classes] = t["re"].to_numpy() + 1j * t["im"].to_numpy()
        # the turn's exponent is taken modulo n in integers, so that long series lose no digits
        z = transform(z) * np.exp(sign * 2j * np.pi * (np.arange(length) * r % n) / n)
        parts = [z[i : i + width].tobytes() for i in range(0, length, width)]
        return pa.table({"series": pa.array([key[0].as_py()] * len(parts), t["series"].type), "part": pa.array(range(len(parts)), pa.int32()), "r": pa.array([r] * len(parts), pa.int32()), "z": pa.array(parts, pa.binary())})

    def outer(key, t):
        part = key[-1].as_py()
        at = {r: np.frombuffer(z, complex) for r, z in zip(t["r"].to_pylist(), t["z"].to_pylist())}
        zero = np.zeros_like(next(iter(at.values())))
        z = transform(np.array([at.get(r, zero) for r in range(classes)]), 0) * scale
        pos = np.arange(classes)[:, None] * length + part * width + np.arange(z.shape[1])
        return _rows(key[0].as_py(), pos.ravel(), z.ravel(), t["series"].type)

    short = x.withColumn("r", (F.col("pos") % classes).cast("int")).groupBy("series", "r").applyInArrow(inner, f"series {kind}, part int, r int, z binary")
    return short.groupBy("series", "part").applyInArrow(outer, f"series {kind}, pos long, re double, im double")


def product(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """(series, pos, re, im): values of x times those of y where `on` is equal."""
    y = y.select(*on, F.col("re").alias("re2"), F.col("im").alias("im2"))
    return x.join(y, on).select("series", "pos", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"), (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"))


def _chirp(x: DataFrame, n: int, inverse: bool, most: int) -> DataFrame:
    size = 1
    while size < 2 * n - 1:
        size *= 2
    if size > most * most:
        raise ValueError(f"{n} values are too many for pieces of {most}")
    sign = 1 if inverse else -1
    # pos squared modulo 2n, without leaving 64 bits
    angle = lambda: F.lit(sign * np.pi / n) * F.expr(f"cast((cast(pos as decimal(38, 0)) * pos) % {2 * n} as double)")
    turn = lambda s: s.select("series", "pos", *_turned(F.col("re"), F.col("im"), angle()))
    a = dft(turn(x), size, most=most)
    at = x.sparkSession.range(n).select(F.explode(F.array_distinct(F.array(F.struct("id", F.col("id").alias("to")), F.struct("id", ((size - F.col("id")) % size).alias("to"))))).alias("s")).select(F.col("s.id").alias("pos"), F.col("s.to").alias("to"))
    b = dft(at.select(F.lit(0).alias("series"), F.col("to"), F.cos(angle()).alias("re"), (-F.sin(angle())).alias("im")).withColumnRenamed("to", "pos"), size, most=most)
    c = dft(cut(product(a, b.drop("series"), ["pos"]), "chirp"), size, inverse=True, most=most).where(F.col("pos") < n)
    scale = 1 / n if inverse else 1.0
    return turn(c).select("series", "pos", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def _turned(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return (re * c - im * s).alias("re"), (re * s + im * c).alias("im")


def convolved(x: DataFrame, n: int, kernels: dict[int, np.ndarray], block: int = MOST) -> DataFrame:
    """(series, kernel, pos, re, im) at positions 0 to n - 1: sum over lags of kernel[half + lag] times the value at pos - lag.

    Kernels have odd lengths; positions outside of 0 to n - 1 may be given and count. The series is cut into blocks, to each of which
    the rows within half a kernel of it go too.
    """
    kind = _kind(x)
    half = {k: len(v) // 2 for k, v in kernels.items()}
    reach = F.element_at(F.create_map(*(F.lit(v) for kh in half.items() for v in kh)), F.col("kernel"))
    rows = x.select("series", F.col("pos").cast("long").alias("pos"), F.col("re").cast("double").alias("re"), F.explode(F.array(*map(F.lit, kernels))).alias("kernel"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("pos") - reach) / block)), F.least(F.lit((n - 1) // block), F.floor((F.col("pos") + reach) / block))
    rows = rows.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("part", F.explode(F.sequence("first", "last")))

    def run(key, t):
        series, kernel, part = (k.as_py() for k in key)
        h, w = half[kernel], kernels[kernel]
        size = min(block, n - part * block)
        z = np.zeros(size + 2 * h)
        z[t["pos"].to_numpy() - part * block + h] = t["re"].to_numpy()
        if h < 64:
            out = np.convolve(z, w, "valid")
        else:
            length = 1 << (len(z) + len(w)).bit_length()
            out = np.fft.ifft(np.fft.fft(z, length) * np.fft.fft(w, length))[2 * h : 2 * h + size]
        out = np.asarray(out, complex)
        table = _rows(series, part * block + np.arange(size), out, t["series"].type)
        return table.add_column(1, "kernel", pa.array([kernel] * size, pa.int32()))

    return rows.groupBy("series", "kernel", "part").applyInArrow(run, f"series {kind}, kernel int, pos long, re double, im double")


def filtered(x: DataFrame, n: int, response: Callable[[Column], Column], most: int = MOST) -> DataFrame:
    """(series, pos, v): the real part of the series with each frequency (cycles a sample, 0 to a half) times its response."""
    spectrum = dft(x, n, most=most)
    f = F.least(F.col("pos"), n - F.col("pos")) / n
    turned = spectrum.select("series", "pos", (F.col("re") * response(f)).alias("re"), (F.col("im") * response(f)).alias("im"))
    return dft(turned, n, inverse=True, most=most).select("series", "pos", F.col("re").alias("v"))
