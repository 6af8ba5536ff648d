"""Landmark shapes: superimposition of all specimens on their mean, and thin-plate splines from one shape to many.

A specimen is a row (specimen, shape): the coordinates of its landmarks one after the other, all specimens of the same number. What
is as large as one shape (means, the spline's matrix) goes to every task; specimens never meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammolite.functions.storage import cut


def configurations(df: DataFrame, specimen: str, landmark: str, *axes: str | Column) -> DataFrame:
    """(specimen, shape) from rows of one landmark each, in the order of `landmark`; specimens with a missing coordinate are left out."""
    at = F.struct(F.col(landmark).alias("l"), *((F.col(a) if isinstance(a, str) else a).cast("double").alias(f"x{k}") for k, a in enumerate(axes)))
    rows = df.groupBy(F.col(specimen).alias("specimen")).agg(F.sort_array(F.collect_list(at)).alias("s"))
    shape = F.flatten(F.transform("s", lambda s: F.array(*(s[f"x{k}"] for k in range(len(axes))))))
    return rows.select("specimen", shape.alias("shape")).where(~F.exists("shape", lambda v: v.isNull() | F.isnan(v)))


def _mapped(x: DataFrame, f, dims: int, *added: str) -> DataFrame:
    """Rows of specimens whose shapes, as an array (specimens, landmarks, dims), are f of the given ones; `added` names further results of f."""
    carried = [c for c in x.columns if c != "shape" and c not in added]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column("shape")
            s = flat.flatten().to_numpy().reshape(len(batch), -1, dims)
            out = f(s)
            s, more = (out[0], out[1:]) if added else (out, ())
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s[0].size, pa.int32()), pa.array(np.ascontiguousarray(s).ravel()))
            yield pa.record_batch([*(batch.column(c) for c in carried), *map(pa.array, more), shapes], names=[*carried, *added, "shape"])

    kinds = dict(x.dtypes)
    return x.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"{a} double" for a in added), "shape array<double>"]))


def _total(x: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(specimens, sum of their shapes), added up in tasks first."""

    def run(batches):
        n, total = 0, np.zeros(size)
        for batch in batches:
            n, total = n + len(batch), total + batch.column("shape").flatten().to_numpy().reshape(len(batch), -1).sum(0)
        yield pa.record_batch([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    parts = x.select("shape").mapInArrow(run, "n long, total array<double>")
    found = parts.select(F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("n").cast("double").alias("v"))), F.transform("total", lambda v, k: F.struct(k.cast("int").alias("k"), v.alias("v")))))).groupBy("col.k").agg(F.sum("col.v").alias("v")).collect()
    sums = {r.k: r.v for r in found}
    return int(sums.pop(-1, 0)), np.array([sums.get(k, 0.0) for k in range(size)])


def rotations(target: np.ndarray, s: np.ndarray, reflect: bool) -> np.ndarray:
    """The rotation of each of the shapes s that brings it nearest to its target, to be multiplied from the right."""
    u, _, v = np.linalg.svd(np.einsum("nki,nkj->nij", s, np.broadcast_to(target, s.shape)))
    if not reflect:
        u[:, :, -1] *= np.sign(np.linalg.det(u) * np.linalg.det(v))[:, None]
    return u @ v


def procrustes(x: DataFrame, dims: int = 2, iterations: int = 100, tolerance: float = 1e-10, reflect: bool = False) -> tuple[DataFrame, np.ndarray, dict]:
    """(aligned (specimen, size, distance, shape), consensus (landmarks, dims), fit (iterations, converged, sse)).

    Every specimen is centred, scaled to unit centroid size and, round by round, rotated to the mean of all others; rounds end when
    the sum of squared distances to the mean falls by no more than `tolerance`. `size` is the centroid size, `distance` that to the consensus. A specimen whose
    landmarks coincide is an error. No specimens give no rows.
    """
    first = x.select(F.size("shape").alias("n")).first()
    size = first.n if first else dims

    def scaled(s: np.ndarray):
        s = s - s.mean(1, keepdims=True)
        norm = np.sqrt((s * s).sum((1, 2)))
        if (norm <= np.finfo(float).eps).any():
            raise ValueError("a specimen's landmarks coincide")
        return s / norm[:, None, None], norm

    now = cut(_mapped(x.select("specimen", "shape"), scaled, dims, "size"), "shapes")
    n, total = _total(now, size)
    before, sse, done, converged = math.inf, 0.0, 0, False
    for done in range(1, iterations + 1):

        def turned(s: np.ndarray, total=total.reshape(-1, dims)):
            target = (total - s) / (n - 1) if n > 1 else s
            return s @ rotations(target, s, reflect)

        now = cut(_mapped(now, turned, dims), "shapes")
        n, total = _total(now, size)
        # shapes are of unit size, so their squared distances to the mean add up to n less n times its square
        mean = total / max(1, n)
        sse = max(0.0, n - n * float(mean @ mean))
        if 0 <= before - sse <= tolerance:
            converged = True
            break
        before = sse
    consensus = (total / max(1, n)).reshape(-1, dims)
    gap = F.sqrt(F.aggregate(F.zip_with("shape", F.array(*map(F.lit, consensus.ravel().tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return now.select("specimen", "size", gap.alias("distance"), "shape"), consensus, {"iterations": done, "converged": converged, "sse": sse}


def kernel(d: np.ndarray, dims: int) -> np.ndarray:
    """r^2 log r in the plane, r in space; 0 where points coincide."""
    return np.where(d > 0, d * d * np.log(np.where(d > 0, d, 1.0)), 0.0) if dims == 2 else d


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def spline_system(source: np.ndarray) -> np.ndarray:
    """The inverse of the spline's matrix for a source shape (landmarks, dims): solved once for all targets."""
    k, dims = source.shape
    p = np.hstack([np.ones((k, 1)), source])
    top = np.hstack([kernel(_distances(source, source), dims), p])
    full = np.vstack([top, np.hstack([p.T, np.zeros((dims + 1, dims + 1))])])
    return np.linalg.pinv(full) if np.linalg.matrix_rank(full) < len(full) else np.linalg.inv(full)


def thin_plate_splines(x: DataFrame, source: np.ndarray, points: np.ndarray | None = None) -> DataFrame:
    """(specimen, energy, shape): bending energy of the spline from `source` to each specimen, and where it takes `points` (by default the source's landmarks)."""
    k, dims = source.shape
    inverse = spline_system(source)
    points = source if points is None else np.asarray(points, float)
    basis = np.hstack([kernel(_distances(points, source), dims), np.ones((len(points), 1)), points])
    bend = kernel(_distances(source, source), dims)

    def run(s: np.ndarray):
        w = np.einsum("ab,nbd->nad", inverse[:, :k], s)
        return np.einsum("pa,nad->npd", basis, w), np.einsum("nkd,kj,njd->n", w[:, :k], bend, w[:, :k])

    return _mapped(x.select("specimen", "shape"), run, dims, "energy")


def grid(source: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Points over the source's box and a tenth of its longer side around it, row by row; in space at middle depth."""
    lo, hi = source.min(0), source.max(0)
    margin = 0.1 * (hi - lo).max()
    xx, yy = np.meshgrid(np.linspace(lo[0] - margin, hi[0] + margin, columns), np.linspace(lo[1] - margin, hi[1] + margin, rows))
    flat = [xx.ravel(), yy.ravel()]
    return np.column_stack([*flat, *([np.full(xx.size, (lo[2] + hi[2]) / 2)] if source.shape[1] == 3 else [])])


def relative_warps(aligned: DataFrame, consensus: np.ndarray, count: int = 2, alpha: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(warps (warp, value, share), scores (specimen, warp, score)) of aligned shapes about their consensus.

    Deviations are weighted by the bending energy to the power -alpha / 2 (0: all scales alike) within the space that bends; what is decomposed is as wide
    as a shape has coordinates. Signs: the largest score of a warp is positive.
    """
    k, dims = consensus.shape
    bending = spline_system(consensus)[:k, :k]
    values, vectors = np.linalg.eigh((bending + bending.T) / 2)
    keep = values > values.max() * 1e-9
    weight = vectors[:, keep] * values[keep] ** (-alpha / 2) if alpha else np.eye(k)

    def deviations(s: np.ndarray) -> np.ndarray:
        return np.einsum("ka,nkd->nad", weight, s - consensus).reshape(len(s), -1)

    width = weight.shape[1] * dims

    def run(batches):
        total = np.zeros((width, width))
        n = 0
        for batch in batches:
            d = deviations(batch.column("shape").flatten().to_numpy().reshape(len(batch), k, dims))
            total, n = total + d.T @ d, n + len(d)
        yield pa.record_batch([pa.array(np.arange(width * width + 1), pa.int32()), pa.array(np.append(total.ravel(), n))], names=["k", "v"])

    sums = {r.k: r.v for r in aligned.select("shape").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = sums.get(width * width, 0.0)
    cov = np.array([sums.get(i, 0.0) for i in range(width * width)]).reshape(width, width) / max(1.0, n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :count]
    spark = aligned.sparkSession
    warps = spark.createDataFrame([(i + 1, float(v), float(v / values.sum()) if values.sum() else 0.0) for i, v in enumerate(values[:count])], "warp int, value double, share double")
    scored = cut(_mapped(aligned.select("specimen", "shape"), lambda s: deviations(s) @ vectors, dims), "scores").select("specimen", F.posexplode("shape").alias("k", "score"))
    signs = scored.groupBy("k").agg(F.signum(F.max_by("score", F.round(F.abs("score"), 9))).alias("sign"))
    return warps, scored.join(F.broadcast(signs), "k").select("specimen", (F.col("k") + 1).alias("warp"), (F.col("score") * F.when(F.col("sign") < 0, -1).otherwise(1)).alias("score"))
