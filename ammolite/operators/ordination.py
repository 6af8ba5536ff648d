"""Ordination of samples by their distances: principal coordinates and non-metric scaling.

Distances are rows (i, j, d), one for every pair i < j of samples. Principal coordinates come from products of the squared
distances, held in blocks, with a thin panel of vectors that is centred before and after; the double-centred matrix itself is
never made. Correspondence analysis multiplies the table itself, as sparse blocks, with such a panel and back; what is expected of a
cell is taken off the panel, so empty cells are never made. Non-metric scaling has one task a restart while a distance matrix is small, and beyond that keeps
the pairs range-partitioned by distance, so that every round is a join, pooling inside ranges and pooling of what is left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ammolite.functions.blocks import SIZE, blocked, largest, mapped, scattered, times_scattered, together
from ammolite.functions.scans import numbered
from ammolite.functions.storage import cut


def indexed(pairs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(entries (i, j, v) by row number, samples (sample, place), number of samples)."""
    p = pairs.where("i != j").select("i", "j", F.col("d").cast("double").alias("d"))
    names = cut(numbered(p.select(F.col("i").alias("sample")).union(p.select(F.col("j").alias("sample"))).distinct(), "sample"), "samples")
    a, b = names.select(F.col("sample").alias("i"), F.col("place").alias("pi")), names.select(F.col("sample").alias("j"), F.col("place").alias("pj"))
    entries = p.join(a, "i").join(b, "j").select(F.least("pi", "pj").alias("i"), F.greatest("pi", "pj").alias("j"), F.col("d").alias("v"))
    return entries, names, names.count()


def pcoa(pairs: DataFrame, axes: int = 2, correction: str = "cmdscale", spare: int = 30, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Eigenvalues (axis, eigenvalue, share, share_of_trace) and coordinates (sample, axis, value) of the double-centred squared distances.

    `share` is of the sum of positive eigenvalues, known where there are at most axes + spare samples, else null;
    `share_of_trace` is of the sum of all. Axes follow signed eigenvalues; those of negative ones are 0. `correction`
    "lingoes" adds the size of the most negative eigenvalue to all but the trivial one. Signs: the largest coordinate of an axis is positive.
    Fewer than two samples give no rows.
    """
    if correction not in ("cmdscale", "none", "lingoes"):
        raise ValueError(f"unknown correction {correction!r}")
    spark = pairs.sparkSession
    entries, names, n = indexed(pairs)
    kinds = "axis int, eigenvalue double, share double, share_of_trace double"
    if n < 2:
        return spark.createDataFrame([], kinds), names.select("sample", F.lit(1).alias("axis"), F.lit(0.0).alias("value")).limit(0)
    axes, width = min(axes, n - 1), min(n, axes + spare)
    squares = cut(entries.withColumn("v", F.col("v") * F.col("v")), "squares")
    trace = squares.agg(F.sum("v")).first()[0] / n
    matrix = blocked(squares, n, size)
    find = lambda factor, shift: largest(matrix, n, width, min(width, axes + 1), centred=True, factor=factor, shift=shift, size=size)
    values, vectors = find(-0.5, 0.0)
    shift = 0.0
    if width < n and (values[: axes] <= -values[-1]).any():
        # negative eigenvalues are as large as the wanted ones: move all of them up, so that the wanted ones are the largest
        shift = float(-values[-1])
        values, vectors = find(-0.5, shift)
        values = values - shift
    added = 0.0
    if correction == "lingoes":
        lowest = values[-1] if width == n else -find(0.5, float(max(values[0], 0.0)))[0][0] + max(values[0], 0.0)
        added = max(0.0, float(-lowest))
    kept = values[:axes] + added
    trace += added * (n - 1)
    total = None
    if width == n:
        trivial = int(np.abs(values).argmin())
        total = sum(max(0.0, v + added) for k, v in enumerate(values) if k != trivial) or None
    eigen = spark.createDataFrame([(k + 1, float(v), None if total is None else float(max(0.0, v) / total), float(v / trace) if trace else None) for k, v in enumerate(kept)], kinds)
    scale = np.sqrt(np.maximum(kept, 0.0))

    def unpack(batches):
        for batch in batches:
            for b, p in zip(batch.column("b").to_pylist(), batch.column("p").to_pylist()):
                x = np.frombuffer(p, np.float64).reshape(-1, width)[:, :axes] * scale
                rows = np.arange(len(x)) + b * size
                yield pa.record_batch([pa.array(np.repeat(rows, axes)), pa.array(np.tile(np.arange(1, axes + 1), len(x)).astype(np.int32)), pa.array(x.ravel())], names=["place", "axis", "value"])

    loose = cut(vectors.mapInArrow(unpack, "place long, axis int, value double"), "coordinates")
    signs = loose.groupBy("axis").agg(F.signum(F.max_by("value", F.struct(F.round(F.abs("value"), 9), -F.col("place")))).alias("sign"))
    told = loose.join(F.broadcast(signs), "axis").join(names, "place")
    return eigen, told.select("sample", "axis", F.when(F.col("sign") < 0, -F.col("value")).otherwise(F.col("value")).alias("value"))


def pooled(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, weights, lengths) of the blocks that pooling adjacent violators leaves."""
    sums, held, count = [], [], []
    for v, w in zip((values * weights).tolist(), weights.tolist()):
        k = 1
        while sums and v * held[-1] <= sums[-1] * w:
            v, w, k = v + sums.pop(), w + held.pop(), k + count.pop()
        sums.append(v)
        held.append(w)
        count.append(k)
    held = np.array(held)
    return np.array(sums) / held if len(held) else held, held, np.array(count, np.int64)


def scale_small(d: np.ndarray, start: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float, float, int]:
    """(configuration, raw stress, stress-1, rounds) by majorization with disparities from isotonic regression; ties in the order of pairs."""
    n = len(d)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    i, j, wanted = i[order], j[order], d[i, j][order]
    x, before = start, math.inf
    raw = first = math.inf
    for done in range(1, rounds + 1):
        gap = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        means, _, lengths = pooled(gap, np.ones(len(gap)))
        fitted = np.repeat(means, lengths)
        miss = ((gap - fitted) ** 2).sum()
        raw, first = (math.sqrt(miss / s) if s > 0 else math.inf for s in ((wanted**2).sum(), (gap**2).sum()))
        if abs(before - raw) < tolerance:
            break
        before = raw
        pull = np.divide(fitted, gap, out=np.zeros_like(gap), where=gap > 0)[:, None] * (x[i] - x[j])
        moved = np.zeros_like(x)
        np.add.at(moved, i, pull)
        np.add.at(moved, j, -pull)
        x = moved / n
    return x, raw, first, done


def _step(ranks: DataFrame, config: DataFrame, n: int, dimensions: int) -> tuple[DataFrame, float, float]:
    """(next configuration, raw stress, stress-1) of one round over the pairs (i, j, v, place), range-partitioned by place."""
    at = lambda side: config.select(F.col("place").alias(side), F.col("x").alias(f"x{side}"))
    gaps = ranks.join(at("i"), "i").join(at("j"), "j")
    gaps = gaps.withColumn("gap", F.sqrt(F.aggregate(F.zip_with("xi", "xj", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    gaps = cut(gaps.repartitionByRange("rank").sortWithinPartitions("rank"), "gaps")

    def pool(frames):
        """Blocks of a range: first rank, weight, sum."""
        for f in frames:
            means, weights, lengths = pooled(f["value"].to_numpy(), f["weight"].to_numpy())
            first = np.cumsum(lengths) - lengths
            yield pd.DataFrame({"rank": f["rank"].to_numpy()[first], "value": means, "weight": weights})

    rows = gaps.select("rank", F.col("gap").alias("value"), F.lit(1.0).alias("weight"))
    local = cut(rows.mapInPandas(pool, "rank long, value double, weight double"), "pools")

    def finish(frames):
        """One task over what local pooling leaves: a stack of blocks, whose number is that of the final blocks."""
        means, weights, ranks_ = np.empty(0), np.empty(0), np.empty(0, np.int64)
        for f in frames:
            means, weights = np.concatenate([means, f["value"]]), np.concatenate([weights, f["weight"]])
            ranks_ = np.concatenate([ranks_, f["rank"]])
            means, weights, lengths = pooled(means, weights)
            ranks_ = ranks_[np.cumsum(lengths) - lengths]
        yield pd.DataFrame({"rank": ranks_, "fitted": means, "weight": weights})

    pools = cut(local.orderBy("rank").coalesce(1).mapInPandas(finish, "rank long, fitted double, weight double"), "pools")
    # a pair's disparity is that of the block that begins at or before its rank: ranges of a block are dealt by its ranks' thousands
    step = 4096
    spread = pools.select("fitted", F.col("rank").alias("lo"), (F.col("rank") + F.col("weight").cast("long") - 1).alias("hi"))
    spread = spread.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    told = gaps.withColumn("cell", F.floor(F.col("rank") / step)).join(spread, "cell").where("rank between lo and hi")
    miss = F.col("gap") - F.col("fitted")
    pull = F.when(F.col("gap") > 0, F.col("fitted") / F.col("gap")).otherwise(0.0)
    told = cut(told.select("i", "j", "v", "gap", (miss * miss).alias("miss"), pull.alias("pull"), "xi", "xj"), "disparities")
    sums = told.agg(F.sum("miss").alias("m"), F.sum(F.col("v") * F.col("v")).alias("t"), F.sum(F.col("gap") * F.col("gap")).alias("h")).first()
    force = lambda side, a, b: told.select(F.col(side).alias("place"), *(F.expr(f"pull * ({a}[{k}] - {b}[{k}]) / {n}").alias(f"f{k}") for k in range(dimensions)))
    both = force("i", "xi", "xj").unionByName(force("j", "xj", "xi"))
    moved = cut(both.groupBy("place").agg(F.array(*(F.sum(f"f{k}") for k in range(dimensions))).alias("x")), "configuration")
    return moved, math.sqrt(sums.m / sums.t) if sums.t else math.inf, math.sqrt(sums.m / sums.h) if sums.h else math.inf


def nmds(pairs: DataFrame, dimensions: int = 2, restarts: int = 10, rounds: int = 200, tolerance: float = 1e-6, seed: int = 0, small: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Fit (stress, stress_1, rounds, restart, converged) and configuration (sample, axis, value) of the restart with the least stress.

    `stress` divides by the given distances, `stress_1` by those of the configuration. With at most `small` samples a restart is a
    task that holds the distances; beyond that, each round of a restart is a Spark job over all pairs. Fewer than two
    samples give no rows.
    """
    spark = pairs.sparkSession
    entries, names, n = indexed(pairs)
    entries = cut(entries, "distances")
    kinds = "stress double, stress_1 double, rounds int, restart int, converged boolean"
    if n < 2:
        return spark.createDataFrame([], kinds), names.select("sample", F.lit(1).alias("axis"), F.lit(0.0).alias("value")).limit(0)
    begin = lambda r: np.random.RandomState(seed + r).randn(n, dimensions) * 0.01

    if n <= small:
        def run(key, f):
            d = np.zeros((n, n))
            d[f["i"], f["j"]] = d[f["j"], f["i"]] = f["v"]
            x, raw, first, done = scale_small(d, begin(int(key[0])), rounds, tolerance)
            rows = np.indices(x.shape).reshape(2, -1)
            return pd.DataFrame({"restart": key[0], "stress": raw, "stress_1": first, "rounds": done, "place": rows[0], "axis": rows[1] + 1, "value": x.ravel()})

        every = entries.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
        out = cut(every.repartition(restarts, "restart").groupBy("restart").applyInPandas(run, "restart int, stress double, stress_1 double, rounds int, place long, axis int, value double"), "restarts")
        best = out.select("restart", "stress", "stress_1", "rounds").distinct().orderBy("stress", "restart").first()
        config = out.where(F.col("restart") == best.restart).select("place", "axis", "value")
        found = (best.stress, best.stress_1, best.rounds, best.restart)
    else:
        ranks = cut(numbered(entries, "v", "i", "j", name="rank"), "ranks")
        found, config = None, None
        for r in range(restarts):
            x = spark.createDataFrame([(k, row) for k, row in enumerate(begin(r).tolist())], "place long, x array<double>")
            before = math.inf
            for done in range(1, rounds + 1):
                moved, raw, first = _step(ranks, x, n, dimensions)
                if abs(before - raw) < tolerance:
                    break
                before, x = raw, moved
            if found is None or raw < found[0]:
                found, config = (raw, first, done, r), x.select("place", F.posexplode("x").alias("axis", "value")).withColumn("axis", F.col("axis") + 1)
    fit = spark.createDataFrame([(*found, found[0] < 0.05)], kinds)
    return fit, config.join(names, "place").select("sample", "axis", "value")


def correspondence(counts: DataFrame, axes: int = 2, spare: int = 30, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eigenvalues (axis, eigenvalue, inertia, share), row scores (sample, axis, value) and column scores (taxon, axis, value) of a table (sample, taxon, n).

    `inertia` is the squared singular value of the standardised residuals, `eigenvalue` that over the table's sum, `share` its part of
    all. Scores are principal coordinates: singular vectors times singular values over roots of masses. Cells of one sample and taxon
    add up; missing ones and rows or columns without counts are left out; a negative count is an error. There is one axis fewer than the lesser
    side at most. Signs: the largest row score of an axis is positive. Tables of fewer than two rows or columns have no axes; where every cell is as expected all are 0, without shares.
    """
    spark = counts.sparkSession
    cells = counts.select("sample", "taxon", F.col("n").cast("double").alias("n")).where("sample is not null and taxon is not null and n is not null and not isnan(n)")
    cells = cut(cells.groupBy("sample", "taxon").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n != 0 or least < 0"), "cells")
    if cells.where("least < 0").limit(1).count():
        raise ValueError("counts must not be negative")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    side = lambda c: cut(numbered(cells.groupBy(c).agg((F.sum("n") / F.lit(total or 1.0)).alias("mass")), c), c)
    samples, taxa = side("sample"), side("taxon")
    n, m = samples.count(), taxa.count()
    axes = min(axes, n - 1, m - 1)
    kinds, kinds_of = dict(counts.dtypes), "axis int, eigenvalue double, inertia double, share double"
    if axes < 1:
        empty = lambda c: spark.createDataFrame([], f"{c} {kinds[c]}, axis int, value double")
        return spark.createDataFrame([], kinds_of), empty("sample"), empty("taxon")
    width = min(n, axes + spare)
    a, b = samples.select("sample", F.col("place").alias("i"), F.col("mass").alias("ri")), taxa.select("taxon", F.col("place").alias("j"), F.col("mass").alias("cj"))
    entries = cut(cells.join(a, "sample").join(b, "taxon").select("i", "j", (F.col("n") / total / F.sqrt(F.col("ri") * F.col("cj"))).alias("v")), "entries")
    whole = entries.agg(F.sum(F.col("v") * F.col("v"))).first()[0] - 1
    if whole <= 1e-12:
        # every cell is as expected: what is left is rounding
        none = lambda t, c: t.select(c, F.explode(F.sequence(F.lit(1), F.lit(axes))).alias("axis"), F.lit(0.0).alias("value"))
        return spark.createDataFrame([(k + 1, 0.0, 0.0, None) for k in range(axes)], kinds_of), none(samples, "sample"), none(taxa, "taxon")
    matrix = scattered(entries, size)
    # the roots of the row masses are the trivial direction, of singular value 1
    roots = _as_panel(samples.select("place", F.sqrt("mass").alias("v")), n, size)

    def product(x: DataFrame) -> DataFrame:
        back = times_scattered(matrix, times_scattered(matrix, x, width, m, True, size), width, n, False, size)
        return cut(_less(back, roots, width), "product")

    values, vectors = largest(matrix, n, width, axes, size=size, product=product)
    values = np.maximum(values[:axes], 0.0)
    kept = cut(_first(vectors, width, axes), "vectors")
    images = times_scattered(matrix, kept, axes, m, True, size)
    rows = cut(_unpacked(kept, axes, size).join(samples, "place").select("sample", "place", "axis", (F.col("value") * _at(np.sqrt(values)) / F.sqrt("mass")).alias("value")), "rows")
    columns = _unpacked(images, axes, size).join(taxa, "place").select("taxon", "axis", (F.col("value") / F.sqrt("mass")).alias("value"))
    signs = rows.groupBy("axis").agg(F.signum(F.max_by("value", F.struct(F.round(F.abs("value"), 9), -F.col("place")))).alias("sign"))
    turned = lambda t, c: t.join(F.broadcast(signs), "axis").select(c, "axis", F.when(F.col("sign") < 0, -F.col("value")).otherwise(F.col("value")).alias("value"))
    eigen = spark.createDataFrame([(k + 1, float(v / total), float(v), float(v / whole)) for k, v in enumerate(values)], kinds_of)
    return eigen, turned(rows, "sample"), turned(columns, "taxon")


def _at(values: np.ndarray):
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("axis"))


def _as_panel(rows: DataFrame, n: int, size: int) -> DataFrame:
    """A panel of one column from (place, v)."""

    def build(key, table):
        b = key[0].as_py()
        p = np.zeros(min(size, n - b * size))
        p[table["r"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"b": pa.array([b], pa.int32()), "p": pa.array([p.tobytes()], pa.binary())})

    at = rows.select((F.col("place") / size).cast("int").alias("b"), (F.col("place") % size).cast("int").alias("r"), "v")
    return cut(at.groupBy("b").applyInArrow(build, "b int, p binary"), "panel")


def _less(x: DataFrame, unit: DataFrame, width: int) -> DataFrame:
    """The panel without its part along a unit vector."""
    along, _, _ = together(unit, x, 1, width)

    def run(batches):
        for batch in batches:
            rows = [(np.frombuffer(p, np.float64).reshape(-1, width) - np.frombuffer(q, np.float64)[:, None] * along).tobytes() for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())]
            yield pa.record_batch([batch.column("b"), pa.array(rows, pa.binary())], names=["b", "p"])

    return x.join(unit.withColumnRenamed("p", "q"), "b").select("b", "p", "q").mapInArrow(run, "b int, p binary")


def _first(x: DataFrame, width: int, axes: int) -> DataFrame:
    return mapped(x, width, lambda p: p[:, :axes])


def _unpacked(x: DataFrame, axes: int, size: int) -> DataFrame:
    """(place, axis, value) of a panel."""

    def run(batches):
        for batch in batches:
            for b, p in zip(batch.column("b").to_pylist(), batch.column("p").to_pylist()):
                p = np.frombuffer(p, np.float64).reshape(-1, axes)
                yield pa.record_batch([pa.array(np.repeat(np.arange(len(p)) + b * size, axes)), pa.array(np.tile(np.arange(1, axes + 1), len(p)).astype(np.int32)), pa.array(p.ravel())], names=["place", "axis", "value"])

    return x.mapInArrow(run, "place long, axis int, value double")


def detrended(eigen: DataFrame, scores: DataFrame, gradient: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Axes (axis, eigenvalue, r_squared, retained, detrended, place) and scores (sample, axis, value) of a correspondence analysis, each axis less what others say of it.

    r_squared is that of an axis' row scores regressed on the axes before it, or of the first on a gradient (sample, value) if given;
    the rest of its variance is retained: scores are multiplied by its root, the eigenvalue by itself. `place` orders axes by what is left.
    An axis of which nothing is left (1e-12) predicts nothing. Samples without a gradient, or a constant one, are an error. Only the axes' covariances come to the driver.
    """
    axes = [r.axis for r in eigen.select("axis").orderBy("axis").collect()]
    spark = eigen.sparkSession
    if not axes:
        return spark.createDataFrame([], "axis int, eigenvalue double, r_squared double, retained double, detrended double, place int"), scores
    wide = scores.groupBy("sample").agg(*(F.max(F.when(F.col("axis") == k, F.col("value"))).alias(f"x{k}") for k in axes))
    names = [f"x{k}" for k in axes]
    if gradient is not None:
        wide, names = wide.join(gradient.select("sample", F.col("value").cast("double").alias("x0")), "sample", "left"), ["x0", *names]
    pairs = [(p, q) for k, p in enumerate(names) for q in names[k:]]
    found = wide.agg(*(F.covar_pop(p, q).alias(f"{p}_{q}") for p, q in pairs), *([F.count_if(F.col("x0").isNull() | F.isnan("x0")).alias("gaps")] if gradient is not None else [])).first()
    if gradient is not None and (found["gaps"] or found["x0_x0"] <= 0):
        raise ValueError("the gradient needs a value for every sample, not all of them equal")
    c = np.array([[found[f"{p}_{q}"] if k <= h else found[f"{q}_{p}"] for h, q in enumerate(names)] for k, p in enumerate(names)])
    at, gone, kept, shares = {k: names.index(f"x{k}") for k in axes}, set(), {}, {}
    for k in axes:
        before = [at[h] for h in axes if h < k and h not in gone] if k > axes[0] else [0] if gradient is not None else []
        y, share = at[k], 0.0
        if before and c[y, y] > 0:
            inner = c[np.ix_(before, before)]
            scale = np.sqrt(np.diag(inner))
            share = float(np.clip(c[y, before] / scale @ np.linalg.lstsq(inner / np.outer(scale, scale), c[before, y] / scale, rcond=None)[0] / c[y, y], 0, 1))
        left = 1 - share if 1 - share > 1e-12 else 0.0
        if left == 0:
            gone.add(k)
        kept[k], shares[k] = left, share
    rest = spark.createDataFrame([(k, shares[k], kept[k]) for k in axes], "axis int, r_squared double, retained double")
    table = eigen.select("axis", "eigenvalue").join(F.broadcast(rest), "axis").withColumn("detrended", F.col("eigenvalue") * F.col("retained"))
    table = table.withColumn("place", F.row_number().over(Window.orderBy(F.col("detrended").desc(), "axis")))  # a row an axis
    return table, scores.join(F.broadcast(rest), "axis").select("sample", "axis", (F.col("value") * F.sqrt("retained")).alias("value"))
