"""Regressions fitted by Newton steps whose sums Spark makes: proportional hazards, and autoregressive moving-average models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import missing
from ammolite.functions.scans import running_sums
from ammolite.functions.special import chi2_sf
from ammolite.functions.storage import cut


def cox_ph(df: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 25, tolerance: float = 1e-10) -> tuple[DataFrame, dict]:
    """(coefficients (covariate, beta, hazard_ratio, se, z, p), fit (log_likelihood, aic, events, rounds)) of a proportional hazards model.

    Covariates are standardised by their population deviations (a constant one is left as it is); ties share one risk set (Breslow). Sums at equal times are
    one grouping, those over everybody still at risk are running sums from the last time back, made range by range. Rows with anything missing are left out. No events, or a
    likelihood without a maximum, is an error.
    """
    x = df.select(missing(time).alias("t"), (missing(event) > 0).cast("int").alias("e"), *(missing(c).alias(f"x{k}") for k, c in enumerate(covariates))).na.drop()
    p = len(covariates)
    stats = x.agg(F.sum("e").alias("e"), *(F.avg(f"x{k}").alias(f"m{k}") for k in range(p)), *(F.stddev_pop(f"x{k}").alias(f"s{k}") for k in range(p))).first()
    if not stats.e:
        raise ValueError("no events")
    x = cut(x.select("t", "e", *(((F.col(f"x{k}") - stats[f"m{k}"]) / (stats[f"s{k}"] or 1.0)).alias(f"x{k}") for k in range(p))), "hazards")
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    beta, before = np.zeros(p), -math.inf
    for done in range(1, rounds + 1):
        eta = sum((F.col(f"x{k}") * float(beta[k]) for k in range(p)), F.lit(0.0))
        r = x.withColumn("eta", eta).withColumn("r", F.exp("eta"))
        sums = {"s": F.sum("r"), **{f"s{k}": F.sum(F.col("r") * F.col(f"x{k}")) for k in range(p)}, **{f"q{k}": F.sum(F.col("r") * F.col(f"x{a}") * F.col(f"x{b}")) for k, (a, b) in enumerate(pairs)}}
        at = r.groupBy("t").agg(F.sum("e").alias("d"), F.sum(F.col("e") * F.col("eta")).alias("l"), *(F.sum(F.col("e") * F.col(f"x{k}")).alias(f"d{k}") for k in range(p)), *(c.alias(k) for k, c in sums.items()))
        held = running_sums(at, (F.desc("t"),), **{f"c_{k}": k for k in sums})
        s, d = F.col("c_s"), F.col("d")
        mean = [F.col(f"c_s{k}") / s for k in range(p)]
        found = held.where("d > 0").agg(
            F.sum(F.col("l") - d * F.log(s)).alias("l"), *(F.sum(F.col(f"d{k}") - d * mean[k]).alias(f"g{k}") for k in range(p)), *(F.sum(d * (F.col(f"c_q{k}") / s - mean[a] * mean[b])).alias(f"h{k}") for k, (a, b) in enumerate(pairs))
        ).first()
        h = np.zeros((p, p))
        for k, (a, b) in enumerate(pairs):
            h[a, b] = h[b, a] = found[f"h{k}"]
        if np.linalg.eigvalsh(h).min() <= 1e-10 * max(1.0, np.abs(h).max()):
            raise ValueError("the likelihood has no maximum")
        if abs(found.l - before) <= tolerance * max(1.0, abs(found.l)):
            break
        before, beta = found.l, beta + np.linalg.solve(h, np.array([found[f"g{k}"] for k in range(p)]))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    rows = [(c, float(beta[k]), float(math.exp(beta[k])), float(se[k]), float(beta[k] / se[k])) for k, c in enumerate(covariates)]
    table = df.sparkSession.createDataFrame(rows, "covariate string, beta double, hazard_ratio double, se double, z double")
    return table.withColumn("p", chi2_sf(F.col("z") * F.col("z"), F.lit(1.0))), {"log_likelihood": float(found.l), "aic": float(2 * p - 2 * found.l), "events": int(stats.e), "rounds": done}


def _least_squares(x: DataFrame, target: str, terms: list[str]) -> tuple[np.ndarray, float, int]:
    """(coefficients, residual sum of squares, rows) of a regression without intercept, from one aggregate over the rows."""
    names = [*terms, target]
    found = x.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)).first()
    g = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            g[i, j] = g[j, i] = found[f"{i}_{j}"] or 0.0
    a, b = g[:-1, :-1], g[:-1, -1]
    w = np.linalg.lstsq(a, b, rcond=None)[0] if len(terms) else np.empty(0)
    return w, float(g[-1, -1] - w @ b), found.n


def hannan_rissanen(x: DataFrame, p: int, q: int, long: int | None = None) -> tuple[DataFrame, dict]:
    """(coefficients (term, lag, value), fit (mean, sigma2, n, aic)) of an ARMA(p, q) model of a series (t, v) by two regressions.

    A long autoregression gives innovations, on whose lags and the series' own the second regression rests. `long` lags (by default the larger of p and q
    plus two, or ten times the logarithm of the length, whichever is more) stand before the first row that is used.
    """
    z = x.select("t", missing("v").alias("v")).na.drop()
    n, mean = z.agg(F.count("*"), F.avg("v")).first()
    long = long or max(max(p, q) + 2, int(math.ceil(10 * math.log10(max(n, 2)))))
    if n <= 2 * long + p + q + 1:
        raise ValueError("too few values for the lags")
    w = W.orderBy("t")
    lagged = cut(z.select("t", (F.col("v") - mean).alias("z"), *((F.lag("v", k).over(w) - mean).alias(f"z{k}") for k in range(1, long + 1))), "lags")
    first, _, _ = _least_squares(lagged.na.drop(), "z", [f"z{k}" for k in range(1, long + 1)])
    e = F.col("z") - sum((F.col(f"z{k}") * float(first[k - 1]) for k in range(1, long + 1)), F.lit(0.0))
    shocks = cut(lagged.na.drop().select("t", "z", *(f"z{k}" for k in range(1, p + 1)), e.alias("e")), "innovations")
    second = shocks.select("*", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, q + 1))).na.drop()
    terms = [*(f"z{k}" for k in range(1, p + 1)), *(f"e{k}" for k in range(1, q + 1))]
    values, rss, m = _least_squares(second, "z", terms)
    rows = [("ar" if t[0] == "z" else "ma", int(t[1:]), float(v)) for t, v in zip(terms, values)]
    sigma2 = rss / m
    return x.sparkSession.createDataFrame(rows, "term string, lag int, value double"), {"mean": float(mean), "sigma2": sigma2, "n": int(m), "aic": m * math.log(sigma2) + 2 * (p + q + 1)}
