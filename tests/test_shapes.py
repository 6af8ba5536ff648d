"""Superimposition, splines and warps of landmarks."""

import numpy as np
import pytest

from ammolite.operators import shapes as h


def turn(a):
    return np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])


def frame(spark, shapes):
    return spark.createDataFrame([(k, s.ravel().tolist()) for k, s in enumerate(shapes)], "specimen long, shape array<double>").repartition(3)


def collected(df, dims):
    return {r.specimen: np.array(r["shape"]).reshape(-1, dims) for r in df.collect()}


def specimens(n=12, k=7, dims=2, noise=0.05, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(k, dims))
    out = []
    for _ in range(n):
        q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        q[:, 0] *= np.sign(np.linalg.det(q))
        out.append((base + rng.normal(size=base.shape) * noise) @ q * rng.uniform(0.5, 3) + rng.normal(size=dims) * 5)
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_turned_scaled_and_moved_copies_fall_together(spark, dims):
    aligned, mean, fit = h.procrustes(frame(spark, specimens(dims=dims, noise=0.0)), dims)
    assert fit["converged"] and fit["sse"] < 1e-12 and all(np.allclose(s, mean, atol=1e-6) for s in collected(aligned, dims).values())
    assert np.isclose((mean**2).sum(), 1) and np.allclose(mean.mean(0), 0)


def test_rounds_match_a_version_with_loops(spark):
    shapes = specimens()
    x = np.array([s - s.mean(0) for s in shapes])
    sizes = np.sqrt((x**2).sum((1, 2)))
    x = x / sizes[:, None, None]
    for _ in range(3):
        total = x.sum(0)
        x = np.array([_rotated(s, (total - s) / (len(x) - 1)) for s in x])
    aligned, mean, fit = h.procrustes(frame(spark, shapes), 2, 3, -1.0)
    got = collected(aligned, 2)
    assert all(np.allclose(got[k], x[k]) for k in got) and np.allclose(mean, x.mean(0)) and fit["iterations"] == 3
    assert np.isclose(fit["sse"], ((x - x.mean(0)) ** 2).sum())
    assert all(np.isclose(r.distance, np.sqrt(((x[r.specimen] - x.mean(0)) ** 2).sum())) and np.isclose(r["size"], sizes[r.specimen]) for r in aligned.collect())


def _rotated(s, t):
    a = np.arctan2((s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum(), (s * t).sum())
    return s @ turn(a).T


def test_reflections_only_if_asked_for(spark):
    base = specimens(n=1)[0]
    both = frame(spark, [base, base * [-1, 1], base, base + 1])
    assert h.procrustes(both, 2)[2]["sse"] > 0.01 and h.procrustes(both, 2, reflect=True)[2]["sse"] < 1e-9


def test_degenerate_and_missing_specimens(spark):
    with pytest.raises(Exception, match="coincide"):
        h.procrustes(frame(spark, [np.ones((4, 2))]), 2)
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 0, 2.0, 3.0), ("b", 0, None, 1.0), ("b", 1, 1.0, 1.0)], "s string, l int, x double, y double")
    assert [(r.specimen, r["shape"]) for r in h.configurations(rows, "s", "l", "x", "y").collect()] == [("a", [2.0, 3.0, 0.0, 1.0])]
    none, mean, _ = h.procrustes(frame(spark, [np.ones((4, 2))]).limit(0), 2)
    assert none.collect() == []


@pytest.mark.parametrize("dims", [2, 3])
def test_splines_go_through_their_targets(spark, dims):
    rng = np.random.default_rng(5)
    source = rng.normal(size=(9, dims))
    affine = source @ rng.normal(size=(dims, dims)) + 2
    targets = [affine, source + rng.normal(size=source.shape) * 0.2]
    points = rng.normal(size=(4, dims))
    got = {r.specimen: r for r in h.thin_plate_splines(frame(spark, targets), source).collect()}
    assert all(np.allclose(np.array(got[k]["shape"]).reshape(-1, dims), t) for k, t in enumerate(targets))
    assert abs(got[0].energy) < 1e-9 < abs(got[1].energy)
    # a solution of the whole system, target by target
    p = np.hstack([np.ones((9, 1)), source])
    k = np.array([[0 if i == j else (r * r * np.log(r) if dims == 2 else r) for j in range(9) for r in [np.linalg.norm(source[i] - source[j])]] for i in range(9)])
    full = np.block([[k, p], [p.T, np.zeros((dims + 1, dims + 1))]])
    w = np.linalg.solve(full, np.vstack([targets[1], np.zeros((dims + 1, dims))]))
    assert np.isclose(got[1].energy, (w[:9] * (k @ w[:9])).sum())
    moved = {r.specimen: np.array(r["shape"]).reshape(-1, dims) for r in h.thin_plate_splines(frame(spark, targets), source, points).collect()}
    r = np.linalg.norm(points[:, None] - source[None], axis=2)
    assert np.allclose(moved[1], (r * r * np.log(r) if dims == 2 else r) @ w[:9] + np.hstack([np.ones((4, 1)), points]) @ w[9:])
    assert h.grid(source, 3, 4).shape == (12, dims)


def test_relative_warps_are_principal_components(spark):
    aligned, mean, _ = h.procrustes(frame(spark, specimens(n=20)), 2)
    x = np.array([collected(aligned, 2)[k].ravel() for k in range(20)]) - mean.ravel()
    values = np.linalg.eigvalsh(x.T @ x / 19)[::-1]
    warps, scores = h.relative_warps(aligned, mean, 2)
    assert np.allclose([r.value for r in sorted(warps.collect())], values[:2]) and np.isclose(sorted(warps.collect())[0].share, values[0] / values.sum())
    s = np.zeros((20, 2))
    for r in scores.collect():
        s[r.specimen, r.warp - 1] = r.score
    assert np.allclose((s**2).sum(0) / 19, values[:2]) and all(s[np.abs(s[:, k]).argmax(), k] > 0 for k in range(2))
    assert h.relative_warps(aligned, mean, 2, alpha=1.0)[1].count() == 40
