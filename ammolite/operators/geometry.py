"""Rotations as unit quaternions, triangle meshes, and outlines by elliptic Fourier coefficients, as column expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Q = list[Column]


def unit(q: Q) -> Q:
    """The quaternion (w, x, y, z) divided by its length; null where that is 0."""
    length = F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    return [c / F.nullif(length, F.lit(0.0)) for c in q]


def rotation_matrix(q: Q) -> list[Q]:
    w, x, y, z = unit(q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def rotate(q: Q, v: Q) -> Q:
    return [sum((m * c for m, c in zip(row, v)), F.lit(0.0)) for row in rotation_matrix(q)]


def from_rotation_matrix(m: list[Q]) -> Q:
    """The quaternion of a rotation matrix, its first part not negative: each part from the largest of the four squares, which keeps precision."""
    t = m[0][0] + m[1][1] + m[2][2]
    squares = [(1 + t) / 4, (1 + 2 * m[0][0] - t) / 4, (1 + 2 * m[1][1] - t) / 4, (1 + 2 * m[2][2] - t) / 4]
    products = {(0, 1): (m[2][1] - m[1][2]) / 4, (0, 2): (m[0][2] - m[2][0]) / 4, (0, 3): (m[1][0] - m[0][1]) / 4, (1, 2): (m[0][1] + m[1][0]) / 4, (1, 3): (m[0][2] + m[2][0]) / 4, (2, 3): (m[1][2] + m[2][1]) / 4}
    most = F.greatest(*squares)
    part = lambda i, k: F.sqrt(squares[k]) if i == k else products[min(i, k), max(i, k)] / F.sqrt(squares[k])
    q = [F.coalesce(*(F.when(squares[k] == most, part(i, k)) for k in range(4))) for i in range(4)]
    return [F.when(q[0] < 0, -c).otherwise(c) for c in q]


def slerp(a: Q, b: Q, t: float) -> Q:
    """The rotation the share t of the short way from a to b; nearly equal ones are mixed straight."""
    p, q = unit(a), unit(b)
    dot = sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    q, dot = [F.when(dot < 0, -c).otherwise(c) for c in q], F.abs(dot)
    angle = F.acos(F.least(dot, F.lit(1.0)))
    near = dot > 0.9995
    u = F.when(near, 1.0 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    v = F.when(near, F.lit(t)).otherwise(F.sin(t * angle) / F.sin(angle))
    return unit([u * x + v * y for x, y in zip(p, q)])


def face_vectors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Of faces (face, a, b, c) over vertices (id, x, y, z) the cross product of two edges (twice the area along the normal) and the volume of the tetrahedron with the origin."""
    at = lambda n: vertices.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz"))
    f = faces.join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    e = lambda n, k: F.col(f"{n}{k}") - F.col(f"a{k}")
    cross = [e("b", "y") * e("c", "z") - e("b", "z") * e("c", "y"), e("b", "z") * e("c", "x") - e("b", "x") * e("c", "z"), e("b", "x") * e("c", "y") - e("b", "y") * e("c", "x")]
    v = lambda n, k: F.col(f"{n}{k}")
    volume = (v("a", "x") * (v("b", "y") * v("c", "z") - v("b", "z") * v("c", "y")) + v("a", "y") * (v("b", "z") * v("c", "x") - v("b", "x") * v("c", "z")) + v("a", "z") * (v("b", "x") * v("c", "y") - v("b", "y") * v("c", "x"))) / 6
    return f.select("face", "a", "b", "c", *(x.alias(f"n{k}") for k, x in zip("xyz", cross)), volume.alias("volume"))


def mesh_summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces, surface, and signed volume of a mesh."""
    x = face_vectors(vertices, faces)
    area = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2
    return x.agg(F.count("*").alias("faces"), F.round(F.sum(area), 5).alias("surface"), F.round(F.sum("volume"), 6).alias("volume"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normals of vertices: the sum of their faces' cross products, so that larger faces weigh more; null where it is 0."""
    x = face_vectors(vertices, faces).select(F.explode(F.array("a", "b", "c")).alias("id"), "nx", "ny", "nz")
    s = x.groupBy("id").agg(*(F.sum(f"n{k}").alias(k) for k in "xyz"))
    return s.select("id", *(F.round(c, 5).alias(f"n{k}") for k, c in zip("xyz", unit([F.col(k) for k in "xyz"]))))


def elliptic_fourier(outline: DataFrame, harmonics: int) -> DataFrame:
    """Coefficients a, b, c, d of each harmonic of closed outlines (shape, pos, x, y): the last point joins the first; points at the same place as the one before are left out."""
    w = W.partitionBy("shape").orderBy("pos")
    first = W.partitionBy("shape")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = outline.select("shape", "pos", (nxt("x") - F.col("x")).alias("dx"), (nxt("y") - F.col("y")).alias("dy"))
    s = s.withColumn("dt", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("dt > 0")
    s = s.withColumn("t1", F.sum("dt").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("t0", F.col("t1") - F.col("dt")).withColumn("period", F.sum("dt").over(first))
    h = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("n"))
    angle = lambda c: 2 * math.pi * F.col("n") * F.col(c) / F.col("period")
    cos, sin = F.cos(angle("t1")) - F.cos(angle("t0")), F.sin(angle("t1")) - F.sin(angle("t0"))
    sums = h.groupBy("shape", "n", "period").agg(*(F.sum(F.col(d) / F.col("dt") * f).alias(c) for c, d, f in (("a", "dx", cos), ("b", "dx", sin), ("c", "dy", cos), ("d", "dy", sin))))
    return sums.select("shape", "n", *(F.round(F.col(c) * F.col("period") / (2 * math.pi * math.pi * F.col("n") * F.col("n")), 6).alias(c) for c in "abcd"))
