"""Selections, scaling, components, rotations, meshes, outlines and clusters over parts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import clusters as c
from ammolite.operators import geometry as g
from ammolite.operators import tables as t
from ammolite.operators.matrix import melt
from ammolite.plans.spatial import _places, _vectors

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _parts(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


def _cells(s, d):
    return melt(_parts(s, d), "p_partkey", ["p_size", "p_retailprice"])


def _gaps(s, d):
    """Customers' order totals by status: customers without a status miss a cell."""
    o = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("row_id")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return melt(o.withColumn("all", F.lit(1.0)), "row_id", ["F", "O", "P", "all"])


def _q(k=0):
    return [F.col("embedding")[k + i].cast("double") for i in range(4)]


def _quaternions(s, d):
    v = _vectors(s, d)
    m = g.rotation_matrix(_q())
    r = g.rotate(_q(), [F.col("embedding")[4 + i].cast("double") for i in range(3)])
    b = g.from_rotation_matrix(m)
    p = g.slerp(_q(), _q(7), 0.3)
    cells = [F.round(m[i][j], 5).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    return v.select("vec_id", *cells, *(F.round(x, 5).alias(f"r{k}") for k, x in enumerate(r)), *(F.round(x, 5).alias(f"q{k}") for k, x in enumerate(b)), *(F.round(x, 5).alias(f"s{k}") for k, x in enumerate(p)))


def _mesh(s, d):
    """Vertices are the vectors' first three numbers, faces three neighbours in the order of ids."""
    v = _vectors(s, d).select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")))
    faces = v.select(F.col("id").alias("face"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return v, faces


def _outline(s, d):
    return _vectors(s, d).select(F.col("label").alias("shape"), F.col("vec_id").alias("pos"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _pca(s, d, k):
    return t.principal_components(_parts(s, d), "p_partkey", ["p_size", "p_retailprice"], 2, standardize=True)[k]


def _wanted(s):
    return s.createDataFrame([(7, 0), (3, 1), (150, 2)], "key long, place int")


QUERIES = {
    "subset_rows": lambda s, d: t.subset_rows(_parts(s, d), _wanted(s), "p_partkey"),
    "subset_columns": lambda s, d: t.subset_columns(_parts(s, d), "p_partkey", [1]),
    "get_row": lambda s, d: t.get_row(_parts(s, d), "p_partkey", 7),
    "transpose": lambda s, d: t.transpose(_cells(s, d)),
    "row_means": lambda s, d: t.row_summary(_gaps(s, d)),
    "remove_columns_with_nan": lambda s, d: t.complete_columns(_gaps(s, d)),
    "sort_by_column": lambda s, d: t.sort_rows(_parts(s, d), "p_partkey", "p_size"),
    "sort_by_column_descending": lambda s, d: t.sort_rows(_parts(s, d), "p_partkey", "p_size", False),
    "column_log1p": lambda s, d: t.column_transform(_gaps(s, d), "log1p"),
    "column_zscore": lambda s, d: t.column_transform(_gaps(s, d), "zscore"),
    "column_center": lambda s, d: t.column_transform(_cells(s, d), "center"),
    "standardize_rows": lambda s, d: t.standardize_rows(_gaps(s, d)),
    "pca_eigenvalues": lambda s, d: _pca(s, d, 0),
    "pca_loadings": lambda s, d: _pca(s, d, 1),
    "pca_scores": lambda s, d: _pca(s, d, 2),
    "quaternions": _quaternions,
    "mesh_summary": lambda s, d: g.mesh_summary(*_mesh(s, d)),
    "mesh_normals": lambda s, d: g.vertex_normals(*_mesh(s, d)),
    "elliptic_fourier": lambda s, d: g.elliptic_fourier(_outline(s, d), 6),
    "dbscan": lambda s, d: c.dbscan(_places(s, d), 0.02, 5),
    "minimum_spanning_tree": lambda s, d: c.minimum_spanning_tree(_places(s, d)).agg(F.count("*").alias("edges"), F.round(F.sum("d"), 5).alias("length"), F.round(F.max("d"), 6).alias("longest")),
    "single_linkage": lambda s, d: c.single_linkage(_places(s, d), 5).groupBy("cluster").agg(F.count("*").alias("n")),
    "kmeans": lambda s, d: c.kmeans(_vectors(s, d), "vec_id", "embedding", 4).withColumn("distance", F.round("distance", 5)),
    "kmeans_elbow": lambda s, d: c.kmeans_elbow(_vectors(s, d), "vec_id", "embedding", 2, 5).withColumn("wcss", F.round("wcss", 4)),
}

_G = "WITH x AS (SELECT o_custkey AS row_id, o_orderstatus AS var, sum(o_totalprice) AS value FROM orders GROUP BY ALL), r AS (SELECT DISTINCT row_id FROM x), c AS (SELECT r.row_id, v.var, x.value FROM r CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(var) LEFT JOIN x ON x.row_id = r.row_id AND x.var = v.var UNION ALL SELECT row_id, 'all', 1.0 FROM r)"
_M = "WITH c AS (SELECT p_partkey AS row_id, 'p_size' AS var, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part)"
#: Two standardised variables: eigenvalues 1 + r and 1 - r, vectors (1, 1) and (1, -1) over sqrt 2.
_PC = "WITH z AS (SELECT p_partkey AS key, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part), r AS (SELECT corr(a, b) AS r FROM z)"
_E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_QN = _E + ", l AS (SELECT id, e, sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS l, sqrt(e[8] ** 2 + e[9] ** 2 + e[10] ** 2 + e[11] ** 2) AS h FROM e), q AS (SELECT id, e, e[1] / l AS w, e[2] / l AS x, e[3] / l AS y, e[4] / l AS z, e[8] / h AS b0, e[9] / h AS b1, e[10] / h AS b2, e[11] / h AS b3 FROM l)"
_QM = _QN + """, m AS (SELECT *, 1 - 2 * (y * y + z * z) AS m00, 2 * (x * y - w * z) AS m01, 2 * (x * z + w * y) AS m02, 2 * (x * y + w * z) AS m10, 1 - 2 * (x * x + z * z) AS m11, 2 * (y * z - w * x) AS m12, 2 * (x * z - w * y) AS m20, 2 * (y * z + w * x) AS m21, 1 - 2 * (x * x + y * y) AS m22,
 CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg, w * b0 + x * b1 + y * b2 + z * b3 AS dt FROM q),
s AS (SELECT *, CASE WHEN dt < 0 THEN -1 ELSE 1 END AS f, least(abs(dt), 1.0) AS ad FROM m), t AS (SELECT *, CASE WHEN ad > 0.9995 THEN 0.7 ELSE sin(0.7 * acos(ad)) / sin(acos(ad)) END AS u, CASE WHEN ad > 0.9995 THEN 0.3 ELSE sin(0.3 * acos(ad)) / sin(acos(ad)) END * f AS v FROM s),
p AS (SELECT *, u * w + v * b0 AS sw, u * x + v * b1 AS sx, u * y + v * b2 AS sy, u * z + v * b3 AS sz FROM t), n AS (SELECT *, sqrt(sw * sw + sx * sx + sy * sy + sz * sz) AS sl FROM p)
SELECT id AS vec_id, """ + ", ".join(f"round(m{i}{j}, 5) AS m{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round(m{i}0 * e[5] + m{i}1 * e[6] + m{i}2 * e[7], 5) AS r{i}" for i in range(3)) + ", " + ", ".join(f"round(sg * {c}, 5) AS q{k}" for k, c in enumerate("wxyz")) + ", " + ", ".join(f"round(s{c} / sl, 5) AS s{k}" for k, c in enumerate("wxyz")) + " FROM n"
_F = _E + """, f AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.e AS p, b.e AS q, c.e AS r FROM e a JOIN e b ON b.id = a.id + 1 JOIN e c ON c.id = a.id + 2),
x AS (SELECT a, b, c, (q[2] - p[2]) * (r[3] - p[3]) - (q[3] - p[3]) * (r[2] - p[2]) AS nx, (q[3] - p[3]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[3] - p[3]) AS ny, (q[1] - p[1]) * (r[2] - p[2]) - (q[2] - p[2]) * (r[1] - p[1]) AS nz,
 (p[1] * (q[2] * r[3] - q[3] * r[2]) + p[2] * (q[3] * r[1] - q[1] * r[3]) + p[3] * (q[1] * r[2] - q[2] * r[1])) / 6 AS v FROM f)"""
_NEAR = "WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), d AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02)"

#: A tree grown from the least id, each time by the nearest point outside: in the last step every other point has its edge.
_PRIM = """WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), o AS (SELECT * FROM p ORDER BY id LIMIT 1),
t AS (SELECT 0 AS step, p.id, p.x, p.y, p.id = o.id AS held, sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2) AS d, o.id AS par FROM p, o
UNION ALL SELECT t.step + 1, t.id, t.x, t.y, t.held OR t.id = n.id, CASE WHEN t.held OR t.id = n.id THEN t.d ELSE least(t.d, sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2)) END,
 CASE WHEN NOT t.held AND t.id <> n.id AND sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2) < t.d THEN n.id ELSE t.par END FROM t, (SELECT id, x, y FROM t WHERE NOT held ORDER BY d, id LIMIT 1) n),
e AS (SELECT id, par, d FROM t WHERE step = (SELECT count(*) - 1 FROM p) AND id <> par)"""

ORACLE_SQL = {
    "subset_rows": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(place AS INTEGER) AS place FROM part JOIN (VALUES (7, 0), (3, 1), (150, 2)) v(k, place) ON k = p_partkey",
    "subset_columns": "SELECT p_partkey, p_retailprice FROM part",
    "get_row": "SELECT 'p_size' AS var, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey = 7 UNION ALL SELECT 'p_retailprice', p_retailprice FROM part WHERE p_partkey = 7",
    "transpose": _M + " SELECT var AS row_id, CAST(row_id AS VARCHAR) AS var, value FROM c",
    "row_means": _G + " SELECT row_id, count(value) AS n, count(*) FILTER (value IS NULL) AS n_missing, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM c GROUP BY 1",
    "remove_columns_with_nan": _G + " SELECT row_id, var, round(value, 6) AS value FROM c WHERE var NOT IN (SELECT var FROM c WHERE value IS NULL)",
    "sort_by_column": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CAST(row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS INTEGER) AS place FROM part",
    "sort_by_column_descending": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) - 1 AS INTEGER) AS place FROM part",
    "column_log1p": _G + " SELECT row_id, var, round(ln(value + 1), 6) AS value FROM c",
    "column_zscore": _G + " SELECT row_id, var, CASE WHEN stddev_pop(value) OVER w > 0 THEN round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) END AS value FROM c WINDOW w AS (PARTITION BY var)",
    "column_center": _M + " SELECT row_id, var, round(value - avg(value) OVER (PARTITION BY var), 6) AS value FROM c",
    "standardize_rows": _G + " SELECT row_id, var, round((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 6) AS value FROM c WINDOW w AS (PARTITION BY row_id)",
    "pca_eigenvalues": _PC + " SELECT 1 AS component, round(1 + abs(r), 6) AS eigenvalue, round((1 + abs(r)) / 2, 6) AS share FROM r UNION ALL SELECT 2, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6) FROM r",
    "pca_loadings": _PC + """, l AS (SELECT 'p_size' AS var, 1 AS component, sqrt((1 + abs(r)) / 2) AS loading FROM r UNION ALL SELECT 'p_retailprice', 1, sign(r) * sqrt((1 + abs(r)) / 2) FROM r UNION ALL SELECT 'p_size', 2, sqrt((1 - abs(r)) / 2) FROM r UNION ALL SELECT 'p_retailprice', 2, -sign(r) * sqrt((1 - abs(r)) / 2) FROM r) SELECT var, component, round(loading, 6) AS loading FROM l""",
    "pca_scores": _PC + " SELECT key, round((a + sign(r) * b) / sqrt(2), 5) AS pc1, round((a - sign(r) * b) / sqrt(2), 5) AS pc2 FROM z, r",
    "mesh_summary": _F + " SELECT count(*) AS faces, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 5) AS surface, round(sum(v), 6) AS volume FROM x",
    "mesh_normals": _F + ", u AS (SELECT a AS id, nx, ny, nz FROM x UNION ALL SELECT b, nx, ny, nz FROM x UNION ALL SELECT c, nx, ny, nz FROM x), s AS (SELECT id, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM u GROUP BY 1) SELECT id, round(x / sqrt(x * x + y * y + z * z), 5) AS nx, round(y / sqrt(x * x + y * y + z * z), 5) AS ny, round(z / sqrt(x * x + y * y + z * z), 5) AS nz FROM s",
    "quaternions": _QM,
    "elliptic_fourier": _E + """, o AS (SELECT label AS shape, id AS pos, e[1] AS x, e[2] AS y FROM e), s AS (SELECT shape, pos, coalesce(lead(x) OVER w, first_value(x) OVER (PARTITION BY shape ORDER BY pos)) - x AS dx, coalesce(lead(y) OVER w, first_value(y) OVER (PARTITION BY shape ORDER BY pos)) - y AS dy FROM o WINDOW w AS (PARTITION BY shape ORDER BY pos)),
d AS (SELECT *, sqrt(dx * dx + dy * dy) AS dt FROM s WHERE dx <> 0 OR dy <> 0), t AS (SELECT *, sum(dt) OVER (PARTITION BY shape ORDER BY pos) AS t1, sum(dt) OVER (PARTITION BY shape) AS p FROM d),
h AS (SELECT shape, CAST(n AS INTEGER) AS n, p, dx / dt AS sx, dy / dt AS sy, cos(2 * pi() * n * t1 / p) - cos(2 * pi() * n * (t1 - dt) / p) AS c, sin(2 * pi() * n * t1 / p) - sin(2 * pi() * n * (t1 - dt) / p) AS s FROM t, range(1, 7) g(n))
SELECT shape, n, round(sum(sx * c) * p / (2 * pi() ** 2 * n * n), 6) AS a, round(sum(sx * s) * p / (2 * pi() ** 2 * n * n), 6) AS b, round(sum(sy * c) * p / (2 * pi() ** 2 * n * n), 6) AS c, round(sum(sy * s) * p / (2 * pi() ** 2 * n * n), 6) AS d FROM h GROUP BY shape, n, p""",
    "dbscan": _NEAR + """, core AS (SELECT id FROM p WHERE (SELECT count(*) FROM d WHERE i = id) + 1 >= 5), w AS (SELECT i, j FROM d WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, w.j FROM r JOIN w ON w.i = r.b), k AS (SELECT a AS id, min(b) AS c FROM r GROUP BY 1)
SELECT p.id, coalesce(k.c, (SELECT min(q.c) FROM d JOIN k q ON q.id = d.j WHERE d.i = p.id)) AS cluster, k.c IS NOT NULL AS core FROM p LEFT JOIN k ON k.id = p.id""",
    "minimum_spanning_tree": _PRIM + " SELECT count(*) AS edges, round(sum(d), 5) AS length, round(max(d), 6) AS longest FROM e",
    "single_linkage": _PRIM + """, f AS (SELECT id, par, row_number() OVER (ORDER BY d DESC) <= 4 AS gone FROM e), u AS (SELECT id AS a, id AS b FROM p UNION ALL SELECT u.a, f.par FROM u JOIN f ON f.id = u.b WHERE NOT f.gone),
g AS (SELECT a, max_by(b, k) AS top FROM (SELECT a, b, (SELECT count(*) FROM f WHERE f.id = u.b AND NOT f.gone) = 0 AS k FROM u) GROUP BY a) SELECT min(a) AS cluster, count(*) AS n FROM g GROUP BY top""",
}
