"""Ordination and agglomeration queries: nations as communities of parts, and vectors as stratigraphic sections by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.functions.columns import rounded
from ammolite.operators import agglomeration as g
from ammolite.operators import communities as c
from ammolite.operators import ordination as o
from ammolite.plans.ecology import _P, _community


def _distances(s, d, kind):
    return c.pair_distances(_community(s, d)).select("i", "j", F.col(kind).alias("d"))


def _levels(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id", F.slice("embedding", 1, 3).alias("x"))


def _eigenvalues(s, d):
    return o.pcoa(_distances(s, d, "bray_curtis"), 3)[0].select("axis", *(F.round(k, 6).alias(k) for k in ("eigenvalue", "share", "share_of_trace")))


def _nmds(s, d):
    fit, config = o.nmds(_distances(s, d, "bray_curtis"), 2)
    return config.join(F.broadcast(fit.select("stress")), how="cross").select("sample", "axis", "value", "stress")


def _merges(method, kind):
    return lambda s, d: g.linkage(_distances(s, d, kind), method).withColumn("height", rounded("height", 5))


def _cut(s, d):
    return g.cut_tree(g.linkage(_distances(s, d, "bray_curtis"), "average"), 4)


def _cophenetic(s, d):
    p = _distances(s, d, "bray_curtis")
    return g.cophenetic_correlation(p, g.linkage(p, "average")).withColumn("r", F.round("r", 6))


def _coniss(s, d):
    return g.coniss(_levels(s, d), "label", "vec_id", "x").select("section", "step", "a", "b", F.round("increase", 6).alias("increase"), F.round("total", 5).alias("total"), "size")


def _zones(s, d):
    x = _levels(s, d)
    return g.coniss_zones(x, g.coniss(x, "label", "vec_id", "x"), "label", "vec_id", 4)


def _stick(s, d):
    return g.broken_stick(g.coniss(_levels(s, d), "label", "vec_id", "x")).select("section", "k", F.round("share", 6).alias("share"), F.round("expected", 6).alias("expected"))


def _ca(s, d, k):
    return o.correspondence(_community(s, d), 3)[k]


def _dca(s, d):
    """The mean account balance of a nation's suppliers is the gradient."""
    eigen, rows, _ = o.correspondence(_community(s, d), 3)
    held = s.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("sample")).agg(F.avg("s_acctbal").alias("value"))
    return o.detrended(eigen, rows, held)


def _rounded(df, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns))


QUERIES = {
    "correspondence_eigenvalues": lambda s, d: _rounded(_ca(s, d, 0), eigenvalue=10, inertia=6, share=6),
    "correspondence_rows": lambda s, d: _rounded(_ca(s, d, 1), value=5),
    "correspondence_columns": lambda s, d: _rounded(_ca(s, d, 2), value=4),
    "detrended_correspondence": lambda s, d: _rounded(_dca(s, d)[0], eigenvalue=10, r_squared=5, retained=5, detrended=10),
    "detrended_correspondence_rows": lambda s, d: _rounded(_dca(s, d)[1], value=5),
    "pcoa_eigenvalues": _eigenvalues,
    "pcoa_coordinates": lambda s, d: o.pcoa(_distances(s, d, "bray_curtis"), 3)[1].withColumn("value", F.round("value", 5)),
    "pcoa_lingoes": lambda s, d: o.pcoa(_distances(s, d, "bray_curtis"), 3, "lingoes")[0].select("axis", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("share", 6).alias("share")),
    "nmds": _nmds,
    "linkage_average": _merges("average", "bray_curtis"),
    "linkage_complete": _merges("complete", "bray_curtis"),
    "linkage_single": _merges("single", "bray_curtis"),
    "linkage_ward": _merges("ward", "euclidean"),
    "cut_tree": _cut,
    "cophenetic_correlation": _cophenetic,
    "coniss": _coniss,
    "coniss_zones": _zones,
    "broken_stick_zones": _stick,
}

#: All eigenvalues, largest first: the matrix, moved up until none is negative, is squared until only its largest direction is left, then taken off.
_AXES = """,
m AS (SELECT list(row ORDER BY i) AS m, list(i ORDER BY i) AS ids, count(*) AS n, max(list_sum(list_transform(row, lambda v: abs(v)))) AS up FROM o),
t AS (SELECT 1 AS k, 0 AS step, m, list_transform(m, lambda row, i: list_transform(row, lambda v, j: v + CASE WHEN i = j THEN up ELSE 0 END)) AS p, CAST(NULL AS DOUBLE) AS e, up, n FROM m
UNION ALL SELECT CASE WHEN step = 18 THEN k + 1 ELSE k END, CASE WHEN step = 18 THEN 0 ELSE step + 1 END, CASE WHEN step = 18 THEN u ELSE m END,
 CASE WHEN step = 18 THEN list_transform(u, lambda row, i: list_transform(row, lambda v, j: v + CASE WHEN i = j THEN up ELSE 0 END)) ELSE list_transform(p, lambda x: list_transform(p, lambda y: list_dot_product(x, y) / z)) END,
 CASE WHEN step = 17 THEN (SELECT list_sum(list_transform(list_zip(m, q), lambda x: list_dot_product(x[1], x[2])))) / tq END, up, n
 FROM (SELECT *, list_sum(list_transform(p, lambda x: list_dot_product(x, x))) AS z, list_transform(p, lambda x: list_transform(p, lambda y: list_dot_product(x, y))) AS q, list_sum(list_transform(p, lambda x: list_dot_product(x, x))) AS tq,
  list_transform(m, lambda row, i: list_transform(row, lambda v, j: v - coalesce(e, 0) * p[i][j] / list_sum(list_transform(p, lambda x, h: x[h])))) AS u FROM t) WHERE k < n OR step < 18),
v AS (SELECT k, e, p, list_sum(list_transform(p, lambda x, h: x[h])) AS tp FROM t WHERE step = 18)"""
_E = _P.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, w AS (SELECT i, j, bray_curtis ** 2 AS q FROM d UNION ALL SELECT j, i, bray_curtis ** 2 FROM d UNION ALL SELECT DISTINCT sample, sample, 0 FROM c),
r AS (SELECT i, avg(q) AS r FROM w GROUP BY i), o AS (SELECT w.i, list(-0.5 * (q - a.r - b.r + (SELECT avg(q) FROM w)) ORDER BY w.j) AS row FROM w JOIN r a ON a.i = w.i JOIN r b ON b.i = w.j GROUP BY w.i)""" + _AXES
_CUT = """WITH RECURSIVE {p}, s AS (SELECT 0 AS step, id, id AS c, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, CAST(NULL AS DOUBLE) AS h, CAST(NULL AS BIGINT) AS m FROM (SELECT DISTINCT sample AS id FROM c)
UNION ALL SELECT s.step + 1, s.id, CASE WHEN s.c = z.b THEN z.a ELSE s.c END, z.a, z.b, z.h, z.m FROM s, (SELECT x.c AS a, y.c AS b, {h} AS h, count(DISTINCT x.id) + count(DISTINCT y.id) AS m FROM s x JOIN s y ON x.c < y.c JOIN f ON f.i = x.id AND f.j = y.id {more} GROUP BY x.c, y.c ORDER BY h, a, b LIMIT 1) z)"""
_DIST = _P[5:] + ", f AS (SELECT i, j, {k} AS d FROM d UNION ALL SELECT j, i, {k} FROM d)"


def _tree(h, kind="bray_curtis", more=""):
    return _CUT.format(p=_DIST.format(k=kind), h=h, more=more)


#: The squared distance of two clusters' centres from the squared distances of their members.
_WARD = "sqrt(2.0 * count(DISTINCT x.id) * count(DISTINCT y.id) / (count(DISTINCT x.id) + count(DISTINCT y.id)) * (sum(f.d * f.d) / count(*) - any_value(ix.w) - any_value(iy.w)))"
_WITHIN = "JOIN (SELECT p.c, sum(coalesce(e.d * e.d, 0)) / 2 / (count(DISTINCT p.id) ** 2) AS w FROM s p JOIN s q ON p.c = q.c LEFT JOIN f e ON e.i = p.id AND e.j = q.id GROUP BY p.c) {a} ON {a}.c = {x}.c"
_OUT = " SELECT DISTINCT a, b, round(h, 5) AS height, m AS size FROM s WHERE step > 0"
_LEVELS = """WITH RECURSIVE l AS (SELECT label AS section, vec_id AS level, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
s AS (SELECT 0 AS step, section, level, level AS c, x, y, z, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS inc, CAST(0 AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS m FROM l
UNION ALL SELECT s.step + 1, s.section, s.level, CASE WHEN s.c = k.b THEN k.a ELSE s.c END, s.x, s.y, s.z, k.a, k.b, k.inc, s.total + k.inc, k.m FROM s JOIN
 (SELECT * FROM (SELECT section, c AS a, nc AS b, n + nn AS m, n * nn / (n + nn) * ((x - nx) ** 2 + (y - ny) ** 2 + (z - nz) ** 2) AS inc FROM
  (SELECT section, c, n, x, y, z, lead(c) OVER w AS nc, lead(n) OVER w AS nn, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM (SELECT section, c, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s GROUP BY section, c) WINDOW w AS (PARTITION BY section ORDER BY c))
  WHERE nc IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY section ORDER BY inc, a) = 1) k ON k.section = s.section),
r AS (SELECT DISTINCT section, step, a, b, inc, total, m FROM s WHERE step > 0)"""

#: Correspondence: the products of the standardised residuals of any two nations, taken apart the same way.
_CA = _P.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c), rm AS (SELECT sample, CAST(sum(n) AS DOUBLE) / any_value(t) AS r FROM c, tot GROUP BY 1), cm AS (SELECT taxon, CAST(sum(n) AS DOUBLE) / any_value(t) AS c FROM c, tot GROUP BY 1),
z AS (SELECT x.sample, x.taxon, (x.n / t - r * cm.c) / sqrt(r * cm.c) AS s FROM x JOIN rm USING (sample) JOIN cm USING (taxon), tot WHERE cm.c > 0), pr AS (SELECT a.sample AS i, b.sample AS j, sum(a.s * b.s) AS g FROM z a JOIN z b USING (taxon) GROUP BY ALL), o AS (SELECT i, list(g ORDER BY j) AS row FROM pr GROUP BY i)""" + _AXES + """,
ev AS (SELECT CAST(k AS INTEGER) AS axis, e AS inertia, e / t AS eigenvalue, e / (SELECT sum(s * s) FROM z) AS share FROM v, tot WHERE k <= 3),
y AS (SELECT k, e, p, tp, list_position(list_transform(p, lambda y, h: y[h]), list_max(list_transform(p, lambda y, h: y[h]))) AS top FROM v WHERE k <= 3),
q AS (SELECT ids[u.i] AS sample, CAST(k AS INTEGER) AS axis, p[top][u.i] / sqrt(p[top][top] * tp) AS u, sqrt(greatest(e, 0)) AS sv FROM y, m, (SELECT unnest(range(1, n + 1)) AS i FROM m) u),
sc AS (SELECT sample, axis, u * sv / sqrt(r) AS value, u FROM q JOIN rm USING (sample)), sg AS (SELECT axis, sign(max_by(value, abs(value))) AS sg FROM sc GROUP BY 1), rs AS (SELECT sample, axis, value * sg AS value, u * sg AS u FROM sc JOIN sg USING (axis))"""
_DCA = _CA + """, wd AS (SELECT sample, max(value) FILTER (axis = 1) AS a, max(value) FILTER (axis = 2) AS b, max(value) FILTER (axis = 3) AS c, any_value(g) AS g FROM rs JOIN (SELECT s_nationkey AS sample, avg(s_acctbal) AS g FROM supplier GROUP BY 1) USING (sample) GROUP BY 1),
cr AS (SELECT corr(a, g) AS ag, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM wd), rr AS (SELECT 1 AS axis, ag * ag AS r2 FROM cr UNION ALL SELECT 2, ab * ab FROM cr UNION ALL SELECT 3, (ac * ac + bc * bc - 2 * ac * bc * ab) / (1 - ab * ab) FROM cr)"""

ORACLE_SQL = {
    "correspondence_eigenvalues": _CA + " SELECT axis, round(eigenvalue, 10) AS eigenvalue, round(inertia, 6) AS inertia, round(share, 6) AS share FROM ev",
    "correspondence_rows": _CA + " SELECT sample, axis, round(value, 5) AS value FROM rs",
    "correspondence_columns": _CA + " SELECT z.taxon, rs.axis, round(sum(z.s * rs.u) / sqrt(any_value(cm.c)), 4) AS value FROM z JOIN rs USING (sample) JOIN cm USING (taxon) GROUP BY 1, 2",
    "detrended_correspondence": _DCA + " SELECT axis, round(eigenvalue, 10) AS eigenvalue, round(r2, 5) AS r_squared, round(1 - r2, 5) AS retained, round(eigenvalue * (1 - r2), 10) AS detrended, CAST(row_number() OVER (ORDER BY eigenvalue * (1 - r2) DESC, axis) AS INTEGER) AS place FROM ev JOIN rr USING (axis)",
    "detrended_correspondence_rows": _DCA + " SELECT sample, axis, round(value * sqrt(1 - r2), 5) AS value FROM rs JOIN rr USING (axis)",
    "pcoa_eigenvalues": _E + """ SELECT CAST(k AS INTEGER) AS axis, round(e, 6) AS eigenvalue, round(e / (SELECT sum(e) FROM v WHERE e > 1e-9), 6) AS share, round(e / (SELECT list_sum(list_transform(m, lambda x, h: x[h])) FROM m), 6) AS share_of_trace FROM v WHERE k <= 3""",
    "pcoa_coordinates": _E + """, y AS (SELECT k, e, p, tp, list_position(list_transform(p, lambda y, h: y[h]), list_max(list_transform(p, lambda y, h: y[h]))) AS top FROM v WHERE k <= 3)
SELECT ids[u.i] AS sample, CAST(k AS INTEGER) AS axis, round(sqrt(greatest(e, 0) / tp) * p[top][u.i] / sqrt(p[top][top]), 5) AS value FROM y, m, (SELECT unnest(range(1, n + 1)) AS i FROM m) u""",
    "linkage_average": _tree("avg(f.d)") + _OUT,
    "linkage_complete": _tree("max(f.d)") + _OUT,
    "linkage_single": _tree("min(f.d)") + _OUT,
    "linkage_ward": _tree(_WARD, "euclidean", _WITHIN.format(a="ix", x="x") + " " + _WITHIN.format(a="iy", x="y")) + _OUT,
    "cut_tree": _tree("avg(f.d)") + " SELECT id, c AS cluster FROM s WHERE step = (SELECT max(step) FROM s) - 3",
    "cophenetic_correlation": _tree("avg(f.d)") + """, k AS (SELECT x.id AS i, y.id AS j, min(x.step) AS step FROM s x JOIN s y ON x.step = y.step AND x.c = y.c AND x.id < y.id GROUP BY 1, 2)
SELECT count(*) AS pairs, round(corr(f.d, s.h), 6) AS r FROM k JOIN f ON f.i = k.i AND f.j = k.j JOIN (SELECT DISTINCT step, h FROM s) s ON s.step = k.step""",
    "coniss": _LEVELS + " SELECT section, step, a, b, round(inc, 6) AS increase, round(total, 5) AS total, m AS size FROM r",
    "coniss_zones": _LEVELS + """, q AS (SELECT section, b FROM r QUALIFY row_number() OVER (PARTITION BY section ORDER BY step DESC) <= 3)
SELECT l.section, l.level, CAST(1 + (SELECT count(*) FROM q WHERE q.section = l.section AND q.b <= l.level) AS INTEGER) AS zone FROM l""",
    "broken_stick_zones": _LEVELS + """, k AS (SELECT section, inc / sum(inc) OVER (PARTITION BY section) AS share, row_number() OVER (PARTITION BY section ORDER BY inc DESC, step) AS k, count(*) OVER (PARTITION BY section) AS n FROM r)
SELECT section, CAST(k AS INTEGER) AS k, round(share, 6) AS share, round(list_sum(list_transform(range(k, n + 1), lambda i: 1.0 / i)) / n, 6) AS expected FROM k""",
}
