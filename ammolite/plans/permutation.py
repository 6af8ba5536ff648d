"""Permutation tests over supplier communities, suppliers and customers. The SQL deals the same labels by md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import communities as c
from ammolite.operators import permutation as p
from ammolite.plans import ecology

N = 999


def _pairs(s, d):
    return c.pair_distances(ecology._community(s, d))


def _suppliers(s, d):
    return s.read.parquet(f"{d}/supplier.parquet")


def _shannon(s, d):
    """Shannon entropy of each nation's parts, with the region."""
    x = ecology._community(s, d)
    h = x.groupBy("sample").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("v"))
    return h.join(ecology._groups(s, d), "sample")


QUERIES = {
    "permanova_test": lambda s, d: p.permanova_test(_pairs(s, d), "bray_curtis", ecology._present(s, d), N),
    "permanova_vectors": lambda s, d: p.permanova_vectors(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "label", N),
    "anosim_test": lambda s, d: p.anosim_test(_pairs(s, d), "bray_curtis", ecology._present(s, d), N),
    "mantel_test": lambda s, d: p.mantel_test(_pairs(s, d), "bray_curtis", "canberra", N),
    "partial_mantel_test": lambda s, d: p.partial_mantel_test(_pairs(s, d), "bray_curtis", "canberra", "manhattan", N),
    "diversity_permutation_test": lambda s, d: p.group_f_test(_shannon(s, d), N),
    "epps_singleton": lambda s, d: p.squared_cv_test(_suppliers(s, d), "s_suppkey", F.col("s_nationkey") < 12, "s_acctbal", N),
}

_DRAW = """,
key AS (SELECT rep, sample, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', '1', CAST(rep AS VARCHAR), CAST(sample AS VARCHAR))), sample) AS k FROM lab, range(1, 1000) t(rep)),
z AS (SELECT key.rep, key.sample, lab.value FROM key JOIN lab ON lab.k = key.k UNION ALL SELECT 0, sample, value FROM lab)"""
_P_OF = """,
o AS (SELECT * FROM st WHERE rep = 0), h AS (SELECT count(st.{x}) AS n_valid, count(*) FILTER ({abs}(st.{x}) >= {abs}(o.{x}) - 1e-9 * greatest(abs(o.{x}), 1e-12)) AS hits FROM st, o WHERE st.rep > 0)
SELECT {columns}, round(o.{x}, {digits}) AS {x}, n_valid, round((hits + 1) / (n_valid + 1), 6) AS p FROM o, h"""
_G = ", lab AS (SELECT n_nationkey AS sample, n_regionkey AS value, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey IN (SELECT sample FROM c))"
_ENTRY = ", lab AS (SELECT concat_ws(':', CAST(i AS VARCHAR), CAST(j AS VARCHAR)) AS sample, {v} AS value, {u} AS u, row_number() OVER (ORDER BY concat_ws(':', CAST(i AS VARCHAR), CAST(j AS VARCHAR))) AS k FROM {t})" + _DRAW + """,
st AS (SELECT z.rep, count(*) AS pairs, corr(lab.u, z.value) AS r FROM z JOIN lab ON lab.sample = z.sample GROUP BY z.rep)""" + _P_OF.format(x="r", abs="", columns="o.pairs", digits=6)

ORACLE_SQL = {
    "permanova_test": ecology._P + _G + _DRAW + """,
m AS (SELECT value, count(*) AS m FROM lab GROUP BY 1), t AS (SELECT (SELECT count(*) FROM lab) AS n, (SELECT count(*) FROM m) AS g, (SELECT sum(bray_curtis * bray_curtis) FROM d) AS q),
w AS (SELECT a.rep, sum(bray_curtis * bray_curtis / m.m) AS w FROM d JOIN z a ON a.sample = d.i JOIN z b ON b.sample = d.j AND b.rep = a.rep AND b.value = a.value JOIN m ON m.value = a.value GROUP BY a.rep),
st AS (SELECT r.rep, n, g, ((q / n - coalesce(w, 0)) / (g - 1)) / (coalesce(w, 0) / (n - g)) AS f FROM range(0, 1000) r(rep) LEFT JOIN w ON w.rep = r.rep, t)""" + _P_OF.format(x="f", abs="", columns="o.n, o.g", digits=5),
    "permanova_vectors": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.e, b.e), 5) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id), lab AS (SELECT vec_id AS sample, label AS value, row_number() OVER (ORDER BY vec_id) AS k FROM e)" + _DRAW + """,
m AS (SELECT value, count(*) AS m FROM lab GROUP BY 1), t AS (SELECT (SELECT count(*) FROM lab) AS n, (SELECT count(*) FROM m) AS g, (SELECT sum(d * d) FROM d) AS q),
w AS (SELECT a.rep, sum(d * d / m.m) AS w FROM z a JOIN z b ON b.rep = a.rep AND b.value = a.value AND a.sample < b.sample JOIN d ON d.i = a.sample AND d.j = b.sample JOIN m ON m.value = a.value GROUP BY a.rep),
st AS (SELECT w.rep, n, g, ((q / n - w) / (g - 1)) / (w / (n - g)) AS f FROM w, t)""" + _P_OF.format(x="f", abs="", columns="o.n, o.g", digits=5),
    "anosim_test": ecology._P + _G + _DRAW + """,
q AS (SELECT i, j, rank() OVER (ORDER BY bray_curtis) + (count(*) OVER (PARTITION BY bray_curtis) - 1) / 2 AS r FROM d), t AS (SELECT (SELECT sum(r) FROM q) AS t, (SELECT count(*) FROM q) AS m, (SELECT sum(k * (k - 1)) / 2 FROM (SELECT count(*) AS k FROM lab GROUP BY value)) AS mw),
w AS (SELECT a.rep, sum(r) AS w FROM q JOIN z a ON a.sample = q.i JOIN z b ON b.sample = q.j AND b.rep = a.rep AND b.value = a.value GROUP BY a.rep),
st AS (SELECT x.rep, m AS pairs, ((t - coalesce(w, 0)) / (m - mw) - coalesce(w, 0) / mw) / (m / 2) AS r FROM range(0, 1000) x(rep) LEFT JOIN w ON w.rep = x.rep, t)""" + _P_OF.format(x="r", abs="", columns="o.pairs", digits=6),
    "mantel_test": ecology._P + _ENTRY.format(u="bray_curtis", v="canberra", t="d"),
    "partial_mantel_test": ecology._P + """, f AS (SELECT regr_slope(bray_curtis, manhattan) AS bu, regr_intercept(bray_curtis, manhattan) AS au, regr_slope(canberra, manhattan) AS bv, regr_intercept(canberra, manhattan) AS av FROM d),
e AS (SELECT i, j, bray_curtis - au - bu * manhattan AS u, canberra - av - bv * manhattan AS v FROM d, f)""" + _ENTRY.format(u="u", v="v", t="e"),
    "diversity_permutation_test": ecology._C + _G + _DRAW + """,
v AS (SELECT sample, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS v FROM c GROUP BY 1), t AS (SELECT count(*) AS n, avg(v) AS m, var_pop(v) * count(v) AS sst, (SELECT count(DISTINCT value) FROM lab) AS g FROM v),
a AS (SELECT z.rep, z.value, count(*) AS k, avg(v.v) AS a FROM z JOIN v ON v.sample = z.sample GROUP BY ALL), b AS (SELECT rep, sum(k * (a - m) * (a - m)) AS ssb FROM a, t GROUP BY rep),
st AS (SELECT rep, n, g, (ssb / (g - 1)) / ((sst - ssb) / (n - g)) AS f FROM b, t)""" + _P_OF.format(x="f", abs="", columns="o.n, o.g", digits=5),
    "epps_singleton": "WITH lab AS (SELECT s_suppkey AS sample, s_nationkey < 12 AS value, s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)" + _DRAW + """,
st AS (SELECT z.rep, var_samp(v) FILTER (z.value) / avg(v) FILTER (z.value) ** 2 - var_samp(v) FILTER (NOT z.value) / avg(v) FILTER (NOT z.value) ** 2 AS statistic FROM z JOIN lab ON lab.sample = z.sample GROUP BY z.rep)
""" + _P_OF.format(x="statistic", abs="abs", columns="1 AS one", digits=6).replace("SELECT 1 AS one, ", "SELECT "),
}
