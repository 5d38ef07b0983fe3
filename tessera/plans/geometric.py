"""Queries of the geometric statistics, anomalies and series verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import geometry as G
from ..operators import series as S
from .catalog import register, table

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _t(spark, d, name):
    return table(spark, d, name)


def _rounded(df: DataFrame, n: int = 8, *skip) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in df.dtypes])


def _k(fields) -> str:
    return "(" + " + ".join(f"var_pop({f}) / pow(max({f}) - min({f}), 2)" for f in fields) + f") / {len(fields)}"


@register("curvature", f"SELECT round(k, 8) AS k, round(1 / (1 + k), 8) AS confidence, round(1 / k, 8) AS capacity FROM (SELECT {_k(LINE)} AS k FROM lineitem)")
def curvature(spark, d):
    return _rounded(G.curvature(_t(spark, d, "lineitem"), LINE))


@register("curvature_by", "SELECT event_type, round(k, 8) AS k, round(1 / (1 + k), 8) AS confidence, round(1 / k, 8) AS capacity FROM (SELECT event_type, var_pop(value) / pow(max(value) - min(value), 2) AS k FROM events GROUP BY event_type)")
def curvature_by(spark, d):
    return _rounded(G.curvature(_t(spark, d, "events"), ["value"], ["event_type"]))


@register("confidence", f"SELECT l_returnflag, round(1 / (1 + {_k(LINE)}), 8) AS confidence FROM lineitem GROUP BY l_returnflag")
def confidence(spark, d):
    return _rounded(G.curvature(_t(spark, d, "lineitem"), LINE, ["l_returnflag"]).select("l_returnflag", "confidence"))


@register("capacity", f"SELECT l_returnflag, round(0.5 / ({_k(LINE)}), 8) AS capacity FROM lineitem GROUP BY l_returnflag")
def capacity(spark, d):
    k = G.curvature(_t(spark, d, "lineitem"), LINE, ["l_returnflag"]).select("l_returnflag", "k")
    return _rounded(k.select("l_returnflag", G.capacity("k", 0.5).alias("capacity")))


@register("having_curvature", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING {_k(LINE)} > 0.08")
def having_curvature(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), G.curvature_of(LINE).alias("k")).where("k > 0.08").drop("k")


_KAPPA = "(abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) + abs(o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT max(o_custkey) - min(o_custkey) FROM orders)) / 2"


@register("record_kappa", f"SELECT o_orderkey, round({_KAPPA}, 8) AS kappa FROM orders")
def record_kappa(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return _rounded(G.record_kappa(o, ["o_totalprice", "o_custkey"]).select("o_orderkey", "kappa"))


@register("confidence_filter", f"SELECT o_orderkey FROM orders WHERE 1 / (1 + {_KAPPA}) >= 0.9")
def confidence_filter(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return G.record_kappa(o, ["o_totalprice", "o_custkey"]).where(G.confidence("kappa") >= 0.9).select("o_orderkey")


def _explain(f: str) -> str:
    return f"""SELECT o_orderkey, '{f}' AS field, {f}::DOUBLE AS value, m AS mean, s AS sigma, r AS range, abs({f} - m) / r AS kappa, ({f} - m) / s AS z
        FROM orders, (SELECT avg({f}) AS m, stddev_pop({f}) AS s, (max({f}) - min({f}))::DOUBLE AS r FROM orders) WHERE o_orderkey IN (1, 3, 7)"""


@register("explain_kappa", f"""
    SELECT o_orderkey, field, value, round(mean, 6) AS mean, round(sigma, 6) AS sigma, range, round(kappa, 8) AS kappa, round(z, 8) AS z, round(avg(kappa) OVER (PARTITION BY o_orderkey), 8) AS record_kappa
    FROM ({_explain("o_totalprice")} UNION ALL {_explain("o_custkey")})""")
def explain_kappa(spark, d):
    x = G.explain_kappa(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey", [1, 3, 7], ["o_totalprice", "o_custkey"])
    return x.select("o_orderkey", "field", "value", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"), "range", F.round("kappa", 8).alias("kappa"), F.round("z", 8).alias("z"), F.round("record_kappa", 8).alias("record_kappa"))


@register("metric_tensor", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i:]))
def metric_tensor(spark, d):
    return _rounded(G.metric_tensor(_t(spark, d, "lineitem"), LINE), 6)


@register("effective_dimension")
def effective_dimension(spark, d):
    return G.effective_dimension(_t(spark, d, "lineitem"), LINE)


@register("divergence", """
    WITH m AS (SELECT avg(value) FILTER (WHERE event_type = 'click') AS ma, var_pop(value) FILTER (WHERE event_type = 'click') AS va,
        avg(value) FILTER (WHERE event_type <> 'click') AS mb, var_pop(value) FILTER (WHERE event_type <> 'click') AS vb FROM events),
    n AS (SELECT *, (ma + mb) / 2 AS mm, (va + vb) / 2 + pow(ma - mb, 2) / 4 AS vm FROM m)
    SELECT 'value' AS field, round(0.5 * (ln(vb / va) + (va + pow(ma - mb, 2)) / vb - 1), 8) AS forward, round(0.5 * (ln(va / vb) + (vb + pow(mb - ma, 2)) / va - 1), 8) AS reverse,
        round((0.5 * (ln(vm / va) + (va + pow(ma - mm, 2)) / vm - 1) + 0.5 * (ln(vm / vb) + (vb + pow(mb - mm, 2)) / vm - 1)) / 2, 8) AS js FROM n""")
def divergence(spark, d):
    e = _t(spark, d, "events").select("event_type", "value")
    return _rounded(G.divergence(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["value"]))


@register("entropy", "SELECT count(*) AS distinct, round(-sum(n / t * ln(n / t)), 8) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY o_orderstatus, o_orderpriority)")
def entropy(spark, d):
    return _rounded(G.entropy(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@register("coarse_grain", " UNION ALL ".join(
    f"SELECT {i} AS level, count(*) AS distinct, round(-sum(n / t * ln(n / t)), 8) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY {by})"
    for i, by in enumerate(["o_orderstatus, o_orderpriority, o_custkey % 5", "o_orderstatus, o_orderpriority", "o_orderstatus"])))
def coarse_grain(spark, d):
    o = _t(spark, d, "orders").withColumn("g", F.col("o_custkey") % 5)
    return _rounded(G.coarse_grain(o, ["o_orderstatus", "o_orderpriority", "g"]))


@register("fisher", "SELECT 'value' AS field, round(1 / v, 10) AS mean_mean, round(2 / v, 10) AS sigma_sigma, round(2 / pow(v, 2), 14) AS determinant FROM (SELECT var_pop(value) AS v FROM events)")
def fisher(spark, d):
    f = G.fisher(_t(spark, d, "events"), ["value"])
    return f.select("field", F.round("mean_mean", 10).alias("mean_mean"), F.round("sigma_sigma", 10).alias("sigma_sigma"), F.round("determinant", 14).alias("determinant"))


@register("wasserstein", """
    WITH a AS (SELECT value AS v, row_number() OVER (ORDER BY value)::DOUBLE / count(*) OVER () AS q FROM events WHERE event_type = 'click'),
    b AS (SELECT value AS v, row_number() OVER (ORDER BY value)::DOUBLE / count(*) OVER () AS q FROM events WHERE event_type = 'view'),
    p AS (SELECT q, coalesce(q - lag(q) OVER (ORDER BY q), q) AS w FROM (SELECT q FROM a UNION SELECT q FROM b)),
    x AS (SELECT p.q, p.w, (SELECT min(v) FROM a WHERE a.q >= p.q) AS va, (SELECT min(v) FROM b WHERE b.q >= p.q) AS vb FROM p)
    SELECT round(sqrt(sum(w * pow(va - vb, 2))), 6) AS w2 FROM x""")
def wasserstein(spark, d):
    return _rounded(G.wasserstein(_t(spark, d, "events").select("event_type", "value"), "event_type", "click", "view", "value"), 6)


@register("pullback_curvature", """
    WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), j AS (SELECT o_totalprice, c_acctbal, c_custkey FROM orders LEFT JOIN c ON o_custkey = c_custkey),
    x AS (SELECT (SELECT var_pop(o_totalprice) / pow(max(o_totalprice) - min(o_totalprice), 2) FROM orders) AS kl, (SELECT var_pop(c_acctbal) / pow(max(c_acctbal) - min(c_acctbal), 2) FROM c) AS kr,
        (SELECT (var_pop(o_totalprice) / pow(max(o_totalprice) - min(o_totalprice), 2) + var_pop(c_acctbal) / pow(max(c_acctbal) - min(c_acctbal), 2)) / 2 FROM j) AS kp)
    SELECT round(kp, 8) AS k_pullback, (SELECT count(c_custkey) FROM j) AS matched, (SELECT count(*) - count(c_custkey) FROM j) AS unmatched, round(kl, 8) AS k_left, round(kr, 8) AS k_right,
        (SELECT count(*) FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS right_unmatched, round(kp - kl, 8) AS delta_k FROM x""")
def pullback_curvature(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    return _rounded(G.pullback_curvature(o, c, "o_custkey", "c_custkey", ["o_totalprice"], ["c_acctbal"]))


@register("recall_deviation", "SELECT o_orderpriority, round(least(n, 2500) / t, 8) AS s, round(sqrt(1 - least(n, 2500) / t), 8) AS d FROM (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY ALL)")
def recall_deviation(spark, d):
    n = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    n = n.join(F.broadcast(n.agg(F.sum("n").alias("t"))), F.lit(True))
    s, dev = G.recall_deviation(F.least("n", F.lit(2500)), F.col("t"))
    return _rounded(n.select("o_orderpriority", s.alias("s"), dev.alias("d")))


@register("deviation_norm", """SELECT c_custkey, (c_nationkey <> 0)::INT + (c_acctbal <> 0)::INT AS deviation_norm, round(sqrt(pow(c_nationkey / 24, 2) + pow(c_acctbal / 10000, 2)), 8) AS deviation_distance FROM customer""")
def deviation_norm(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = G.deviation(c, {"c_nationkey": 0, "c_acctbal": 0.0}, {"c_nationkey": 24.0, "c_acctbal": 10000.0})
    return out.select("c_custkey", "deviation_norm", F.round("deviation_distance", 8).alias("deviation_distance"))


@register("kahler", """
    WITH k AS (SELECT 64 * (var_pop(l_quantity) + var_pop(l_extendedprice)) / (pow(max(l_quantity) - min(l_quantity), 2) + pow(max(l_extendedprice) - min(l_extendedprice), 2)) AS a,
        64 * (var_pop(l_discount) + var_pop(l_tax)) / (pow(max(l_discount) - min(l_discount), 2) + pow(max(l_tax) - min(l_tax), 2)) AS b FROM lineitem)
    SELECT round((a + b) / 2, 8) AS holomorphic, round(abs(a - b) / 2, 8) AS weyl, round(sqrt(a * b), 8) AS bisectional_min, round(sqrt(a * b), 8) AS bisectional_max, round(3 * (a + b) / 8, 8) AS ricci FROM k""")
def kahler(spark, d):
    return _rounded(G.kahler(_t(spark, d, "lineitem"), LINE))


@register("holonomy_points", "SELECT round(sqrt(pow(max(o_totalprice) - min(o_totalprice), 2) + pow(max(o_custkey) - min(o_custkey), 2)), 6) AS holonomy FROM orders WHERE o_orderkey IN (1, 7)")
def holonomy_points(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return _rounded(G.local_holonomy(o, "o_orderkey", 1, 7, ["o_totalprice", "o_custkey"]), 6)


#: The turning of the loop of nations' centroids; {0} names the parts, {1} may hold a condition.
HOLONOMY = """c{0} AS (SELECT c_nationkey AS g, avg(c_acctbal) AS x, avg(c_custkey) AS y FROM customer{1} GROUP BY 1),
    d{0} AS (SELECT g, atan2(coalesce(lead(y) OVER (ORDER BY g), first_value(y) OVER (ORDER BY g)) - y, coalesce(lead(x) OVER (ORDER BY g), first_value(x) OVER (ORDER BY g)) - x) AS t FROM c{0}),
    u{0} AS (SELECT coalesce(lead(t) OVER (ORDER BY g), first_value(t) OVER (ORDER BY g)) - t AS u FROM d{0}),
    h{0} AS (SELECT count(*) AS groups, fmod(abs(sum(atan2(sin(u), cos(u)))), 2 * pi()) AS deficit FROM u{0})"""


@register("holonomy_groups", f"WITH {HOLONOMY.format('', '')} SELECT groups, round(least(deficit, 2 * pi() - deficit), 6) AS from_whole_turns FROM h")
def holonomy_groups(spark, d):
    """A closed loop turns by whole turns; what is left of them may lie on either side."""
    h = G.holonomy(_t(spark, d, "customer"), "c_acctbal", "c_custkey", "c_nationkey")
    return h.select("groups", F.round(F.least("deficit", 2 * F.pi() - F.col("deficit")), 6).alias("from_whole_turns"))


@register("mutual_information", """
    WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL)
    SELECT round(sum(n / t * ln(n * t / (na * nb))), 8) AS mutual FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM j)""")
def mutual_information(spark, d):
    return _rounded(G.mutual_information(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@register("gauge_invariance", f"SELECT round({_k(LINE)}, 8) AS k FROM lineitem")
def gauge_invariance(spark, d):
    """K after affine maps of all fields; the SQL has it before them."""
    return _rounded(G.curvature(G.affine(_t(spark, d, "lineitem"), {f: (3.0 + i, -7.0 * i) for i, f in enumerate(LINE)}), LINE).select("k"))


# -- Anomalies

@register("anomalies", """
    WITH s AS (SELECT avg(value) AS m, max(value) - min(value) AS r FROM events), k AS (SELECT event_id, abs(value - m) / r AS kappa FROM events, s WHERE user_id % 2 = 0),
    o AS (SELECT avg(kappa) AS mu, stddev_pop(kappa) AS sd FROM k)
    SELECT event_id, round(kappa, 8) AS kappa, round((kappa - mu) / sd, 6) AS z, round(1 / (1 + kappa), 8) AS confidence FROM k, o WHERE kappa > mu + 2 * sd""")
def anomalies(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "value")
    out = A.anomalies(e, ["value"], 2.0, F.col("user_id") % 2 == 0)
    return out.select("event_id", F.round("kappa", 8).alias("kappa"), F.round("z", 6).alias("z"), F.round("confidence", 8).alias("confidence"))


@register("field_anomalies", "SELECT o_orderkey, round(z, 6) AS z FROM (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders) WHERE abs(z) > 1.7")
def field_anomalies(spark, d):
    return A.field_anomalies(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.7).select("o_orderkey", F.round("z", 6).alias("z"))


@register("group_outliers", "SELECT event_id, event_type, round(z, 6) AS z FROM (SELECT event_id, event_type, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)) WHERE abs(z) > 2.5")
def group_outliers(spark, d):
    return A.field_anomalies(_t(spark, d, "events").select("event_id", "event_type", "value"), "value", 2.5, ["event_type"]).select("event_id", "event_type", F.round("z", 6).alias("z"))


@register("volatility", """
    WITH k AS (SELECT c_nationkey, var_pop(c_acctbal) / pow(max(c_acctbal) - min(c_acctbal), 2) AS k FROM customer GROUP BY ALL),
    z AS (SELECT *, (k - avg(k) OVER ()) / stddev_pop(k) OVER () AS z FROM k)
    SELECT c_nationkey, round(k, 8) AS k, round(1 / (1 + k), 8) AS confidence, round(z, 6) AS z,
        CASE WHEN z > 2 THEN 'HIGH_VOLATILITY' WHEN z > 1 THEN 'ELEVATED' WHEN z < -1 THEN 'STABLE' ELSE 'NORMAL' END AS label FROM z""")
def volatility(spark, d):
    v = A.volatility(_t(spark, d, "customer").select("c_nationkey", "c_acctbal"), ["c_acctbal"], ["c_nationkey"])
    return v.select("c_nationkey", F.round("k", 8).alias("k"), F.round("confidence", 8).alias("confidence"), F.round("z", 6).alias("z"), "label")


@register("constraint_violations", """
    SELECT 'positive' AS "constraint", c_custkey AS key FROM customer WHERE NOT c_acctbal > 0
    UNION ALL SELECT 'unique c_acctbal', c_custkey FROM customer WHERE c_acctbal IN (SELECT c_acctbal FROM customer GROUP BY c_acctbal HAVING count(*) > 1)
    UNION ALL SELECT 'references c_nationkey', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def constraint_violations(spark, d):
    few = _t(spark, d, "nation").where("n_regionkey < 3")
    return A.violations(_t(spark, d, "customer"), "c_custkey", {"positive": F.col("c_acctbal") > 0}, ["c_acctbal"], {"c_nationkey": (few, "n_nationkey")})


@register("consistency", """
    WITH m AS (SELECT *, median(c_acctbal) OVER (PARTITION BY c_nationkey) AS med, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    a AS (SELECT *, median(abs(c_acctbal - med)) OVER (PARTITION BY c_nationkey) AS mad FROM m)
    SELECT c_custkey AS key, round(CASE WHEN mad > 0 THEN 0.6745 * abs(c_acctbal - med) / mad WHEN c_acctbal <> med THEN 1e9 ELSE 0 END, 6) AS severity FROM a
    WHERE n >= 3 AND CASE WHEN mad > 0 THEN 0.6745 * abs(c_acctbal - med) / mad WHEN c_acctbal <> med THEN 1e9 ELSE 0 END > 1.2""")
def consistency(spark, d):
    return _rounded(A.consistency(_t(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", 1.2), 6)


@register("scan_context", """
    SELECT o_orderkey, round(CASE WHEN count(*) OVER w >= 3 THEN abs(o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w ELSE 0 END, 6) AS context
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def scan_context(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return A.scan_context(o, "o_orderpriority", ["o_totalprice"]).select("o_orderkey", F.round("context", 6).alias("context"))


@register("scan_velocity", "SELECT event_id, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS velocity FROM events")
def scan_velocity(spark, d):
    return A.scan_velocity(_t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "day").select("event_id", "velocity")


_GRAMS = "SELECT value, n, unnest(list_distinct(CASE WHEN length(value) >= 3 THEN list_transform(range(1, length(value) - 1), lambda i: substr(lower(value), i, 3)) ELSE [lower(value)] END)) AS g FROM c"


@register("scan_text", f"""
    WITH c AS (SELECT name AS value, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT 'PROM' || (p_partkey % 3) || 'O' FROM part WHERE p_partkey < 9) GROUP BY name),
    g AS ({_GRAMS}), s AS (SELECT value, n, count(*) AS size FROM g GROUP BY ALL),
    p AS (SELECT a.value, b.value AS other, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.n < 8 AND b.n >= 8 GROUP BY ALL),
    near AS (SELECT p.value, max(c / (x.size + y.size - c)) AS near FROM p JOIN s x ON x.value = p.value JOIN s y ON y.value = p.other WHERE c / (x.size + y.size - c) BETWEEN 0.45 AND 0.97 GROUP BY p.value)
    SELECT c.value, n, round(coalesce(near, 0), 8) AS near, round(1 - n / (SELECT max(n) FROM c), 8) AS rarity FROM c LEFT JOIN near ON near.value = c.value WHERE n < 8""")
def scan_text(spark, d):
    p = _t(spark, d, "part")
    names = p.select(F.col("p_name").alias("name")).union(p.select("p_type")).union(p.where("p_partkey < 9").select(F.concat(F.lit("PROM"), (F.col("p_partkey") % 3).cast("string"), F.lit("O"))))
    return _rounded(A.scan_text(names, "name"))


_SQUASH = "greatest({0}, 0) / (greatest({0}, 0) + 6)"


@register("scan_fused", f"""
    WITH k AS (SELECT event_id, abs(value - avg(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS kappa, abs(value - avg(value) OVER t) / stddev_pop(value) OVER t AS context, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS velocity FROM events WINDOW t AS (PARTITION BY event_type)),
    m AS (SELECT *, (kappa - avg(kappa) OVER ()) / stddev_pop(kappa) OVER () AS g, (SELECT median(velocity) FROM k) AS med, avg(velocity) OVER () AS mu, stddev_pop(velocity) OVER () AS sd FROM k),
    r AS (SELECT *, 1.4826 * (SELECT median(abs(velocity - med)) FROM m) AS mad FROM m),
    f AS (SELECT event_id, greatest({_SQUASH.format("g")}, {_SQUASH.format("context")}, {_SQUASH.format("(CASE WHEN mad > 1e-12 THEN (velocity - med) / mad WHEN sd > 1e-12 THEN (velocity - mu) / sd ELSE 0 END)")}) AS fused FROM r)
    SELECT event_id, round(fused, 6) AS fused, fused > (SELECT quantile_cont(fused, 0.95) FROM f) AS flagged FROM f""")
def scan_fused(spark, d):
    e = A.scan_velocity(A.scan_context(_t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value"), "event_type", ["value"]), "user_id", "ts", "day")
    z = A.robust_z(e, "velocity").withColumnRenamed("z", "speed")
    return A.fused(A.scan_global(z, ["value"]), ["global", "context", "speed"]).select("event_id", F.round("fused", 6).alias("fused"), "flagged")


@register("episodic", """
    WITH g AS (SELECT user_id, e AS "at", lead(e) OVER (PARTITION BY user_id ORDER BY e) - e AS gap FROM (SELECT user_id, epoch_us(ts) AS e FROM events)), k AS (SELECT * FROM g WHERE gap IS NOT NULL),
    m AS (SELECT user_id, greatest(gap::DOUBLE, 1e-6 * top) AS mid FROM (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS r, count(*) OVER w AS n, max(gap) OVER w AS top FROM k WINDOW w AS (PARTITION BY user_id)) WHERE r = n // 2 + 1)
    SELECT user_id, "at", gap, round(gap / mid, 6) AS ratio FROM k JOIN m USING (user_id) WHERE gap / mid >= 3""")
def episodic(spark, d):
    e = _t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("e"))
    return _rounded(A.episodes(e, "e", by="user_id"), 6)


# -- Series

@register("kappa_prefix", """
    SELECT event_id, round(CASE WHEN count(value) OVER w >= 2 AND max(value) OVER w > min(value) OVER w THEN abs(value - avg(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS kappa
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def kappa_prefix(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return S.prefix_kappa(e, "user_id", "ts", "value").select("event_id", F.round("kappa", 6).alias("kappa"))


@register("rolling_curvature", """
    SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN var_pop(value) OVER w / pow(max(value) OVER w - min(value) OVER w, 2) ELSE 0 END, 6) AS k
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)""")
def rolling_curvature(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return S.rolling_curvature(e, "user_id", "ts", "value").select("event_id", F.round("k", 6).alias("k"))


@register("changepoint_stat", """
    WITH x AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n,
        (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events),
    y AS (SELECT *, avg(z) OVER b AS mb, avg(z) OVER a AS ma, var_pop(z) OVER b AS vb, var_pop(z) OVER a AS va FROM x
        WINDOW b AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING))
    SELECT event_id, event_type, i, round(abs(ma - mb) / (sqrt((va + vb) / 2) * sqrt(2 / 40)), 6) AS stat FROM y WHERE i >= 40 AND i < n - 40""")
def changepoint_stat(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return S.change_statistic(e, "event_type", "ts", "value").select("event_id", "event_type", F.col("i").cast("long").alias("i"), F.round("stat", 6).alias("stat"))


@register("changepoints")
def changepoints(spark, d):
    e = _t(spark, d, "events").select("event_type", "ts", "value")
    return S.change_points(e, "event_type", "ts", "value", threshold=3.0)


@register("texture", """
    WITH x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, value AS v FROM events),
    o AS (SELECT event_type, count(*) AS n FROM x GROUP BY event_type HAVING count(*) >= 64 AND var_pop(v) > 0), h AS (SELECT *, least(greatest(n // 8, 2), n // 2)::DOUBLE AS hi FROM o),
    l AS (SELECT DISTINCT event_type, n, floor(exp(k / 11.0 * ln(hi)) + 0.5)::INT AS lag FROM h, range(0, 12) t(k)),
    m AS (SELECT a.event_type, n, lag, avg(pow(b.v - a.v, 2)) AS m FROM l JOIN x a ON a.event_type = l.event_type JOIN x b ON b.event_type = l.event_type AND b.i = a.i + lag GROUP BY ALL HAVING count(*) >= 20),
    s AS (SELECT event_type, n, regr_slope(ln(m), ln(lag)) / 2 AS hurst, regr_r2(ln(m), ln(lag)) AS r2, 2 * 0.29 * pow(n, -0.267) AS band FROM m GROUP BY event_type, n HAVING count(*) >= 4)
    SELECT event_type, n, round(hurst, 6) AS hurst, round(r2, 6) AS r2, CASE WHEN hurst > 0.5 + band THEN 'PERSISTENT' WHEN hurst < 0.5 - band THEN 'ANTIPERSISTENT' ELSE 'DIFFUSIVE' END AS verdict FROM s""")
def texture(spark, d):
    return _rounded(S.texture(_t(spark, d, "events"), "event_type", "ts", "value"), 6)


@register("precedence_area", """
    WITH p AS (SELECT event_type, ts, value - first_value(value) OVER w AS x, (user_id - first_value(user_id) OVER w)::DOUBLE AS y FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    q AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, count(*) AS n, round(0.5 * sum(x * dy - y * dx) / sqrt(sum(dx * dx) * sum(dy * dy)), 6) AS area FROM q GROUP BY event_type""")
def precedence_area(spark, d):
    return _rounded(S.precedence(_t(spark, d, "events"), "event_type", "ts", "value", "user_id"), 6)


@register("precedence_null")
def precedence_null(spark, d):
    return S.precedence_p(_t(spark, d, "events"), "event_type", "ts", "value", "user_id")


@register("cadence_index", """
    WITH g AS (SELECT event_type, (lead(t) OVER (PARTITION BY event_type ORDER BY t) - t)::DOUBLE AS gap FROM (SELECT DISTINCT event_type, epoch_us(ts) AS t FROM events)),
    r AS (SELECT event_type, count(gap) AS n, sum(gap * gap) / pow(sum(gap), 2) AS r FROM g GROUP BY event_type HAVING count(gap) >= 63)
    SELECT event_type, n, round(sqrt((n + 1) / (n - 1) * (n * r - 1)), 6) AS cadence FROM r""")
def cadence_index(spark, d):
    e = _t(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return _rounded(S.cadence(e, "event_type", "t").where("refused is null").select("event_type", "n", "cadence"), 6)


@register("jackknife")
def jackknife(spark, d):
    return S.jackknife(_t(spark, d, "events"), "event_type", "ts", "value")


@register("coherence", """
    WITH s AS (SELECT event_type, atan2(lead(user_id) OVER w - user_id, lead(value) OVER w - value) AS t FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, round(sqrt(pow(avg(cos(t)), 2) + pow(avg(sin(t)), 2)), 8) AS coherence FROM s WHERE t IS NOT NULL GROUP BY event_type""")
def coherence(spark, d):
    return _rounded(S.coherence(_t(spark, d, "events"), "event_type", "ts", "value", "user_id"))
