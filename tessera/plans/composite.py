"""Queries of the composite and numerical verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advanced as X
from ..operators import anomaly as A
from .catalog import register, table
from .geometric import HOLONOMY


def _t(spark, d, name):
    return table(spark, d, name)


@register("horizon")
def horizon(spark, d):
    return X.horizon(_t(spark, d, "customer"), ["c_acctbal"], ["c_nationkey", "c_mktsegment"])


@register("free_energy", """
    WITH r AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS i, greatest(count(*) OVER () // 50, 1) AS step FROM customer), p AS (SELECT * FROM r WHERE i % step = 0 AND i < 50 * step),
    z AS (SELECT k, tau, sum(CASE WHEN c_custkey <> k THEN exp(-abs(v - c_acctbal) / 11000 / tau) ELSE 0 END) AS z FROM p JOIN customer ON c_nationkey = g, (SELECT unnest([0.1::DOUBLE, 0.5, 1.0]) AS tau) GROUP BY ALL)
    SELECT tau, round(avg(-tau * ln(1 + z)), 8) AS f FROM z GROUP BY tau""")
def free_energy(spark, d):
    return X.free_energy(_t(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", 11000.0).withColumn("f", F.round("f", 8))


@register("health", """
    SELECT (SELECT count(*) FROM customer) AS records, round(k, 8) AS k, round(1 / (1 + k), 8) AS confidence, (SELECT round(-sum(n / t * ln(n / t)), 8) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM customer GROUP BY c_nationkey)) AS entropy,
        (SELECT count(DISTINCT c_nationkey) FROM customer) AS beta_0,
        (SELECT sum(n * (n - 1) // 2)::BIGINT - sum(n)::BIGINT + count(*) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS beta_1
    FROM (SELECT var_pop(c_acctbal) / pow(max(c_acctbal) - min(c_acctbal), 2) AS k FROM customer)""")
def health(spark, d):
    h = X.health(_t(spark, d, "customer"), "c_custkey", ["c_acctbal"], ["c_nationkey"])
    return h.select("records", *[F.round(c, 8).alias(c) for c in ("k", "confidence", "entropy")], "beta_0", "beta_1")


@register("invariant", "SELECT round(k + 2 / (1 + k), 8) AS value FROM (SELECT var_pop(c_acctbal) / pow(max(c_acctbal) - min(c_acctbal), 2) AS k FROM customer)")
def invariant(spark, d):
    return X.invariant(_t(spark, d, "customer"), "k + 2 * confidence", "c_custkey", ["c_acctbal"], ["c_nationkey"]).select(F.round("value", 8).alias("value"))


@register("gauge_test", f"""
    WITH {HOLONOMY.format("a", "")}, {HOLONOMY.format("b", " WHERE c_custkey % 2 = 0")}, x AS (SELECT abs(ha.deficit - hb.deficit) AS d FROM ha, hb)
    SELECT round(least(d, 2 * pi() - d), 6) AS delta, least(d, 2 * pi() - d) < pi() / 10 AS invariant FROM x""")
def gauge_test(spark, d):
    c = _t(spark, d, "customer")
    return X.gauge_test(c, c.where("c_custkey % 2 = 0"), "c_acctbal", "c_custkey", "c_nationkey").withColumn("delta", F.round("delta", 6))


@register("transport_rotation")
def transport_rotation(spark, d):
    return X.transport(_t(spark, d, "orders"), "o_orderkey", 1, 7, ["o_custkey", "o_totalprice"])


@register("propagate", """
    WITH h AS (SELECT w, c_custkey, c_nationkey, CASE WHEN w = 1 AND c_custkey % 20 = 0 THEN 5000 WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS v FROM customer, (SELECT unnest([0, 1]) AS w)),
    m AS (SELECT *, median(v) OVER (PARTITION BY w, c_nationkey) AS med FROM h WHERE v IS NOT NULL), a AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY w, c_nationkey) AS mad FROM m),
    p AS (SELECT w, c_nationkey, avg(v) AS predicted FROM a WHERE (mad = 0 AND v = med) OR (mad > 0 AND 0.6745 * abs(v - med) / mad <= 3) GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT w, c_custkey AS key, predicted FROM h JOIN p USING (w, c_nationkey) WHERE v IS NULL)
    SELECT key, round(b.predicted, 6) AS before, round(a.predicted, 6) AS after FROM (SELECT * FROM c WHERE w = 0) b FULL JOIN (SELECT * FROM c WHERE w = 1) a USING (key)
    WHERE b.predicted IS NULL OR a.predicted IS NULL OR abs(b.predicted - a.predicted) > 1e-9 * greatest(1, abs(b.predicted))""")
def propagate(spark, d):
    h = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("v"))
    out = X.propagate(h, "c_custkey", "v", "c_nationkey", h.where("c_custkey % 20 = 0").select("c_custkey", F.lit(5000.0).alias("v")))
    return out.select("key", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@register("complete_across", """
    SELECT o_orderkey AS key, round(avg(l_extendedprice), 8) AS predicted, round(0.8 * count(*) / (count(*) + 1), 8) AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 7 = 0 GROUP BY o_orderkey""")
def complete_across(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    out = X.completed_across(o, "o_orderkey", "v", "o_orderkey", _t(spark, d, "lineitem"), "l_orderkey", "l_extendedprice")
    return out.select("key", F.round("predicted", 8).alias("predicted"), F.round("confidence", 8).alias("confidence"))


_AGAINST = """SELECT '{0}' AS candidate, count(*) AS contradictions FROM (SELECT *, median(abs(c_acctbal - med)) OVER (PARTITION BY {0}) AS mad FROM (SELECT *, median(c_acctbal) OVER (PARTITION BY {0}) AS med, count(*) OVER (PARTITION BY {0}) AS n FROM customer))
    WHERE n >= 3 AND CASE WHEN mad > 0 THEN 0.6745 * abs(c_acctbal - med) / mad WHEN c_acctbal <> med THEN 1e9 ELSE 0 END > 1.2"""


@register("suggest_adjacency", " UNION ALL ".join(_AGAINST.format(c) for c in ("c_nationkey", "c_mktsegment")))
def suggest_adjacency(spark, d):
    return X.suggest_adjacency(_t(spark, d, "customer"), "c_custkey", "c_acctbal", ["c_nationkey", "c_mktsegment"], 1.2)


@register("fk_mismatch", "SELECT o_orderkey AS key, o_custkey % 25 AS own, c_nationkey AS theirs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 25 <> c_nationkey")
def fk_mismatch(spark, d):
    o = _t(spark, d, "orders").withColumn("n", F.col("o_custkey") % 25)
    return X.mismatches(o, "o_orderkey", "o_custkey", "n", _t(spark, d, "customer"), "c_custkey", "c_nationkey")


@register("implications", """
    WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS src, n_nationkey AS dst FROM nation WHERE n_regionkey <> n_nationkey), r(node, depth) AS (SELECT 1, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 5)
    SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def implications(spark, d):
    e = _t(spark, d, "nation").where("n_regionkey <> n_nationkey").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")).distinct()
    return X.implications(e, 1)


@register("contradictions", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN (s_acctbal + s_acctbal + 100) / 2 ELSE s_acctbal END AS s_acctbal, 0 AS branch FROM supplier")
def contradictions(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return X.resolved(s, s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 100), "s_suppkey", "s_acctbal", 10.0, "repair")


@register("knn_join", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[]::DOUBLE[64] AS e FROM embeddings)
    SELECT a.vec_id AS query, b.vec_id AS key, round(array_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.e, b.e), b.vec_id) <= 5""")
def knn_join(spark, d):
    e = _t(spark, d, "embeddings")
    return X.neighbours_of(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "key", F.round("distance", 6).alias("distance"))


_PAIRS = "(SELECT a.vec_id AS q, b.vec_id AS k, b.label AS label, array_distance(a.e, b.e) AS d FROM v a JOIN v b ON {0} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.e, b.e), b.vec_id) <= {1})"
_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[]::DOUBLE[64] AS e FROM embeddings)"
_HELD = "a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0"


@register("infer_knn", f"""
    WITH {_VEC}, n AS {_PAIRS.format(_HELD, 20)}, w AS (SELECT q, label, pow(1 - pow(least(d / greatest(max(d) OVER (PARTITION BY q) * 1.0001, 1e-12), 1), 3), 3) AS w FROM n), s AS (SELECT q, sum(w * label) / sum(w) AS p, pow(sum(w), 2) / sum(w * w) AS n FROM w GROUP BY q)
    SELECT q AS key, round(p, 6) AS predicted, round(n / (n + 1), 6) AS confidence FROM s""")
def infer_knn(spark, d):
    e = _t(spark, d, "embeddings")
    return X.infer(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "label").select("key", F.round("predicted", 6).alias("predicted"), F.round("confidence", 6).alias("confidence"))


@register("knn_vote", f"WITH {_VEC}, n AS {_PAIRS.format(_HELD, 10)} SELECT q AS key, label FROM n GROUP BY q, label QUALIFY row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) = 1")
def knn_vote(spark, d):
    e = _t(spark, d, "embeddings")
    return X.vote(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "label")


@register("density_lof", f"""
    WITH {_VEC}, n AS {_PAIRS.format("a.vec_id <> b.vec_id", 10)}, kd AS (SELECT q, max(d) AS kd FROM n GROUP BY q), r AS (SELECT n.q, 1 / greatest(avg(greatest(d, kd.kd)), 1e-12) AS lrd FROM n JOIN kd ON kd.q = n.k GROUP BY n.q)
    SELECT n.q AS key, round(avg(t.lrd) / any_value(o.lrd), 6) AS lof FROM n JOIN r t ON t.q = n.k JOIN r o ON o.q = n.q GROUP BY n.q""")
def density_lof(spark, d):
    return X.local_density(_t(spark, d, "embeddings"), "vec_id", "embedding").withColumn("lof", F.round("lof", 6))


@register("dbscan")
def dbscan(spark, d):
    return X.dbscan(_t(spark, d, "embeddings"), "vec_id", "embedding")


@register("spectral_clusters")
def spectral_clusters(spark, d):
    return X.spectral_clusters(_t(spark, d, "embeddings"), "vec_id", "embedding", 10)


@register("prescribe")
def prescribe(spark, d):
    return X.prescribe(_t(spark, d, "embeddings"), "vec_id", "embedding")


@register("approximate_neighbours")
def approximate_neighbours(spark, d):
    return X.approximate_neighbours(_t(spark, d, "embeddings"), "vec_id", "embedding", [0.05] * 64)


@register("persistence")
def persistence(spark, d):
    return X.persistence(_t(spark, d, "supplier"), ["s_acctbal", "s_nationkey"])


@register("autochart")
def autochart(spark, d):
    return X.autochart(_t(spark, d, "events"), "event_type", "ts", "value")


@register("sample")
def sample(spark, d):
    return X.sample(_t(spark, d, "lineitem"), ["l_quantity", "l_tax"], 1000)


@register("forecast", """
    WITH x AS (SELECT event_type, ts, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events), f AS (SELECT event_type, regr_slope(v, p) AS a, avg(v) AS m, arg_max(v, ts) AS last FROM x GROUP BY event_type)
    SELECT event_type, s::INT AS step, round(m + pow(a, s) * (last - m), 6) AS value FROM f, (SELECT unnest([1, 2, 3]) AS s)""")
def forecast(spark, d):
    return X.forecast(_t(spark, d, "events"), "event_type", "ts", "value").withColumn("value", F.round("value", 6))


@register("lattice_flux", "SELECT range AS v, 0.0::DOUBLE AS flux FROM range(0, 64)")
def lattice_flux(spark, d):
    """A pure gauge, the difference of a vertex function, has no flux through any face."""
    v, e = X.lattice(spark, 8, 8)
    f = v.select("v", F.sin(F.col("v").cast("double")).alias("f"))
    e = e.join(f.select(F.col("v").alias("src"), F.col("f").alias("fs")), "src").join(f.select(F.col("v").alias("dst"), F.col("f").alias("fd")), "dst").withColumn("theta", F.col("fd") - F.col("fs"))
    flux = X.plaquettes(e, 8, 8)
    return flux.select("v", F.abs(F.round("flux", 9)).alias("flux"))


@register("lattice_laplacian", "SELECT 0::BIGINT AS total")
def lattice_laplacian(spark, d):
    v, e = X.lattice(spark, 6, 5)
    out = X.laplacian(v.withColumn("f", F.col("v") * F.col("v")), e, "f")
    return out.agg(F.sum("out").cast("long").alias("total"))


@register("gibbs")
def gibbs(spark, d):
    return X.gibbs(X.lattice(spark, 6, 6)[1], 0.3, 2, 10)


@register("diameter", "SELECT 6 AS diameter")
def diameter(spark, d):
    return X.diameter(X.lattice(spark, 6, 6)[1])


@register("euler", "SELECT count(DISTINCT c_nationkey) - (sum(n * (n - 1) // 2)::BIGINT - sum(n)::BIGINT + count(*)) AS euler FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)")
def euler(spark, d):
    return X.euler(_t(spark, d, "customer"), "c_custkey", ["c_nationkey"])


@register("partition_match", "SELECT c_custkey, round(exp(-abs(c_acctbal - 100) / 11000 / 0.5), 8) AS weight FROM customer")
def partition_match(spark, d):
    return X.attend_partition(_t(spark, d, "customer"), "c_custkey", {"c_acctbal": 100.0}, {"c_acctbal": 11000.0}, 0.5).withColumn("weight", F.round("weight", 8))


@register("vector_ball", "SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - 0.05, 2))) AS d FROM embeddings) WHERE d <= 1.0")
def vector_ball(spark, d):
    return X.within_ball(_t(spark, d, "embeddings"), "embedding", [0.05] * 64, 1.0).select("vec_id")


@register("scan_supervised")
def scan_supervised(spark, d):
    """Lens weights learned from marked rows; the mark does not follow from any lens."""
    e = A.scan_velocity(A.scan_context(A.scan_global(_t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value"), ["value"]), "event_type", ["value"]), "user_id", "ts", "day")
    e = e.withColumn("label", (F.col("user_id") % 10 == 0).cast("int"))
    return A.fitted_weights(e, "event_id", ["global", "context", "velocity"], "label")
