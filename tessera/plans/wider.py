"""Queries of ranks, sameness, wider lenses, inference, spectra and joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advanced as X
from ..operators import anomaly as A
from ..operators import geometry as G
from ..operators import graph as GR
from ..operators import inference as I
from ..operators import relational as R
from ..operators import sealing as SE
from ..operators import series as S
from ..operators import vectors as V
from ..operators import writes as WR
from .catalog import register, table


def _t(spark, d, name):
    return table(spark, d, name)


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_K = "(SELECT o_orderkey, (abs(o_totalprice - avg(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) + abs(o_custkey - avg(o_custkey) OVER ()) / (max(o_custkey) OVER () - min(o_custkey) OVER ())) / 2 AS kappa FROM orders)"


@register("kappa_rank", f"SELECT o_orderkey, round(kappa, 8) AS kappa, rank() OVER (ORDER BY round(kappa, 10) DESC)::BIGINT AS kappa_rank FROM {_K}")
def kappa_rank(spark, d):
    o = G.record_kappa(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], fine=True)
    # As SQL rounds: the scaled double, not its decimal digits, half up.
    scaled = lambda n: F.floor(F.col("kappa") * 10.0**n + 0.5) / 10.0**n
    o = G.ranks(o.withColumn("k", scaled(10)), "k", "kappa_rank")
    return o.select("o_orderkey", scaled(8).alias("kappa"), "kappa_rank")


@register("sameness", """
    WITH m AS (SELECT avg(c_acctbal) AS ma, max(c_acctbal) - min(c_acctbal) AS ra, avg(c_nationkey) AS mn, (max(c_nationkey) - min(c_nationkey))::DOUBLE AS rn FROM customer),
    v AS (SELECT c_custkey, (c_acctbal - ma) / ra AS a, (c_nationkey - mn) / rn AS n, (1000 - ma) / ra AS ra, (3 - mn) / rn AS rn FROM customer, m),
    s AS (SELECT c_custkey, (1 + (a * ra + n * rn) / sqrt((a * a + n * n) * (ra * ra + rn * rn))) / 2 AS same FROM v)
    SELECT c_custkey, round(same, 8) AS same, round(sqrt(1 - same), 6) AS dist FROM s""")
def sameness(spark, d):
    s = G.sameness(_t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], {"c_acctbal": 1000.0, "c_nationkey": 3.0})
    return s.select("c_custkey", F.round("same", 8).alias("same"), F.round("dist", 6).alias("dist"))


@register("sameness_rank", """
    WITH m AS (SELECT avg(c_acctbal) AS ma, max(c_acctbal) - min(c_acctbal) AS ra, avg(c_nationkey) AS mn, (max(c_nationkey) - min(c_nationkey))::DOUBLE AS rn FROM customer),
    v AS (SELECT c_custkey, (c_acctbal - ma) / ra AS a, (c_nationkey - mn) / rn AS n, (1000 - ma) / ra AS ra, (3 - mn) / rn AS rn FROM customer, m)
    SELECT c_custkey, rank() OVER (ORDER BY round((1 + (a * ra + n * rn) / sqrt((a * a + n * n) * (ra * ra + rn * rn))) / 2, 10) DESC)::BIGINT AS sameness_rank FROM v""")
def sameness_rank(spark, d):
    s = G.sameness(_t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], {"c_acctbal": 1000.0, "c_nationkey": 3.0})
    return G.ranks(s.withColumn("s", F.round("same", 10)), "s", "sameness_rank").select("c_custkey", "sameness_rank")


@register("as_of_join", "SELECT e.event_id, r.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE e.event_type <> 'purchase'")
def as_of_join(spark, d):
    e = _t(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    own = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return R.as_of(own, bought, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@register("theta_join", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal")
def theta_join(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return R.theta(o, _t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_totalprice") > 40 * F.col("c_acctbal"), ["c_custkey"]).select("o_orderkey", "c_custkey")


@register("iterate_accumulate", """
    WITH RECURSIVE w(depth, k, total) AS (SELECT 0, 1::BIGINT, s_acctbal FROM supplier WHERE s_suppkey = 1
        UNION ALL SELECT depth + 1, k + 1, total + s_acctbal FROM w JOIN supplier ON s_suppkey = k + 1 WHERE depth < 6)
    SELECT depth, k AS s_suppkey, round(total, 4) AS total FROM w""")
def iterate_accumulate(spark, d):
    s = _t(spark, d, "supplier").withColumn("next", F.col("s_suppkey") + 1)
    top = s.agg(F.max("s_suppkey").alias("m"))
    s = s.join(F.broadcast(top), F.lit(True)).withColumn("next", F.when(F.col("next") <= F.col("m"), F.col("next")))
    return R.iterate(s, "s_suppkey", "next", 1, 6, "s_acctbal").select("depth", "s_suppkey", F.round("total", 4).alias("total"))


@register("scan_interaction", """
    WITH b AS (SELECT o_orderkey, o_orderpriority, o_totalprice, least(floor((o_custkey - min(o_custkey) OVER ()) / (max(o_custkey) OVER () - min(o_custkey) OVER ()) * 12), 11) AS bin FROM orders)
    SELECT o_orderkey, round(CASE WHEN count(*) OVER w >= 3 AND stddev_pop(o_totalprice) OVER w > 1e-12 THEN abs(o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w ELSE 0 END, 6) AS interaction
    FROM b WINDOW w AS (PARTITION BY o_orderpriority, bin)""")
def scan_interaction(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    return A.scan_interaction(o, "o_orderpriority", "o_custkey", ["o_totalprice", "o_custkey"]).select("o_orderkey", F.round("interaction", 6).alias("interaction"))


@register("scan_relational", """
    WITH r AS (SELECT o_orderkey, o_custkey % 25 AS own, c_nationkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / (count(*) OVER () - 1) AS share FROM (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey))
    SELECT o_orderkey, round(CASE WHEN c_nationkey IS NOT NULL AND own <> c_nationkey THEN 0.4 + 0.6 * share ELSE 0 END, 4) AS relational FROM r""")
def scan_relational(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("n"), F.struct("o_totalprice", "o_orderkey").alias("amount"))
    out = A.scan_relational(o, "o_custkey", "n", "amount", _t(spark, d, "customer"), "c_custkey", "c_nationkey")
    return out.select("o_orderkey", F.round("relational", 4).alias("relational"))


@register("foreign_keys", """
    SELECT field, share FROM (SELECT 'o_orderkey' AS field, count(*) FILTER (WHERE v IN (SELECT c_custkey FROM customer)) / count(*) AS share FROM (SELECT DISTINCT o_orderkey AS v FROM orders)
        UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE v IN (SELECT c_custkey FROM customer)) / count(*) FROM (SELECT DISTINCT o_custkey AS v FROM orders)) WHERE share >= 0.5""")
def foreign_keys(spark, d):
    return A.foreign_keys(_t(spark, d, "orders"), _t(spark, d, "customer"), "c_custkey")


@register("scan_completion")
def scan_completion(spark, d):
    return A.scan_completion(_t(spark, d, "embeddings"), "vec_id", "embedding", 10)


def _features(spark, d):
    li = _t(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 1000).alias("m"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("y"))
    return R.cut(I.standardised(li, "p_partkey", ["p_size", "m"], "y"))


@register("infer_local_linear")
def infer_local_linear(spark, d):
    f = _features(spark, d)
    return _rounded(I.local_linear(f.where("y is not null"), f.where("y is null").select("key", "x")))


@register("infer_ols", """
    WITH p AS (SELECT p_partkey AS key, p_size, p_partkey % 1000 AS m, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS y FROM part),
    g AS (SELECT count(*)::DOUBLE AS n, sum(p_size) AS a, sum(m) AS b, sum(p_size * p_size) AS aa, sum(p_size * m) AS ab, sum(m * m) AS bb, sum(y) AS y, sum(y * p_size) AS ya, sum(y * m) AS yb FROM p WHERE y IS NOT NULL),
    c AS (SELECT aa - a * a / n AS saa, ab - a * b / n AS sab, bb - b * b / n AS sbb, ya - y * a / n AS sya, yb - y * b / n AS syb, a / n AS ma, b / n AS mb, y / n AS my FROM g),
    s AS (SELECT *, (sya * sbb - syb * sab) / (saa * sbb - sab * sab) AS ba, (syb * saa - sya * sab) / (saa * sbb - sab * sab) AS bb FROM c)
    SELECT key, round(my + ba * (p_size - ma) + bb * (m - mb), 4) AS mean FROM p, s WHERE p.y IS NULL""")
def infer_ols(spark, d):
    f = _features(spark, d)
    return I.least_squares(f.where("y is not null"), f.where("y is null").select("key", "x")).select("key", F.round("mean", 4).alias("mean"))


@register("infer_conformal")
def infer_conformal(spark, d):
    return _rounded(I.conformal(_features(spark, d)))


@register("infer_diffusion")
def infer_diffusion(spark, d):
    return _rounded(I.diffusion(_features(spark, d), rounds=10))


def _classes(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("y"))
    return R.cut(e)


@register("infer_labels")
def infer_labels(spark, d):
    return I.propagated_labels(_classes(spark, d), rounds=10)


@register("infer_linear_classes")
def infer_linear_classes(spark, d):
    c = _classes(spark, d)
    return I.linear_classes(c.where("y is not null"), c.where("y is null"))


@register("windowed_coherence", """
    WITH p AS (SELECT user_id, row_number() OVER w - 1 AS start, atan2(lead(event_id) OVER w, lead(value) OVER w) - atan2(event_id, value) AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, start, sum(turn) OVER v AS angle, count(turn) OVER v AS c FROM p WINDOW v AS (PARTITION BY user_id ORDER BY start ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
    SELECT user_id, start, round(1 - abs(sin(angle / 2)), 6) AS coherence, 1 - abs(sin(angle / 2)) >= 0.7 AS laminar FROM s WHERE c = 7""")
def windowed_coherence(spark, d):
    w = S.windowed_coherence(_t(spark, d, "events"), "user_id", "ts", "value", "event_id")
    return w.select("user_id", F.col("start").cast("long").alias("start"), F.round("coherence", 6).alias("coherence"), "laminar")


@register("thermodynamics")
def thermodynamics(spark, d):
    return X.thermodynamics(_t(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", 11000.0)


@register("holonomy_near")
def holonomy_near(spark, d):
    c = _t(spark, d, "customer")
    return X.holonomy_near(c, "c_acctbal", "c_custkey", "c_nationkey", {"c_acctbal": 5000.0}, 0.3, {"c_acctbal": 11000.0})


@register("spectrum")
def spectrum(spark, d):
    return GR.spectrum(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("mixing")
def mixing(spark, d):
    return GR.mixing(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("conductance", """
    WITH e AS (SELECT a.c_acctbal > 5000 AS x, b.c_acctbal > 5000 AS y FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey AND (a.c_nationkey = b.c_nationkey OR a.c_mktsegment = b.c_mktsegment)),
    s AS (SELECT count(*) FILTER (WHERE x AND NOT y) AS cut, least(count(*) FILTER (WHERE x), count(*) FILTER (WHERE NOT x)) AS volume FROM e)
    SELECT cut, volume, round(cut / volume, 8) AS conductance FROM s""")
def conductance(spark, d):
    return GR.conductance(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_acctbal") > 5000).withColumn("conductance", F.round("conductance", 8))


@register("ricci")
def ricci(spark, d):
    return GR.ricci(_t(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"], 3, 9)


@register("cyclic_edges")
def cyclic_edges(spark, d):
    from .applied import _flows

    return GR.cyclic_edges(_flows(spark, d), 10)


@register("geodesic_path")
def geodesic_path(spark, d):
    from .applied import _ring

    return GR.path(_ring(spark, d), 0, 13)


@register("cadence_full")
def cadence_full(spark, d):
    e = _t(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return _rounded(S.cadence(e, "event_type", "t"))


@register("pca_report")
def pca_report(spark, d):
    return V.pca_report(_t(spark, d, "embeddings"), "embedding", 5)


@register("sharded_curvature", "SELECT round((var_pop(o_totalprice) / pow(max(o_totalprice) - min(o_totalprice), 2) + var_pop(o_custkey) / pow(max(o_custkey) - min(o_custkey), 2)) / 2, 8) AS k FROM orders")
def sharded_curvature(spark, d):
    return G.merged_curvature(G.shard_state(_t(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderpriority")).withColumn("k", F.round("k", 8))


@register("ridge_loo")
def ridge_loo(spark, d):
    return V.ridge_path(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], [0.0, 10.0, 1000.0])


@register("inpaint", """
    WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS p, o_custkey::DOUBLE AS c FROM orders), m AS (SELECT avg(p) AS mp, avg(c) AS mc, covar_pop(p, c) / var_pop(c) AS b FROM h WHERE p IS NOT NULL)
    SELECT o_orderkey, round(mp + b * (c - mc), 4) AS o_totalprice, c AS o_custkey FROM h, m WHERE p IS NULL""")
def inpaint(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_custkey")
    return G.inpainted(o, "o_orderkey", ["o_totalprice", "o_custkey"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@register("predict_step", "SELECT c_custkey, round(c_acctbal + 0.1 * ((SELECT avg(c_acctbal) FROM customer) - c_acctbal), 6) AS c_acctbal FROM customer")
def predict_step(spark, d):
    return _rounded(G.stepped(_t(spark, d, "customer"), "c_custkey", ["c_acctbal"]))


@register("path_to_nearest", """
    WITH r AS (SELECT max(c_acctbal) - min(c_acctbal) AS ra, (max(c_nationkey) - min(c_nationkey))::DOUBLE AS rn FROM customer), n AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer, r ORDER BY pow((c_acctbal - 100) / ra, 2) + pow((c_nationkey - 3) / rn, 2), c_custkey LIMIT 1)
    SELECT s::INT AS step, c_custkey, round(100 + s / 4 * (c_acctbal - 100), 6) AS c_acctbal, round(3 + s / 4 * (c_nationkey - 3), 6) AS c_nationkey FROM n, range(0, 5) t(s)""")
def path_to_nearest(spark, d):
    return _rounded(G.path_to_nearest(_t(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], {"c_acctbal": 100.0, "c_nationkey": 3.0}))


@register("affine_quantile_recovery", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS q90, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS argmin, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS argmax FROM orders GROUP BY o_orderstatus")
def affine_quantile_recovery(spark, d):
    o = _t(spark, d, "orders").select("o_orderstatus", "o_orderkey", SE.affine("o_totalprice", -2.0, 7.0).alias("w"))
    ends = SE.recovered_extremes("w", -2.0, "o_orderkey")
    return o.groupBy("o_orderstatus").agg(F.round(SE.recovered_quantile("w", -2.0, 7.0, 0.9), 4).alias("q90"), *[c.alias(n) for n, c in ends.items()])


@register("inclusion_proof")
def inclusion_proof(spark, d):
    return SE.inclusion_proof(_t(spark, d, "nation"), "n_nationkey", 7)


@register("returning", "SELECT s_suppkey, s_acctbal + 10 AS s_acctbal, s_acctbal AS old_s_acctbal FROM supplier WHERE s_nationkey < 5")
def returning(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    after = WR.increment(s, F.col("s_nationkey") < 5, "s_acctbal", 10)
    return WR.returning(s, after, ["s_suppkey"]).select("s_suppkey", "s_acctbal", "old_s_acctbal")


@register("transplant", "SELECT n_nationkey, n_name, 9 AS n_regionkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def transplant(spark, d):
    """Nations of region 1 go over to those of region 0, which came first and are renumbered."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    to = WR.update(n.where("n_regionkey = 0"), F.lit(True), n_regionkey=9)
    source, target = WR.transplant(n, to, F.col("n_regionkey") == 1, retract=True)
    return target.join(source.select("n_nationkey"), "n_nationkey", "left_anti").unionByName(target.where("n_regionkey = 9")).distinct()


@register("schema_change", "SELECT r_regionkey, 'none' AS note FROM region")
def schema_change(spark, d):
    return WR.drop_field(WR.add_field(_t(spark, d, "region"), "note", "string", "none"), "r_name", ["r_regionkey"])


@register("collapse_branch", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def collapse_branch(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    both = X.resolved(s, s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 100), "s_suppkey", "s_acctbal", 10.0, "branch")
    return WR.collapsed(both, ["s_suppkey"], 1)


@register("fn_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS said, epoch_us(ts) // 1000 AS ms FROM events")
def fn_iso(spark, d):
    from ..functions import predicates as P

    return _t(spark, d, "events").select("event_id", P.iso("ts").alias("said"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
