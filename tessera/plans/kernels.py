"""Queries of the smaller kernels, lattices, and pattern explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advanced as X
from ..operators import kernels as K
from ..operators import patterns as PT
from .catalog import register, table


def _t(spark, d, name):
    return table(spark, d, name)


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@register("base_geometry", """
    WITH k AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) - o_orderkey AS gap, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), s AS (SELECT k AS start, gap AS step FROM k WHERE r = 1),
    h AS (SELECT avg((gap = step)::INT) AS share FROM k, s WHERE gap IS NOT NULL)
    SELECT CASE WHEN share = 1 THEN 'flat' WHEN share > 0.95 THEN 'nearly flat' ELSE 'curved' END AS mode, start, step, share FROM h, s""")
def base_geometry(spark, d):
    return K.base_geometry(_t(spark, d, "orders"), "o_orderkey")


def _edges(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    a = n.select(F.col("k").alias("src"), ((F.col("k") + 1) % 25).alias("dst"), F.lit(1.0).alias("w"))
    b = n.select(F.col("k").alias("src"), F.col("r").alias("dst"), F.lit(0.5).alias("w"))
    return a, b


@register("commuting", """
    WITH a AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0::DOUBLE AS w FROM nation), b AS (SELECT n_nationkey AS src, n_regionkey AS dst, 0.5::DOUBLE AS w FROM nation),
    p AS (SELECT a.src, b.dst AS dst, a.w * b.w AS p FROM a JOIN b ON a.dst = b.src UNION ALL SELECT b.src, a.dst, -a.w * b.w FROM b JOIN a ON b.dst = a.src), m AS (SELECT abs(sum(p)) AS p FROM p GROUP BY src, dst)
    SELECT max(p) <= 1e-12 AS "commute", max(p) AS max_entry FROM m""")
def commuting(spark, d):
    return K.commuting(*_edges(spark, d))


_FLIP = "CASE WHEN event_type < 'm' THEN 0.2 ELSE 0.7 END"


@register("update_commutator", f"""
    WITH p AS (SELECT event_type AS s, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM p), l AS (SELECT DISTINCT event_type AS s, {_FLIP} AS l FROM events),
    f0 AS (SELECT s, p * l / sum(p * l) OVER () AS p FROM p JOIN l USING (s)), f AS (SELECT s, 0.5 * p + 0.5 / n AS p FROM f0, n),
    g0 AS (SELECT s, 0.5 * p + 0.5 / n AS p FROM p, n), g AS (SELECT s, p * l / sum(p * l) OVER () AS q FROM g0 JOIN l USING (s)), j AS (SELECT p, q FROM f JOIN g USING (s)),
    d AS (SELECT sum(abs(p - q)) / 2 AS tv, sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2) AS h, sum(p * log2(p / q)) AS kl FROM j)
    SELECT round(tv, 8) AS tv, round(h, 8) AS hellinger, round(kl, 8) AS kl_bits, CASE WHEN tv >= 0.95 THEN 'sofic' WHEN tv <= 0.3 THEN 'smooth' ELSE 'borderline' END AS regime FROM d""")
def update_commutator(spark, d):
    """Reweighting and half mixing of a belief over event types, in both orders."""
    e = _t(spark, d, "events")
    n = e.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    p = n.join(F.broadcast(n.agg(F.sum("n").alias("t"), F.count("*").alias("kinds"))), F.lit(True))
    likelihood = n.select("state", F.when(F.col("state") < "m", 0.2).otherwise(0.7).alias("l"))
    even = n.agg(F.count("*").alias("kinds"))
    channel = n.select("state").join(F.broadcast(n.select(F.col("state").alias("to"))), F.lit(True)).join(F.broadcast(even), F.lit(True))
    channel = channel.select("state", "to", (F.when(F.col("state") == F.col("to"), 0.5).otherwise(0.0) + 0.5 / F.col("kinds")).alias("q"))
    out = K.update_commutator(p.select("state", (F.col("n") / F.col("t")).alias("p")), lambda x: K.reweighted(x, likelihood), lambda x: K.moved(x, channel))
    return _rounded(out, 8)


@register("sample_neighbourhood", "SELECT c_custkey, round(abs(c_acctbal - 5000) / 11000, 8) AS distance FROM customer WHERE abs(c_acctbal - 5000) / 11000 <= 0.1 ORDER BY md5('1|' || c_custkey), c_custkey LIMIT 10")
def sample_neighbourhood(spark, d):
    out = K.sample_neighbourhood(_t(spark, d, "customer"), "c_custkey", {"c_acctbal": 5000.0}, 0.1, {"c_acctbal": 11000.0}, 10)
    return out.select("c_custkey", F.round("distance", 8).alias("distance"))


@register("dreams")
def dreams(spark, d):
    return K.dreams(_t(spark, d, "embeddings"), "embedding", 20, 30)


@register("reconstructed")
def reconstructed(spark, d):
    return K.reconstructed(_t(spark, d, "embeddings"), "vec_id", "embedding", 5)


@register("completed_near", """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[]::DOUBLE[64] AS e FROM embeddings), n AS (SELECT a.vec_id AS q, b.label AS y, 1 - array_distance(a.e, b.e) / 1.3 AS w FROM v a JOIN v b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 AND array_distance(a.e, b.e) < 1.3),
    m AS (SELECT *, median(y) OVER (PARTITION BY q) AS med FROM n), d AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY q) AS mad FROM m),
    g AS (SELECT q, sum(w * y) / sum(w) AS p, pow(sum(w), 2) / sum(w * w) AS e FROM d WHERE (mad = 0 AND y = med) OR (mad > 0 AND 0.6745 * abs(y - med) / mad <= 3) GROUP BY q HAVING count(*) >= 2)
    SELECT q AS key, round(p, 6) AS predicted, round(e / (e + 1), 6) AS confidence FROM g""")
def completed_near(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("y"))
    return _rounded(K.completed_near(e, "vec_id", "y", "embedding", 1.3))


@register("su2_plaquettes")
def su2_plaquettes(spark, d):
    return K.plaquettes_su2(K.haar(X.lattice(spark, 6, 6)[1], 3), 6, 6)


@register("su2_identity", "SELECT 1.0::DOUBLE AS mean")
def su2_identity(spark, d):
    """A field that is a gauge transform of the identity has no flux: its mean plaquette is 1."""
    v, e = X.lattice(spark, 5, 4)
    g = K.haar(v.select(F.col("v").alias("e"), "v"), 9).select("v", F.col("u").alias("g"))
    return _rounded(K.mean_plaquette(K.gauged(K.identity_field(e), g), 5, 4), 9)


@register("loop_transport")
def loop_transport(spark, d):
    return K.loop_transport(K.haar(X.lattice(spark, 4, 4)[1], 5), [0, 1, 5, 4])


@register("cubic_lattice", "SELECT 27::BIGINT AS vertices, 81::BIGINT AS edges, 6::BIGINT AS degree")
def cubic_lattice(spark, d):
    v, e = K.cubic(spark, 3)
    ends = e.select(F.col("src").alias("v")).union(e.select("dst")).groupBy("v").count().agg(F.max("count").alias("degree"))
    return v.agg(F.count("*").alias("vertices")).join(e.agg(F.count("*").alias("edges")), F.lit(True)).join(ends, F.lit(True))


@register("truncated_icosahedron", "SELECT 60::BIGINT AS vertices, 90::BIGINT AS edges, 3::BIGINT AS degree")
def truncated_icosahedron(spark, d):
    v, e = K.truncated_icosahedron(spark)
    ends = e.select(F.col("src").alias("v")).union(e.select("dst")).groupBy("v").count().agg(F.max("count").alias("degree"))
    return v.agg(F.count("*").alias("vertices")).join(e.agg(F.count("*").alias("edges")), F.lit(True)).join(ends, F.lit(True))


_CHEAP = PT.Pattern("cheap", ("o_totalprice < 60000", "o_orderstatus = 'F'", "o_custkey < 100"), "greatest(100000 - o_totalprice, 0) / 1000")
_MISS = "(o_totalprice >= 60000)::INT + (o_orderstatus <> 'F')::INT + (o_custkey >= 100)::INT"


@register("pattern_explained")
def pattern_explained(spark, d):
    return PT.explained(_t(spark, d, "orders"), _CHEAP, "o_orderkey", 1)


@register("repair_menu", f"""
    WITH v AS (SELECT * FROM orders WHERE {_MISS} = 1), s AS (SELECT max(o_totalprice) - min(o_totalprice) AS sp, (max(o_custkey) - min(o_custkey))::DOUBLE AS sc FROM orders)
    SELECT 'o_totalprice < 60000' AS conjunct, count(*) AS gained, round(min(o_totalprice - 60000) / any_value(sp), 8) AS cost FROM v, s WHERE o_totalprice >= 60000
    UNION ALL SELECT 'o_orderstatus = ''F''', count(*), NULL FROM v WHERE o_orderstatus <> 'F' UNION ALL SELECT 'o_custkey < 100', count(*), round(min(o_custkey - 100) / any_value(sc), 8) FROM v, s WHERE o_custkey >= 100""")
def repair_menu(spark, d):
    return PT.menu(_t(spark, d, "orders"), _CHEAP).withColumn("cost", F.round("cost", 8))
