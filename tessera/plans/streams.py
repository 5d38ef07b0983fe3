"""Batch forms of the streaming verbs, which the same functions serve, and of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog_views as C
from ..sources import files as S
from ..streaming import subscriptions as ST
from .catalog import register, table


@register("stream_tumbling", """
    SELECT time_bucket(INTERVAL 6 HOURS, ts) AS "start", time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.windows(e, "ts", ["event_type"], "6 hours", n=F.count("*"), total=F.round(F.sum("value"), 2))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("stream_sliding", """
    SELECT b - to_hours(6 * k::INT) AS "start", b - to_hours(6 * k::INT) + INTERVAL 12 HOURS AS "end", count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS b FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def stream_sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.windows(e, "ts", [], "12 hours", "6 hours", n=F.count("*"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("stream_sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT min(ts) AS "start", max(ts) + INTERVAL 2 HOURS AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.sessions(e, "ts", ["user_id"], "2 hours", n=F.count("*"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("stream_anomalies", """
    WITH h AS (SELECT * FROM events WHERE event_id % 2 = 0), s AS (SELECT avg(value) AS m, max(value) - min(value) AS r FROM h), k AS (SELECT abs(value - m) / r AS k FROM h, s), o AS (SELECT avg(k) AS mu, stddev_pop(k) AS sd FROM k)
    SELECT event_id, round(abs(value - m) / r, 8) AS kappa FROM events, s, o WHERE event_id % 2 = 1 AND abs(value - m) / r > mu + 2 * sd""")
def stream_anomalies(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return ST.anomalies(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["value"]).select("event_id", F.round("kappa", 8).alias("kappa"))


@register("codec_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def codec_round_trip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return S.decode_blocks(S.encode_blocks(o, 1000), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@register("emit_json_lines", "SELECT to_json(struct_pack(r_regionkey := r_regionkey, r_name := r_name))::VARCHAR AS line FROM region")
def emit_json_lines(spark, d):
    return S.as_json(table(spark, d, "region"))


@register("profile")
def profile(spark, d):
    return S.profile(table(spark, d, "orders"))


@register("describe_fields")
def describe_fields(spark, d):
    return C.fields(table(spark, d, "orders"))


@register("statistics", " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS sigma, min({f})::DOUBLE AS low, max({f})::DOUBLE AS high FROM part" for f in ("p_partkey", "p_size", "p_retailprice")))
def statistics(spark, d):
    s = C.statistics(table(spark, d, "part"))
    return s.withColumn("mean", F.round("mean", 6)).withColumn("sigma", F.round("sigma", 6))
