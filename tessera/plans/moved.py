"""Queries that write and read files, change tables by statements, and run streams to their end."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import language
from ..operators import patterns as PT
from ..operators import relational as R
from ..operators import writes as WR
from ..sources import files
from ..streaming import subscriptions as ST
from .catalog import register, table


def _t(spark, d, name):
    return table(spark, d, name)


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one (see relational.cut), as a plain path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds"
    path = f"{base.removeprefix('file://').removeprefix('file:').rstrip('/')}/tessera-rounds/{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


@register("csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    """EMIT CSV, then INGEST of it."""
    root = _folder(spark)
    files.emit_csv(_t(spark, d, "supplier"), root, "out")
    got = files.ingest_csv(spark, f"{root}/out", "s_suppkey")
    return got.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@register("jsonl_round_trip", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def jsonl_round_trip(spark, d):
    root = _folder(spark)
    files.emit_json(_t(spark, d, "embeddings").select("vec_id", "embedding"), root, "out")
    got = files.ingest_jsonl(spark, f"{root}/out", "vec_id")
    return got.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register("npz_member", "SELECT range AS row_idx, (range * 3)::DOUBLE AS first, (range * 3 + 2)::DOUBLE AS last FROM range(0, 5)")
def npz_member(spark, d):
    root = _folder(spark)
    np.savez(f"{root}/a.npz", links=np.arange(15.0).reshape(5, 3), other=np.zeros((2, 2)))
    s = language.Session(spark)
    got = s.execute(f"INGEST harvest FROM '{root}/a.npz' FORMAT NPZ KEY links")
    return got.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("vector")[0].alias("first"), F.col("vector")[2].alias("last"))


@register("snapshot_read", "SELECT n_nationkey, n_name FROM nation")
def snapshot_read(spark, d):
    """A snapshot stays as it was when the table changes."""
    root, n = _folder(spark), _t(spark, d, "nation").select("n_nationkey", "n_name")
    files.snapshot(n, root, "before")
    WR.delete(n, F.col("n_nationkey") > 3)
    return spark.read.parquet(f"{root}/before")


@register("catalog_bundles", "SELECT 'customer' AS name, 'c_custkey' AS key, 5 AS fields UNION ALL SELECT 'nation', 'n_nationkey', 3")
def catalog_bundles(spark, d):
    s = language.Session(spark).add("nation", _t(spark, d, "nation"), "n_nationkey").add("customer", _t(spark, d, "customer"), "c_custkey")
    return s.execute("SHOW BUNDLES")


@register("statement_writes", """
    SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 9, 'new'""")
def statement_writes(spark, d):
    """SECTION, REDEFINE and RETRACT, one after another."""
    s = language.Session(spark).add("region", _t(spark, d, "region"), "r_regionkey")
    s.execute("SECTION region (r_regionkey: 9, r_name: 'new'); REDEFINE region AT r_regionkey = 1 SET (r_name: 'renamed'); RETRACT region AT r_regionkey = 4")
    return s.tables["region"]


@register("atomic_changes", "SELECT r_regionkey, r_name FROM region")
def atomic_changes(spark, d):
    """A list of changes of which one fails leaves the table as it was."""
    r = _t(spark, d, "region")
    try:
        return WR.apply_all(r, [lambda t: WR.delete(t, F.col("r_regionkey") == 0), lambda t: WR.drop_field(t, "nothing")])
    except ValueError:
        return r


@register("indexed_and_residual", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' AND (o_totalprice > 100000 OR o_custkey < 10)")
def indexed_and_residual(spark, d):
    s = language.Session(spark).add("orders", _t(spark, d, "orders"), "o_orderkey")
    return s.execute("COVER orders ON o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' WHERE o_totalprice > 100000 OR o_custkey < 10 PROJECT (o_orderkey)")


@register("row_functions", """
    WITH s AS (SELECT avg(value) AS m, max(value) - min(value) AS r, avg(user_id) AS mu, (max(user_id) - min(user_id))::DOUBLE AS ru FROM events), k AS (SELECT event_id, (abs(value - m) / r + abs(user_id - mu) / ru) / 2 AS k FROM events, s),
    o AS (SELECT avg(k) AS a, stddev_pop(k) AS d FROM k)
    SELECT event_id, round((k - a) / d, 6) AS z, round(1 / (1 + k), 8) AS c FROM k, o WHERE (k - a) / d > 1.5 AND 1 / (1 + k) >= 0.6""")
def row_functions(spark, d):
    e = _t(spark, d, "events").select("event_id", "value", "user_id")
    s = language.Session(spark).add("events", e, "event_id")
    got = s.execute("COVER events WHERE Z_SCORE() > 1.5 AND CONFIDENCE() >= 0.6 PROJECT (event_id, Z_SCORE() AS z, CONFIDENCE() AS c)")
    return got.select("event_id", F.round("z", 6).alias("z"), F.round("c", 8).alias("c"))


@register("defined_pattern", "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS score FROM orders WHERE o_totalprice BETWEEN 150000 AND 300000 AND o_orderstatus = 'F'")
def defined_pattern(spark, d):
    s = language.Session(spark).add("orders", _t(spark, d, "orders"), "o_orderkey")
    s.execute("DEFINE OR REPLACE PATTERN dear_orders AS o_totalprice BETWEEN 150000 AND 300000 AND o_orderstatus = 'F' WEIGHT (o_totalprice / 1000)")
    try:
        return s.execute("HUNT dear_orders IN orders").select("o_orderkey", F.round("_score", 6).alias("score"))
    finally:
        PT.drop("dear_orders")


# -- Streams, run over the table's file to the end

def _stream(spark, d, name):
    rows = _t(spark, d, name)
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream emits until its source is read."""
    spark, root = stream.sparkSession, _folder(stream.sparkSession)

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("append").parquet(f"{root}/rows")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows") if os.path.exists(f"{root}/rows") else spark.createDataFrame([], stream.schema)


@register("subscribe_matching", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 100")
def subscribe_matching(spark, d):
    s = language.Session(spark).add("live", _stream(spark, d, "events"), "event_id")
    return _ran(s.execute("SUBSCRIBE live ON event_type = 'click' AND value > 100"), "append").select("event_id", "value")


@register("subscribe_curvature", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) / pow(max(value) - min(value), 2), 8) AS k FROM events GROUP BY event_type")
def subscribe_curvature(spark, d):
    """The moments that the state of each group has come to."""
    s = language.Session(spark).add("live", _stream(spark, d, "events"), "event_id")
    got = _ran(s.execute("SUBSCRIBE CURVATURE live ON value BY event_type DRIFT > 0"), "update")
    last = got.groupBy("event_type").agg(F.max(F.struct("n", "mean", "k")).alias("l"))
    return last.select("event_type", "l.n", F.round("l.mean", 6).alias("mean"), F.round("l.k", 8).alias("k"))


@register("trigger_rows", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE value > 400")
def trigger_rows(spark, d):
    """Rows that a trigger's sink has been called with."""
    root = _folder(spark)
    ST.trigger(_stream(spark, d, "events"), F.col("value") > 400, lambda df, n: df.select("event_id").write.mode("append").parquet(f"{root}/hits"), f"{root}/state").awaitTermination()
    hits = spark.read.parquet(f"{root}/hits") if os.path.exists(f"{root}/hits") else spark.createDataFrame([], "event_id long")
    return hits.agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("recursive_statement", """
    WITH RECURSIVE r(k) AS (SELECT 0::BIGINT UNION SELECT (k * 2 + 1) % 25 FROM r) SELECT k AS n_nationkey FROM r""")
def recursive_statement(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("long").alias("next"))
    s = language.Session(spark).add("nation", R.cut(n), "n_nationkey")
    text = "WITH RECURSIVE r AS ((COVER nation WHERE n_nationkey = 0 PROJECT (n_nationkey, next)) UNION (COVER nation ON n_nationkey IN (COVER r ALL PROJECT (next)) PROJECT (n_nationkey, next))) COVER r ALL PROJECT (n_nationkey)"
    return s.execute(text)
