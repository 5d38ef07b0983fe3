"""Poisson replication: determinism, means, edges."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def test_weights_are_met(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("t").alias("copy"))
    out = mixing.replicated(df, {"hot": 2.0, "s1": 5.0}, total=80_000, seed=5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = 2 + 5 + 6
    for s, c in n.items():
        want = {"hot": 2, "s1": 5}.get(s, 1) / total * 80_000
        assert abs(c - want) < 5 * want**0.5
    again = mixing.replicated(df.repartition(7), {"hot": 2.0, "s1": 5.0}, total=80_000, seed=5)
    assert {tuple(r) for r in out.select("doc_id", "copy", "shuffle_key").collect()} == {tuple(r) for r in again.select("doc_id", "copy", "shuffle_key").collect()}
    other = mixing.replicated(df, {"hot": 2.0, "s1": 5.0}, total=80_000, seed=6)
    assert out.groupBy("doc_id").count().exceptAll(other.groupBy("doc_id").count()).count() > 0


def test_large_means_are_sums_of_parts(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    n = mixing.replicated(df, {}, total=50 * 500.0).count()
    assert abs(n - 25_000) < 5 * 25_000**0.5


def test_edges(spark):
    rows = [(1, None, "x"), (None, "a", None), (None, "a", None), (2, "b", ""), (3, "zero", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.replicated(df, {"zero": 0.0, "a": 3.0}, total=400.0).collect()
    assert {r["source"] for r in out} == {None, "a", "b"}
    assert mixing.replicated(df.limit(0), {}).count() == 0
    assert mixing.replicated(df, {"zero": 0.0}, default_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.replicated(df, {"a": -1.0})
