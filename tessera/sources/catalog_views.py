"""The live catalog as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bundles(spark: SparkSession) -> DataFrame:
    """(name, type): tables and views of the session."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string")


def fields(df: DataFrame) -> DataFrame:
    """(field, type, position)."""
    return df.sparkSession.createDataFrame([(n, k, i) for i, (n, k) in enumerate(df.dtypes)], "field string, type string, position int")


def statistics(df: DataFrame) -> DataFrame:
    """(field, n, mean, sigma, low, high) of the numeric fields, in one pass."""
    names = [n for n, k in df.dtypes if k in ("int", "bigint", "float", "double")]
    row = df.agg(*[x for f in names for x in (F.count(f).alias(f"{f}|n"), F.avg(f).alias(f"{f}|m"), F.stddev_pop(f).alias(f"{f}|s"), F.min(f).cast("double").alias(f"{f}|l"), F.max(f).cast("double").alias(f"{f}|h"))])
    c = lambda f, x: F.col(f"`{f}|{x}`")
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c(f, "n").alias("n"), c(f, "m").alias("mean"), c(f, "s").alias("sigma"), c(f, "l").alias("low"), c(f, "h").alias("high")) for f in names])))
