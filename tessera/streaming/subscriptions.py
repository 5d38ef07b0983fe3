"""Subscriptions on Structured Streaming: matching rows, anomalies, drift, triggers, windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import geometry as G


def matching(stream: DataFrame, condition: Column) -> DataFrame:
    """New rows for which the condition holds."""
    return stream.where(condition)


def anomalies(stream: DataFrame, history: DataFrame, fields, n_sigma: float = 2.0) -> DataFrame:
    """New rows whose kappa, against the statistics of a static table, lies over that table's mean by
    n_sigma deviations. The statistics are one row, broadcast to every batch."""
    stats = G.field_stats(history, fields)
    k = history.join(F.broadcast(stats), F.lit(True)).withColumn("kappa", G.kappa(fields))
    of = k.agg(F.avg("kappa").alias("mu"), F.stddev_pop("kappa").alias("sigma"))
    rows = stream.join(F.broadcast(stats), F.lit(True)).withColumn("kappa", G.kappa(fields)).join(F.broadcast(of), F.lit(True))
    return rows.where(F.col("kappa") > F.col("mu") + n_sigma * F.col("sigma")).drop("mu", "sigma", *stats.columns)


def running_moments(stream: DataFrame, by: str, field: str, drift: float = 0.0) -> DataFrame:
    """(by, n, mean, k, drift): Welford moments of each group kept in state; a row is emitted when
    the group's curvature moves by more than `drift` since it was last emitted. A batch's rows are
    folded in as they come, so that state is five numbers a group."""

    def step(key, batches, state):
        n, mean, m2, low, high, said = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"), 0.0)
        for pdf in batches:
            v = pdf["v"].dropna().to_numpy(float)
            if not len(v):
                continue
            m, d = len(v), v.mean() - mean
            m2 += ((v - v.mean()) ** 2).sum() + d * d * n * m / (n + m)
            mean += d * m / (n + m)
            n, low, high = n + m, min(low, v.min()), max(high, v.max())
        k = m2 / n / (high - low) ** 2 if n >= 2 and high > low else 0.0
        moved = abs(k - said)
        if moved > drift:
            said = k
            yield pd.DataFrame([(key[0], n, mean, k, moved)], columns=[by, "n", "mean", "k", "drift"])
        state.update((n, float(mean), float(m2), float(low), float(high), float(said)))

    kind = dict(stream.dtypes)[by]
    rows = stream.select(by, F.col(field).cast("double").alias("v"))
    return rows.groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, n long, mean double, k double, drift double", "n long, mean double, m2 double, low double, high double, said double", "update", "NoTimeout"
    )


def recomputed(stream: DataFrame, measure: Callable[[DataFrame], float], threshold: float, on_change: Callable[[int, float, float], None], checkpoint: str) -> StreamingQuery:
    """For statistics without an incremental form: each batch is measured, and a move of more than
    the threshold from the batch before is told."""
    last: dict[str, float] = {}

    def batch(df: DataFrame, number: int) -> None:
        value = measure(df)
        if "v" in last and abs(value - last["v"]) > threshold:
            on_change(number, last["v"], value)
        last["v"] = value

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trigger(stream: DataFrame, condition: Column | None, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls the sink with the matching rows of every batch that has some."""

    def batch(df: DataFrame, number: int) -> None:
        hit = df.where(condition) if condition is not None else df
        if not hit.isEmpty():
            sink(hit, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(stream: DataFrame, at: str, by, size: str, slide: str | None = None, late: str = "1 hour", **measures: Column) -> DataFrame:
    """Measures over event-time windows, tumbling or sliding, with a watermark for late rows."""
    named = [m.alias(n) for n, m in measures.items()]
    out = stream.withWatermark(at, late).groupBy(F.window(at, size, slide), *by).agg(*named)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *measures)


def sessions(stream: DataFrame, at: str, by, gap: str, late: str = "1 hour", **measures: Column) -> DataFrame:
    """Measures over sessions that end after a gap."""
    named = [m.alias(n) for n, m in measures.items()]
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(*named)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *measures)
