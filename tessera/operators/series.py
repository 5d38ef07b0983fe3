"""Verbs of ordered series. Each works on one series for each value of `by`, so that series run in
parallel; a series is ordered within its own window partition."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .relational import cut


def prefix_kappa(df: DataFrame, by: str, order: str, field: str) -> DataFrame:
    """df with |v - mean| / range of the rows strictly before each row (0 with fewer than two)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean, span = F.count(field).over(w), F.avg(field).over(w), F.max(field).over(w) - F.min(field).over(w)
    return df.withColumn("kappa", F.when((n >= 2) & (span > 0), F.abs(F.col(field) - mean) / span).otherwise(0.0))


def rolling_curvature(df: DataFrame, by: str, order: str, field: str, back: int = 30) -> DataFrame:
    """df with var_pop / range**2 of the last back + 1 rows."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-back, 0)
    span = F.max(field).over(w) - F.min(field).over(w)
    return df.withColumn("k", F.when(span > 0, F.var_pop(field).over(w) / F.pow(span, 2)).otherwise(0.0))


def change_statistic(df: DataFrame, by: str, order: str, field: str, window: int = 40) -> DataFrame:
    """df with position i, size n and the two-window t statistic, for window <= i < n - window:
    |mean after - mean before| / (pooled deviation * sqrt(2 / window)) of the standardised series."""
    w = Window.partitionBy(by)
    x = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    z = (F.col(field) - F.avg(field).over(w)) / F.greatest(F.stddev_pop(field).over(w), F.lit(1e-9))
    x = x.withColumn("__z", z)
    before, after = w.orderBy("i").rowsBetween(-window, -1), w.orderBy("i").rowsBetween(0, window - 1)
    for name, over in (("b", before), ("a", after)):
        x = x.withColumn(f"__m{name}", F.avg("__z").over(over)).withColumn(f"__v{name}", F.var_pop("__z").over(over))
    s = F.greatest(F.sqrt((F.col("__va") + F.col("__vb")) / 2), F.lit(1e-9))
    x = x.withColumn("stat", F.abs(F.col("__ma") - F.col("__mb")) / (s * math.sqrt(2 / window)))
    x = x.where((F.col("i") >= window) & (F.col("i") < F.col("n") - window))
    return x.drop("__z", "__ma", "__mb", "__va", "__vb")


def change_points(df: DataFrame, by: str, order: str, field: str, window: int = 40, threshold: float = 6.0) -> DataFrame:
    """(by, i, stat): local maxima of the statistic over the threshold, none within a window of the
    one accepted before it; the choice is sequential within a series."""
    s = change_statistic(df, by, order, field, window)
    near = Window.partitionBy(by).orderBy("i").rangeBetween(-window, window - 1)
    s = s.withColumn("__top", F.max("stat").over(near)).where((F.col("stat") > threshold) & (F.col("stat") == F.col("__top")))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, after = [], -1
        for i in pdf.sort_values("i").i:
            if i >= after:
                keep.append(i)
                after = i + window
        return pdf[pdf.i.isin(keep)][[by, "i", "stat"]]

    kind = dict(df.dtypes)[by]
    return s.select(by, "i", "stat").groupBy(by).applyInPandas(pick, f"{by} {kind}, i int, stat double")


def texture(df: DataFrame, by: str, order: str, field: str, q: float = 2.0, low: int = 1, high: int | None = None, least: int = 64) -> DataFrame:
    """(by, n, hurst, r2, verdict): the slope of log mean |increment|**q over log lags, over q. Lags
    are 12, evenly spaced in logarithms from `low` to n / 8 (`high`), rounded; those of fewer than 20
    increments are left out, and four are needed. Within two null deviations, 2 * 0.29 * n**-0.267,
    of 0.5 the verdict is DIFFUSIVE, beyond PERSISTENT or ANTIPERSISTENT. Series under `least` values
    or of one value have no row. Increments are joins of positions: no task but the one that numbers
    a series sees it whole."""
    w = Window.partitionBy(by).orderBy(order)
    x = df.where(F.col(field).isNotNull() & ~F.isnan(F.col(field).cast("double"))).select(by, (F.row_number().over(w) - 1).alias("i"), F.col(field).cast("double").alias("v"))
    x = cut(x)
    of = x.groupBy(by).agg(F.count("*").alias("n"), F.var_pop("v").alias("var")).where((F.col("n") >= least) & (F.col("var") > 0))
    lo = F.lit(float(max(1, low)))
    hi = F.least(F.greatest(F.expr("n div 8") if high is None else F.lit(high), F.lit(max(1, low) + 1)), F.expr("n div 2")).cast("double")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor(F.exp(F.log(lo) + i / 11.0 * (F.log(hi) - F.log(lo))) + 0.5).cast("int"))
    lags = of.where(hi > lo).select(by, "n", F.explode(F.array_distinct(F.filter(spaced, lambda g: (g >= lo) & (g <= hi)))).alias("lag"))
    # A lag's increments: each position meets the one `lag` places on.
    on = x.join(lags, by).select(by, "n", "lag", "v", (F.col("i") + F.col("lag")).alias("i"))
    d = on.join(x.withColumnRenamed("v", "w"), [by, "i"])
    m = d.groupBy(by, "n", "lag").agg(F.avg(F.pow(F.abs(F.col("w") - F.col("v")), q)).alias("m"), F.count("*").alias("c")).where("c >= 20 and m > 0")
    lx, ly = F.log("lag"), F.log("m")
    out = m.groupBy(by, "n").agg(F.count("*").alias("k"), (F.regr_slope(ly, lx) / q).alias("hurst"), F.regr_r2(ly, lx).alias("r2")).where("k >= 4")
    band = 2 * 0.29 * F.pow(F.col("n").cast("double"), -0.267)
    verdict = F.when(F.col("hurst") > 0.5 + band, "PERSISTENT").when(F.col("hurst") < 0.5 - band, "ANTIPERSISTENT").otherwise("DIFFUSIVE")
    return out.select(by, "n", "hurst", "r2", verdict.alias("verdict"))


def precedence(df: DataFrame, by: str, order: str, x: str, y: str, least: int = 32) -> DataFrame:
    """(by, n, area): Lévy area of the path (x, y) from its start, over the root of the product of
    quadratic variations; positive if x leads."""
    w = Window.partitionBy(by).orderBy(order)
    p = df.select(by, F.col(order).alias("__o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    v = Window.partitionBy(by).orderBy("__o")
    p = p.withColumn("x", F.col("x") - F.first("x").over(v)).withColumn("y", F.col("y") - F.first("y").over(v))
    p = p.withColumn("dx", F.lead("x").over(v) - F.col("x")).withColumn("dy", F.lead("y").over(v) - F.col("y"))
    size = F.sqrt(F.sum(F.pow("dx", 2)) * F.sum(F.pow("dy", 2)))
    out = p.groupBy(by).agg(F.count("*").alias("n"), (0.5 * F.sum(F.col("x") * F.col("dy") - F.col("y") * F.col("dx")) / size).alias("area"))
    return out.where(F.col("n") >= least)


def _greenwood(n, r):
    return F.sqrt(F.greatest((n + 1) / (n - 1) * (n * r - 1), F.lit(0.0)))


def cadence(df: DataFrame, by: str, at: str, least: int = 64, block: int = 64) -> DataFrame:
    """(by, n, cadence, z, blocked, memory, memory_z, verdict, memory_verdict, refused) of the gaps
    between distinct stamps: Greenwood's index sqrt((n + 1) / (n - 1) * (n R - 1)), R the sum of
    squared shares, 1 for a memoryless clock, with its null deviation; the mean index over whole
    blocks of gaps (null under two blocks); and the lag-one autocorrelation of the gaps' logarithms.

    Clocks that cannot be measured have a reason in `refused` and nulls elsewhere: too few stamps,
    equal gaps, gaps that are multiples of the least with a median under ten of it, or more than a
    tenth of the gaps exactly equal."""
    d = df.where(F.col(at).isNotNull()).select(by, F.col(at).alias("t")).distinct()
    w = Window.partitionBy(by).orderBy("t")
    gaps = d.select(by, (F.row_number().over(w) - 1).alias("i"), (F.lead("t").over(w) - F.col("t")).cast("double").alias("gap"))
    gaps = cut(gaps.where("gap is not null").withColumn("ln", F.log("gap")).withColumn("next", F.lead("ln").over(Window.partitionBy(by).orderBy("i"))))
    stamps = d.groupBy(by).agg(F.count("*").alias("stamps"))
    g = gaps.groupBy(by).agg(F.count("*").alias("n"), (F.sum(F.pow("gap", 2)) / F.pow(F.sum("gap"), 2)).alias("r"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.avg("ln").alias("m"))
    ranked = gaps.withColumn("p", F.row_number().over(Window.partitionBy(by).orderBy("gap")) - 1).join(g, by)
    share = F.col("gap") / F.col("lo")
    more = ranked.groupBy(by).agg(F.max(F.when(F.col("p") == F.expr("n div 2"), F.col("gap"))).alias("mid"), F.max(F.abs(share - F.round(share))).alias("off"), (F.sum((F.col("ln") - F.col("m")) * (F.col("next") - F.col("m"))) / F.nullif(F.sum(F.pow(F.col("ln") - F.col("m"), 2)), F.lit(0.0))).alias("memory"))
    modal = gaps.groupBy(by, "gap").agg(F.count("*").alias("c")).groupBy(by).agg(F.max("c").alias("modal"))
    blocks = gaps.join(g.select(by, "n"), by).where(f"i < n div {block} * {block} and n >= {2 * block}").withColumn("b", F.expr(f"i div {block}"))
    blocks = blocks.groupBy(by, "b").agg(_greenwood(F.lit(float(block)), F.sum(F.pow("gap", 2)) / F.pow(F.sum("gap"), 2)).alias("x")).groupBy(by).agg(F.avg("x").alias("blocked"))
    t = stamps.join(g, by, "left").join(more, by, "left").join(modal, by, "left").join(blocks, by, "left")
    n = F.col("n").cast("double")
    index = _greenwood(n, F.col("r"))
    z = (index - 1) / (n / F.sqrt((n - 1) * (n + 2) * (n + 3)))
    memory_z = F.coalesce("memory", F.lit(0.0)) * F.sqrt(n)
    refused = F.when(F.col("stamps") < least, "few stamps").when(F.col("lo") == F.col("hi"), "equal gaps").when((F.col("off") <= 1e-6) & (F.col("mid") < 10 * F.col("lo")), "coarse stamps").when(F.col("modal") / n > 0.1, "lattice")
    label = lambda v, up, down, mid: F.when(v > 2, up).when(v < -2, down).otherwise(mid)
    out = {
        "n": F.col("n"), "cadence": index, "z": z, "blocked": F.col("blocked"), "memory": F.coalesce("memory", F.lit(0.0)), "memory_z": memory_z,
        "verdict": label(z, "BURSTY", "THROTTLED", "STEADY"), "memory_verdict": label(memory_z, "PERSISTENT", "ALTERNATING", "MEMORYLESS"),
    }
    return t.withColumn("refused", refused).select(by, *[F.when(F.col("refused").isNull(), c).alias(k) for k, c in out.items()], "refused")


def jackknife(df: DataFrame, by: str, order: str, field: str, skip: int = 0) -> DataFrame:
    """(by, n, mean, error, naive, tau, n_eff): the mean of a correlated series with its error
    corrected by the integrated autocorrelation time; series under four rows are refused (no row)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[field].dropna().to_numpy(float)[skip:]
        n = len(v)
        if n < 4:
            return pd.DataFrame(columns=[by, "n", "mean", "error", "naive", "tau", "n_eff"])
        c = v - v.mean()
        var = float(c @ c) / n
        tau = 0.5
        if var > 0:
            for t in range(1, n // 2):
                r = float(c[:-t] @ c[t:]) / ((n - t) * var)
                tau += r
                if r <= 0 or t >= 6 * tau:
                    break
        tau = max(tau, 0.5)
        naive = math.sqrt(var / max(1, n - 1))
        return pd.DataFrame([(pdf[by].iloc[0], n, v.mean(), naive * math.sqrt(2 * tau), naive, tau, n / (2 * tau))], columns=[by, "n", "mean", "error", "naive", "tau", "n_eff"])

    kind = dict(df.dtypes)[by]
    return df.select(by, order, field).groupBy(by).applyInPandas(one, f"{by} {kind}, n long, mean double, error double, naive double, tau double, n_eff double")


def coherence(df: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    """(by, coherence): length of the mean direction of the path's steps, 1 for a straight one."""
    w = Window.partitionBy(by).orderBy(order)
    t = F.atan2(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x))
    s = df.select(by, t.alias("t")).where("t is not null")
    return s.groupBy(by).agg(F.sqrt(F.pow(F.avg(F.cos("t")), 2) + F.pow(F.avg(F.sin("t")), 2)).alias("coherence"))


def windowed_coherence(df: DataFrame, by: str, order: str, x: str, y: str, window: int = 8, threshold: float = 0.7) -> DataFrame:
    """(by, start, coherence, laminar) of every window of `window` records of each path: the product
    of the plane rotations from record to record, sliding along it, against none:
    1 - |R - I| / (2 sqrt 2). In the plane rotations add up, so a window's product is a sum."""
    if window < 2 or not 0 < threshold <= 1:
        raise ValueError("window must be 2 or more and threshold in (0, 1]")
    w = Window.partitionBy(by).orderBy(order)
    turn = F.atan2(F.lead(y).over(w), F.lead(x).over(w)) - F.atan2(F.col(y), F.col(x))
    p = df.select(by, F.col(order).alias("__o"), (F.row_number().over(w) - 1).alias("start"), turn.alias("turn"))
    v = Window.partitionBy(by).orderBy("start").rowsBetween(0, window - 2)
    p = p.withColumn("angle", F.sum("turn").over(v)).withColumn("c", F.count("turn").over(v)).where(F.col("c") == window - 1)
    # |R - I| of a rotation by a is 2 sqrt(2) |sin(a / 2)|.
    value = F.least(F.greatest(1 - F.abs(F.sin(F.col("angle") / 2)), F.lit(0.0)), F.lit(1.0))
    return p.select(by, "start", value.alias("coherence")).withColumn("laminar", F.col("coherence") >= threshold)


def in_order(df: DataFrame, by: str, order: str, fields, take, kinds: str) -> DataFrame:
    """Rows of kinds that take(by, batches) yields, as record batches, for each series: its batches of
    (fields) come in order (nulls last, ties by the fields), never more of them at once. A series is
    read by one worker."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(by).alias("__by"), F.col(order).alias("__o"), *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(fields)])
    names = [f"__f{i}" for i in range(len(fields))]
    rows = rows.repartition(parts, "__by").sortWithinPartitions("__by", F.col("__o").asc_nulls_last(), *names).select("__by", *names)

    def runs(batches):
        """(by, batch) with one series in a batch."""
        for b in batches:
            if b.num_rows:
                ends = pc.run_end_encode(b["__by"]).run_ends.to_pylist()
                for s, e in zip([0, *ends[:-1]], ends):
                    yield b["__by"][s].as_py(), b.slice(s, e - s)

    def read(batches):
        for who, own in itertools.groupby(runs(batches), lambda r: r[0]):
            yield from take(who, ([b[n].to_numpy(zero_copy_only=False) for n in names] for _, b in own))

    return rows.mapInArrow(read, kinds)


def rotations(x: np.ndarray, y: np.ndarray, draws: int = 199, seed: int = 1, step: int = 1 << 18) -> float:
    """Rotation-null p-value of a precedence area: shares of y's increments shifted in a ring. The area
    of a shift is summed over `step` places at a time: besides the path nothing of its length is held."""
    m = len(y) - 1

    def area(k):
        total = 0.0
        # y's increments from m - k on come first, then those before; `more` is where their path begins.
        for begin, end, back, more in ((0, k, k - m, -y[m - k]), (k, m, k, y[m] - y[m - k] - y[0])):
            for s in range(begin, end, step):
                e = min(s + step, end)
                px, own = x[s : e + 1] - x[0], y[s - back : e + 1 - back]
                total += float((px[:-1] * np.diff(own) - (own[:-1] + more) * np.diff(px)).sum())
        return abs(total)

    rng, own = np.random.default_rng(seed), area(0)
    return (1 + sum(area(int(k)) >= own for k in rng.integers(1, m, draws))) / (draws + 1)


def precedence_p(df: DataFrame, by: str, order: str, x: str, y: str, least: int = 32) -> DataFrame:
    """(by, p): the rotation-null p-value of each series' precedence. A worker holds the two fields of
    one series."""

    kind = df.schema[by].dataType

    def one(who, batches):
        held = list(batches)
        if sum(len(b[0]) for b in held) >= least:
            path = [np.concatenate([b[i] for b in held]) for i in (0, 1)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([who], to_arrow_type(kind)), pa.array([rotations(*path)])], names=[by, "p"])

    return in_order(df, by, order, [x, y], one, f"`{by}` {kind.simpleString()}, p double")
