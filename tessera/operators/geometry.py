"""Geometric statistics of tables: curvature, confidence, deviation, entropy, divergence.

Everything is one or two aggregations. A row of statistics is joined back by a broadcast of that
single row. Ranges are observed unless given."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 2.220446049250313e-16


def _range(f: str, ranges: dict[str, float] | None = None) -> Column:
    given = (ranges or {}).get(f)
    return F.lit(float(given)) if given else F.greatest(F.max(f) - F.min(f), F.lit(EPS))


def curvature_of(fields) -> Column:
    """K as an aggregate: the mean over fields with two values or more of var / range**2."""
    terms = [F.when(F.count(f) >= 2, F.var_pop(f) / F.pow(_range(f), 2)) for f in fields]
    n = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms), F.lit(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(0.0)


def curvature(df: DataFrame, fields, by=()) -> DataFrame:
    """k, confidence 1 / (1 + k) and capacity 1 / k (null without curvature), global or by group."""
    out = (df.groupBy(*by) if by else df).agg(curvature_of(fields).alias("k"))
    return out.withColumn("confidence", confidence("k")).withColumn("capacity", capacity("k"))


def confidence(k) -> Column:
    return 1.0 / (1.0 + F.col(k))


def capacity(k, tolerance: float = 1.0) -> Column:
    """tolerance / k; unbounded, as null, for k near 0."""
    return F.when(F.col(k) > 1e-12, tolerance / F.col(k))


def field_stats(df: DataFrame, fields, ranges=None) -> DataFrame:
    """One row: mean, deviation and range of each field, as m_f, s_f and r_f."""
    return df.agg(*[x for f in fields for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), _range(f, ranges).alias(f"r_{f}"))])


def kappa(fields) -> Column:
    """Record curvature against m_f and r_f: the mean over present fields of |v - mean| / range."""
    terms = [F.abs(F.col(f) - F.col(f"m_{f}")) / F.col(f"r_{f}") for f in fields]
    n = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / n).otherwise(0.0)


def record_kappa(df: DataFrame, fields, ranges=None, fine: bool = False) -> DataFrame:
    """df with kappa; the statistics are one broadcast row. fine: means from sums without rounding, as a
    sum of many doubles loses its last digits: whole multiples of a power of two are added as decimals,
    and only what is left of each value as doubles."""
    stats = field_stats(df, fields, ranges)
    if fine:
        unit = {f: F.pow(F.lit(2.0), F.lit(40) - F.ceil(F.log2(F.greatest(F.col(f"__b_{f}"), F.lit(1e-200))))) for f in fields}
        rows = df.join(F.broadcast(df.agg(*[F.max(F.abs(F.col(f).cast("double"))).alias(f"__b_{f}") for f in fields])), F.lit(True))
        scaled = {f: F.col(f).cast("double") * unit[f] for f in fields}
        total = {f: F.sum(F.floor(scaled[f]).cast("decimal(19,0)")).cast("double") + F.sum(scaled[f] - F.floor(scaled[f])) for f in fields}
        means = rows.agg(*[(total[f] / (F.first(unit[f]) * F.count(f))).alias(f"m_{f}") for f in fields])
        stats = stats.drop(*means.columns).join(F.broadcast(means), F.lit(True))
    return df.join(F.broadcast(stats), F.lit(True)).withColumn("kappa", kappa(fields)).drop(*stats.columns)


def explain_kappa(df: DataFrame, key: str, keys, fields) -> DataFrame:
    """(key, field, value, mean, sigma, range, kappa, z, record_kappa): the share of each field."""
    stats = field_stats(df, fields)
    rows = df.where(F.col(key).isin(*keys)).join(F.broadcast(stats), F.lit(True)).withColumn("record_kappa", kappa(fields))
    parts = [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("sigma"), F.col(f"r_{f}").cast("double").alias("range"))
        for f in fields
    ]
    out = rows.select(key, "record_kappa", F.inline(F.array(*parts)))
    z = F.when(F.col("sigma") > 0, (F.col("value") - F.col("mean")) / F.col("sigma")).otherwise(0.0)
    return out.withColumn("kappa", F.abs(F.col("value") - F.col("mean")) / F.col("range")).withColumn("z", z)


def metric_tensor(df: DataFrame, fields) -> DataFrame:
    """(a, b, corr): population correlations over complete rows, from one pass of sums."""
    whole = df.dropna(subset=list(fields))
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i:]]
    row = whole.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])))


def effective_dimension(df: DataFrame, fields) -> DataFrame:
    """(condition, dimension) of the correlation matrix; a matrix of fields, not of rows."""
    import numpy as np

    got = {(r["a"], r["b"]): r["corr"] or 0.0 for r in metric_tensor(df, fields).collect()}
    m = np.array([[got.get((a, b), got.get((b, a), 0.0)) for b in fields] for a in fields])
    lam = np.linalg.eigvalsh(m)
    return df.sparkSession.createDataFrame([(float(lam[-1] / max(lam[0], EPS)), float(lam.sum() ** 2 / (lam**2).sum()))], "condition double, dimension double")


def divergence(a: DataFrame, b: DataFrame, fields, floor: float = 1e-12) -> DataFrame:
    """(field, forward, reverse, js): Gaussian KL both ways and moment-matched Jensen-Shannon."""
    def moments(df, s):
        return df.agg(*[x for f in fields for x in (F.avg(f).alias(f"{s}m_{f}"), F.greatest(F.var_pop(f), F.lit(floor)).alias(f"{s}v_{f}"))])

    def kl(ma, va, mb, vb):
        return F.greatest(0.5 * (F.log(vb / va) + (va + F.pow(ma - mb, 2)) / vb - 1), F.lit(0.0))

    row = moments(a, "a").join(F.broadcast(moments(b, "b")), F.lit(True))
    parts = []
    for f in fields:
        ma, va, mb, vb = (F.col(f"{x}_{f}") for x in ("am", "av", "bm", "bv"))
        mid = (ma + mb) / 2
        vm = (va + vb) / 2 + F.pow(ma - mb, 2) / 4
        js = (kl(ma, va, mid, vm) + kl(mb, vb, mid, vm)) / 2
        parts.append(F.struct(F.lit(f).alias("field"), kl(ma, va, mb, vb).alias("forward"), kl(mb, vb, ma, va).alias("reverse"), js.alias("js")))
    return row.select(F.inline(F.array(*parts)))


def entropy(df: DataFrame, fields) -> DataFrame:
    """(distinct, entropy) in nats of the tuples of the fields."""
    n = df.groupBy(*fields).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("distinct"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def coarse_grain(df: DataFrame, fields) -> DataFrame:
    """(level, distinct, entropy): entropy as trailing fields are dropped one by one. Each level is
    counted from the counts of the one before."""
    n, out = df.groupBy(*fields).agg(F.count("*").alias("n")), None
    for level in range(len(fields)):
        keep = fields[: len(fields) - level]
        n = n.groupBy(*keep).agg(F.sum("n").alias("n")) if level else n
        row = n.agg(F.lit(level).alias("level"), F.count("*").alias("distinct"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))
        out = row if out is None else out.unionByName(row)
    return out


def recall_deviation(returned: Column, total: Column) -> tuple[Column, Column]:
    """S = min(returned, total) / total and d = sqrt(1 - S); S + d**2 = 1."""
    s = F.least(returned, total) / total
    return s, F.sqrt(1 - s)


def deviation(df: DataFrame, defaults: dict[str, float], ranges: dict[str, float]) -> DataFrame:
    """df with deviation_norm, fields that differ from their defaults, and deviation_distance,
    the length of their differences over the ranges."""
    differ = sum((F.when(F.col(f).eqNullSafe(F.lit(v)), 0).otherwise(1) for f, v in defaults.items()), F.lit(0))
    square = sum((F.pow((F.coalesce(F.col(f), F.lit(v)) - v) / ranges[f], 2) for f, v in defaults.items()), F.lit(0.0))
    return df.withColumn("deviation_norm", differ).withColumn("deviation_distance", F.sqrt(square))


def fisher(df: DataFrame, fields) -> DataFrame:
    """(field, mean_mean, sigma_sigma, determinant): 1/s^2, 2/s^2, 2/s^4; constant fields left out."""
    row = df.agg(*[F.var_pop(f).alias(f) for f in fields])
    out = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]))).where("v > 0")
    return out.select("field", (1 / F.col("v")).alias("mean_mean"), (2 / F.col("v")).alias("sigma_sigma"), (2 / F.pow("v", 2)).alias("determinant"))


def wasserstein(df: DataFrame, cohort: str, a, b, field: str) -> DataFrame:
    """W2 between the field's values in two cohorts: merged quantile steps of both orders.

    A value owns the quantiles up to its last row's i / n; the merged ends of steps are integrated by
    filling both step functions over them. Steps are of distinct values, in ranges of quantiles: no task
    orders all, and what a range needs of the others is a row for each range."""
    from .relational import cut, ranked_values

    x = df.where(F.col(cohort).isin(a, b)).select(F.col(cohort).eqNullSafe(F.lit(a)).alias("first_of"), F.col(field).cast("double").alias("v")).where("v is not null")
    # The second cohort stands before the first in the order.
    x = ranked_values(x, ["first_of", "v"])
    n = x.agg(F.sum(F.when(F.col("first_of"), F.col("times"))).alias("na"), F.sum(F.when(~F.col("first_of"), F.col("times"))).alias("nb"))
    end = F.col("first") + F.col("times")
    q = F.when(F.col("first_of"), (end - F.coalesce("nb", F.lit(0))) / F.col("na")).otherwise(end / F.col("nb"))
    x = x.join(F.broadcast(n), F.lit(True)).withColumn("q", q)
    x = x.groupBy("q").agg(F.min(F.when(F.col("first_of"), F.col("v"))).alias("va"), F.min(F.when(~F.col("first_of"), F.col("v"))).alias("vb"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(x.repartitionByRange(parts, "q").withColumn("__part", F.spark_partition_id()))
    # Where a range ends: the next values of both cohorts after it, and the last end before it.
    ends = sorted(tuple(r) for r in x.groupBy("__part").agg(F.min("va"), F.min("vb"), F.max("q")).collect())
    rows, after, before = [], (None, None), [0.0, *[e[3] for e in ends]]
    for i in range(len(ends) - 1, -1, -1):
        rows.append((ends[i][0], *after, before[i]))
        after = tuple(after[j] if ends[i][1 + j] is None else ends[i][1 + j] for j in (0, 1))
    x = x.join(F.broadcast(df.sparkSession.createDataFrame(rows, "__part int, __a double, __b double, __q double")), "__part")
    # A breakpoint q is where a step ends: the value of the other cohort there is its next one.
    by = Window.partitionBy("__part")
    on = by.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("va", F.coalesce(F.last("va", ignorenulls=True).over(on), "__a")).withColumn("vb", F.coalesce(F.last("vb", ignorenulls=True).over(on), "__b"))
    x = x.withColumn("w", F.col("q") - F.coalesce(F.lag("q").over(by.orderBy("q")), "__q"))
    return x.agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("va") - F.col("vb"), 2))).alias("w2"))


def pullback_curvature(left: DataFrame, right: DataFrame, along: str, onto: str, left_fields, right_fields) -> DataFrame:
    """One row: curvature of both sides and of the join, its change, and how rows matched."""
    joined = left.join(right.withColumnRenamed(onto, "__onto"), F.col(along) == F.col("__onto"), "left")
    row = joined.agg(curvature_of([*left_fields, *right_fields]).alias("k_pullback"), F.count("__onto").alias("matched"), F.count(F.when(F.col("__onto").isNull(), 1)).alias("unmatched"))
    k_left, k_right = left.agg(curvature_of(left_fields).alias("k_left")), right.agg(curvature_of(right_fields).alias("k_right"))
    lone = right.join(left.select(F.col(along).alias(onto)), onto, "left_anti").agg(F.count("*").alias("right_unmatched"))
    for one in (k_left, k_right, lone):
        row = row.join(F.broadcast(one), F.lit(True))
    return row.withColumn("delta_k", F.col("k_pullback") - F.col("k_left"))


def kahler(df: DataFrame, fields) -> DataFrame:
    """(holomorphic, weyl, bisectional_min, bisectional_max, ricci) of pair curvatures
    64 * (var_a + var_b) / (range_a**2 + range_b**2) over neighbouring field pairs."""
    pairs = list(zip(fields[::2], fields[1::2]))
    row = df.agg(*[(64 * (F.var_pop(a) + F.var_pop(b)) / (F.pow(_range(a), 2) + F.pow(_range(b), 2))).alias(f"k{i}") for i, (a, b) in enumerate(pairs)])
    ks = [F.col(f"k{i}") for i in range(len(pairs))]
    mean = sum(ks[1:], ks[0]) / len(ks)
    sd = F.sqrt(sum((F.pow(k - mean, 2) for k in ks), F.lit(0.0)) / len(ks))
    two = F.array(*[F.sqrt(ks[i] * ks[j]) for i in range(len(ks)) for j in range(i + 1, len(ks))]) if len(ks) > 1 else F.array(ks[0])
    return row.select(mean.alias("holomorphic"), sd.alias("weyl"), F.array_min(two).alias("bisectional_min"), F.array_max(two).alias("bisectional_max"), ((len(ks) + 1) * mean / 4).alias("ricci"))


def holonomy(df: DataFrame, f1: str, f2: str, around: str) -> DataFrame:
    """(groups, deficit): the turning of the loop of group centroids in group order, mod 2 pi."""
    c = df.groupBy(around).agg(F.avg(f1).alias("x"), F.avg(f2).alias("y"))
    w = Window.orderBy(around)
    first = c.orderBy(around).limit(1).select(F.col("x").alias("x0"), F.col("y").alias("y0"))
    c = c.join(F.broadcast(first), F.lit(True))
    c = c.withColumn("dx", F.coalesce(F.lead("x").over(w), "x0") - F.col("x")).withColumn("dy", F.coalesce(F.lead("y").over(w), "y0") - F.col("y"))
    c = c.withColumn("t", F.atan2("dy", "dx"))
    last = F.first("t").over(Window.orderBy(around))
    turn = F.coalesce(F.lead("t").over(w), last) - F.col("t")
    c = c.withColumn("turn", F.atan2(F.sin(turn), F.cos(turn)))
    return c.agg(F.count("*").alias("groups"), F.pmod(F.abs(F.sum("turn")), F.lit(2 * math.pi)).alias("deficit"))


def local_holonomy(df: DataFrame, key: str, start, end, fields) -> DataFrame:
    """(holonomy): length of the difference of the fields of two keys."""
    row = df.where(F.col(key).isin(start, end)).agg(*[(F.max(F.when(F.col(key) == F.lit(end), F.col(f))) - F.max(F.when(F.col(key) == F.lit(start), F.col(f)))).alias(f) for f in fields])
    return row.select(F.sqrt(sum((F.pow(f, 2) for f in fields), F.lit(0.0))).alias("holonomy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mutual) in nats between two categorical fields, from joint counts."""
    joint = df.groupBy(a, b).agg(F.count("*").alias("n"))
    joint = joint.withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nb", F.sum("n").over(Window.partitionBy(b)))
    total = joint.agg(F.sum("n").alias("t"))
    return joint.join(F.broadcast(total), F.lit(True)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mutual"))


def affine(df: DataFrame, maps: dict[str, tuple[float, float]]) -> DataFrame:
    """Each field v as a * v + b: curvature does not change."""
    return df.withColumns({f: F.lit(a) * F.col(f) + F.lit(b) for f, (a, b) in maps.items()})


def depth(k: Column, gap: Column, iv: float = 0.01, iii: float = 0.5, ii_k: float = 0.1, ii_gap: float = 0.3) -> Column:
    """I to IV by the cascade of gap and curvature."""
    return F.when(gap < iv, "IV").when(k > iii, "III").when((k > ii_k) | (gap < ii_gap), "II").otherwise("I")


def sameness(df: DataFrame, fields, reference: dict[str, float]) -> DataFrame:
    """df with same, (1 + cosine) / 2 of the centred, range-scaled fields to those of a reference
    point, and dist, sqrt(1 - same): same + dist**2 = 1. A record at the centre is half the same."""
    m = df.agg(*[x for f in fields for x in (F.avg(f).alias(f"__m_{f}"), _range(f).alias(f"__r_{f}"))])
    rows = df.join(F.broadcast(m), F.lit(True))
    own = {f: (F.col(f).cast("double") - F.col(f"__m_{f}")) / F.col(f"__r_{f}") for f in fields}
    ref = {f: (F.lit(float(reference[f])) - F.col(f"__m_{f}")) / F.col(f"__r_{f}") for f in fields}
    dot = sum((own[f] * ref[f] for f in fields), F.lit(0.0))
    size = F.sqrt(sum((F.pow(own[f], 2) for f in fields), F.lit(0.0)) * sum((F.pow(ref[f], 2) for f in fields), F.lit(0.0)))
    same = F.when(size > 0, F.least(F.greatest((1 + dot / size) / 2, F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    return rows.withColumn("same", same).withColumn("dist", F.sqrt(1 - F.col("same"))).drop(*m.columns)


def ranks(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """df with the rank of a score, the greatest first, ties alike, by ranks over ranges of values
    rather than in one task."""
    from .relational import numbered_rows

    rows = numbered_rows(df, [F.desc_nulls_last(score)], "__i")
    first = rows.groupBy(F.col(score).alias("__s")).agg(F.min("__i").alias("__first"))
    return rows.join(first, F.col(score).eqNullSafe(F.col("__s"))).withColumn(name, F.col("__first") + 1).drop("__i", "__s", "__first")


def kappa_rank(df: DataFrame, fields) -> DataFrame:
    """df with kappa and kappa_rank, 1 for the most curved record."""
    return ranks(record_kappa(df, fields, fine=True), "kappa", "kappa_rank")


def sameness_rank(df: DataFrame, fields, reference: dict[str, float]) -> DataFrame:
    """df with same, dist and sameness_rank, 1 for the record most like the reference."""
    return ranks(sameness(df, fields, reference), "same", "sameness_rank")


def shard_state(df: DataFrame, fields, shard: str) -> DataFrame:
    """(shard, field, n, mean, m2, low, high): what a shard knows of each field."""
    row = df.groupBy(shard).agg(*[F.struct(F.count(f).alias("n"), F.avg(f).alias("mean"), (F.var_pop(f) * F.count(f)).alias("m2"), F.min(f).cast("double").alias("low"), F.max(f).cast("double").alias("high")).alias(f) for f in fields])
    return row.select(F.col(shard).alias("shard"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f)[x].alias(x) for x in ("n", "mean", "m2", "low", "high")]) for f in fields])))


def merged_curvature(states: DataFrame) -> DataFrame:
    """(k): the whole table's curvature from the states of its shards alone."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    m2 = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * total / n
    per = states.where("n > 0").groupBy("field").agg((m2 / n / F.pow(F.max("high") - F.min("low"), 2)).alias("k"), n.alias("n")).where("n >= 2")
    return per.agg(F.avg("k").alias("k"))


def inpainted(df: DataFrame, key: str, fields) -> DataFrame:
    """(key, fields): records with missing fields, these filled by their conditional means under the
    Gaussian fitted to complete records. Only a matrix of fields reaches the driver."""
    import numpy as np
    import pandas as pd

    from .vectors import moments

    x = F.array(*[F.col(f).cast("double") for f in fields])
    whole = df.dropna(subset=list(fields)).select(x.alias("v"))
    n, mean, cov = moments(whole, "v")
    if not n:
        raise ValueError("no complete record")

    def fill(batches):
        for pdf in batches:
            v = pdf[list(fields)].to_numpy(float)
            for missing in {tuple(m) for m in np.isnan(v)}:
                at, m = np.flatnonzero((np.isnan(v) == missing).all(1)), np.array(missing)
                k = ~m
                if k.any():
                    v[np.ix_(at, m)] = mean[m] + (v[np.ix_(at, k)] - mean[k]) @ np.linalg.pinv(cov[np.ix_(k, k)]) @ cov[np.ix_(k, m)]
                else:
                    v[np.ix_(at, m)] = mean[m]
            yield pd.DataFrame({key: pdf[key], **{f: v[:, i] for i, f in enumerate(fields)}})

    gaps = df.where(" or ".join(f"`{f}` is null" for f in fields)).select(key, *[F.col(f).cast("double") for f in fields])
    return gaps.mapInPandas(fill, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{f} double" for f in fields))


def stepped(df: DataFrame, key: str, fields, rate: float = 0.1) -> DataFrame:
    """(key, fields): each record moved one natural-gradient step up the fitted diagonal Gaussian:
    v + rate (mean - v), the Fisher metric cancelling the variance."""
    m = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in fields])
    return df.join(F.broadcast(m), F.lit(True)).select(key, *[(F.col(f) + rate * (F.col(f"__m_{f}") - F.col(f))).alias(f) for f in fields])


def path_to_nearest(df: DataFrame, key: str, fields, at: dict[str, float], steps: int = 4) -> DataFrame:
    """(step, key, fields): the straight path from a point to the nearest record, each field over
    its range; ties to the lesser key."""
    row = df.agg(*[_range(f).alias(f) for f in fields])
    d = sum((F.pow((F.col(f) - float(at[f])) / F.col(f"__r_{f}"), 2) for f in fields), F.lit(0.0))
    near = df.join(F.broadcast(row.select(*[F.col(f).alias(f"__r_{f}") for f in fields])), F.lit(True)).orderBy(d, key).limit(1)
    step = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    return near.select(step, key, *fields).select("step", key, *[(F.lit(float(at[f])) + F.col("step") / steps * (F.col(f) - float(at[f]))).alias(f) for f in fields])
