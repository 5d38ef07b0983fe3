"""Anomalies, volatility, outliers, violated constraints, and the lenses of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geometry as G
from .relational import numbered_rows, ranked_values


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact quantile of a column, interpolated, by ranks over ranges of its distinct values: no
    task sees more than a partition of them. None without values."""
    rows = ranked_values(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ["v"])
    n = rows.agg(F.sum("times")).first()[0]
    if not n:
        return None
    low = int(q * (n - 1))
    high = min(low + 1, n - 1)
    got = [(r["first"], r["times"], r["v"]) for r in rows.where(f"first <= {high} and first + times > {low}").collect()]
    at = {k: v for first, times, v in got for k in (low, high) if first <= k < first + times}
    return at[low] + (q * (n - 1) - low) * (at[high] - at[low])


def group_median(df: DataFrame, by: str, value: str, name: str = "med", size: str = "n") -> DataFrame:
    """(by, name, size): exact medians of groups by ranks of the distinct values over the whole
    table, so that a hot group or value is spread over tasks like any other range."""
    rows = ranked_values(df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v")), [by, "__v"])
    g = rows.groupBy(by).agg(F.min("first").alias("__low"), F.sum("times").alias(size))
    g = g.withColumn("__a", F.expr(f"__low + ({size} - 1) div 2")).withColumn("__b", F.expr(f"__low + {size} div 2"))
    hit = rows.join(g, by).where("first <= __b and first + times > __a")
    covers = lambda i: F.when((F.col("first") <= F.col(i)) & (F.col("first") + F.col("times") > F.col(i)), 1).otherwise(0)
    weight = covers("__a") + covers("__b")
    return hit.groupBy(by, size).agg((F.sum(F.col("__v") * weight) / F.sum(weight)).alias(name)).select(by, name, size)


def anomalies(df: DataFrame, fields, n_sigma: float = 2.0, where: Column | None = None) -> DataFrame:
    """Candidate rows whose kappa lies over mean + n_sigma deviations of all candidates' kappas, with
    z, confidence and the fields that deviate more than the row does on average."""
    stats = G.field_stats(df, fields)
    rows = (df.where(where) if where is not None else df).join(F.broadcast(stats), F.lit(True)).withColumn("kappa", G.kappa(fields))
    of = rows.agg(F.avg("kappa").alias("mu"), F.stddev_pop("kappa").alias("sigma"))
    out = rows.join(F.broadcast(of), F.lit(True)).where("sigma > 0 and kappa > mu + {} * sigma".format(float(n_sigma)))
    part = {f: F.abs(F.col(f) - F.col(f"m_{f}")) / F.col(f"r_{f}") for f in fields}
    loud = F.array_join(F.filter(F.array(*[F.when(p > F.col("kappa"), F.lit(f)) for f, p in part.items()]), lambda x: x.isNotNull()), ",")
    out = out.withColumn("z", (F.col("kappa") - F.col("mu")) / F.col("sigma")).withColumn("confidence", G.confidence("kappa")).withColumn("contributing", loud)
    return out.drop("mu", "sigma", *stats.columns)


def field_anomalies(df: DataFrame, field: str, n_sigma: float = 3.0, by=()) -> DataFrame:
    """Rows whose field lies n_sigma population deviations from the mean, of all rows or of their
    group; the group's moments are joined back, so a hot group is only reduced."""
    m = (df.groupBy(*by) if by else df).agg(F.avg(field).alias("mean"), F.stddev_pop(field).alias("sigma"))
    rows = df.join(m, list(by)) if by else df.join(F.broadcast(m), F.lit(True))
    rows = rows.withColumn("z", F.when(F.col("sigma") > 0, (F.col(field) - F.col("mean")) / F.col("sigma")).otherwise(0.0))
    return rows.where(F.abs("z") > n_sigma)


def volatility(df: DataFrame, fields, by) -> DataFrame:
    """Curvature of each group, its z among groups and a label."""
    k = G.curvature(df, fields, by)
    of = k.agg(F.avg("k").alias("mu"), F.stddev_pop("k").alias("sigma"))
    k = k.join(F.broadcast(of), F.lit(True))
    k = k.withColumn("z", F.when(F.col("sigma") > 0, (F.col("k") - F.col("mu")) / F.col("sigma")).otherwise(0.0)).drop("mu", "sigma", "capacity")
    label = F.when(F.col("z") > 2, "HIGH_VOLATILITY").when(F.col("z") > 1, "ELEVATED").when(F.col("z") < -1, "STABLE").otherwise("NORMAL")
    return k.withColumn("label", label)


def violations(df: DataFrame, key: str, checks: dict[str, Column], unique=(), references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(constraint, key): rows that break a check (also by null), repeat a unique field, or name a
    row that is not there."""
    out = None

    def add(name: str, rows: DataFrame):
        nonlocal out
        one = rows.select(F.lit(name).alias("constraint"), F.col(key).alias("key"))
        out = one if out is None else out.unionByName(one)

    for name, c in checks.items():
        add(name, df.where(~F.coalesce(c, F.lit(False))))
    for f in unique:
        twice = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("__n")).where("__n > 1").select(f)
        add(f"unique {f}", df.join(twice, f, "left_semi"))
    for f, (other, onto) in (references or {}).items():
        add(f"references {f}", df.where(F.col(f).isNotNull()).join(other.select(F.col(onto).alias(f)), f, "left_anti"))
    return out


def consistency(df: DataFrame, key: str, index: str, field: str, threshold: float = 3.0) -> DataFrame:
    """(key, severity): rows whose field contradicts the others of their index value: modified z
    0.6745 * |x - median| / MAD over the threshold; with a MAD of 0 any deviation is one."""
    at = df.where(F.col(field).isNotNull() & F.col(index).isNotNull())
    rows = at.join(group_median(at, index, field), index).withColumn("dev", F.abs(F.col(field) - F.col("med")))
    rows = rows.join(group_median(rows, index, "dev", "mad", "__n").drop("__n"), index).where("n >= 3")
    severity = F.when(F.col("mad") > 0, 0.6745 * F.col("dev") / F.col("mad")).otherwise(F.when(F.col("dev") > 0, F.lit(1e9)).otherwise(0.0))
    return rows.select(F.col(key).alias("key"), severity.alias("severity")).where(F.col("severity") > threshold)


def squash(z: Column) -> Column:
    z = F.greatest(z, F.lit(0.0))
    return z / (z + 6.0)


def robust_z(df: DataFrame, score: str) -> DataFrame:
    """df with z of the score: by median and 1.4826 * MAD, else by mean and deviation, floored at 0."""
    med = quantile(df, score, 0.5)
    if med is None:
        return df.withColumn("z", F.lit(0.0))
    mad = 1.4826 * quantile(df.select(F.abs(F.col(score) - med).alias("d")), "d", 0.5)
    mean, sd = df.agg(F.avg(score), F.stddev_pop(score)).first()
    centre, width = (med, mad) if mad > 1e-12 else (mean, sd)
    z = (F.col(score) - float(centre)) / float(width) if width > 1e-12 else F.lit(0.0)
    return df.withColumn("z", F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)))


def scan_global(df: DataFrame, fields) -> DataFrame:
    """df with z of kappa over all rows, floored at 0."""
    k = G.record_kappa(df, fields)
    of = k.agg(F.avg("kappa").alias("mu"), F.stddev_pop("kappa").alias("sigma"))
    return k.join(F.broadcast(of), F.lit(True)).withColumn("global", F.when(F.col("sigma") > 0, F.greatest((F.col("kappa") - F.col("mu")) / F.col("sigma"), F.lit(0.0))).otherwise(0.0)).drop("mu", "sigma", "kappa")


def scan_context(df: DataFrame, category: str, fields) -> DataFrame:
    """df with the largest |x - mean| / deviation of its fields within the category's cohort;
    cohorts under three rows and constant fields score 0."""
    m = df.groupBy(category).agg(F.count("*").alias("__n"), *[x for f in fields for x in (F.avg(f).alias(f"__m_{f}"), F.stddev_pop(f).alias(f"__s_{f}"))])
    rows = df.join(m, category)
    zs = [F.when((F.col("__n") >= 3) & (F.col(f"__s_{f}") > 1e-12), F.abs(F.col(f) - F.col(f"__m_{f}")) / F.col(f"__s_{f}")).otherwise(0.0) for f in fields]
    out = rows.withColumn("context", F.greatest(*zs) if len(zs) > 1 else zs[0])
    return out.drop("__n", *[f"__{p}_{f}" for p in "ms" for f in fields])


def scan_velocity(df: DataFrame, entity: str, time: str, unit: str = "hour") -> DataFrame:
    """df with the number of rows of its entity in its unit of time."""
    t = df.withColumn("__t", F.date_trunc(unit, time))
    n = t.groupBy(entity, "__t").agg(F.count("*").alias("velocity"))
    return t.join(n, [entity, "__t"]).drop("__t")


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text; a shorter text is its own."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.array_distinct(F.when(F.char_length(low) >= 3, cut).otherwise(F.array(low)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def scan_text(df: DataFrame, field: str, often: int = 8, low: float = 0.45, high: float = 0.97) -> DataFrame:
    """(value, n, near, rarity): rare values, with their best trigram similarity in low..high to a
    frequent one. Candidates share a trigram; they are counted from an inverted index."""
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    grams = counts.withColumn("g", F.explode(trigrams(F.col("value"))))
    size = grams.groupBy("value").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    rare, frequent = grams.where(F.col("n") < often), grams.where(F.col("n") >= often)
    both = rare.select("value", "g").join(frequent.select(F.col("value").alias("other"), "g"), "g").groupBy("value", "other").agg(F.count("*").alias("c"))
    both = both.join(size.select("value", F.col("size").alias("sa")), "value").join(size.select(F.col("value").alias("other"), F.col("size").alias("sb")), "other")
    near = both.withColumn("s", F.col("c") / (F.col("sa") + F.col("sb") - F.col("c"))).where(F.col("s").between(low, high)).groupBy("value").agg(F.max("s").alias("near"))
    top = counts.agg(F.max("n").alias("top"))
    out = counts.where(F.col("n") < often).join(near, "value", "left").join(F.broadcast(top), F.lit(True))
    return out.select("value", "n", F.coalesce("near", F.lit(0.0)).alias("near"), (1 - F.col("n") / F.col("top")).alias("rarity"))


def fused(df: DataFrame, lenses, weights=None, budget: float = 0.05) -> DataFrame:
    """df with fused, the greatest (or weighted sum) of the squashed lens scores, and flagged, the
    rows over the quantile 1 - budget."""
    norm = [squash(F.col(x)) for x in lenses]
    score = F.greatest(*norm) if weights is None and len(norm) > 1 else sum((w * x for w, x in zip(weights or [1.0], norm)), F.lit(0.0))
    rows = df.withColumn("fused", score)
    at = quantile(rows, "fused", 1 - budget)
    return rows.withColumn("flagged", F.col("fused") > F.lit(at) if at is not None else F.lit(False))


def cohorts_fit(df: DataFrame, by, least_distinct: int = 4, least_cohort: int = 3) -> bool:
    """Whether cohorts of these columns may be a context: at least four, at most a fifth of the
    rows, half of them of three rows or more (by the upper middle)."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()
    groups, rows = sum(r["c"] for r in sizes), sum(r["c"] * r["n"] for r in sizes)
    if groups < least_distinct or groups > rows / 5:
        return False
    seen = 0
    for r in sizes:
        seen += r["c"]
        if seen > groups // 2:
            return r["n"] >= least_cohort
    return False


def binned(df: DataFrame, field: str, bins: int = 12) -> DataFrame:
    """df with __bin, the field's bin of equal width."""
    low, high = df.agg(F.min(field).cast("double"), F.max(field).cast("double")).first()
    if low is None or high <= low:
        return df.withColumn("__bin", F.lit(0))
    at = F.floor((F.col(field).cast("double") - low) / (high - low) * bins).cast("int")
    return df.withColumn("__bin", F.least(at, F.lit(bins - 1)))


def scan_interaction(df: DataFrame, category: str, axis: str, fields, bins: int | None = 12) -> DataFrame:
    """df with interaction, the context score within cohorts of the category and a second axis: a
    numeric field in equal bins, or another category (bins None). The axis itself is not scored."""
    rows = binned(df, axis, bins) if bins else df.withColumn("__bin", F.col(axis))
    scored = [f for f in fields if f != axis]
    rows = rows.withColumn("__cohort", F.struct(category, "__bin"))
    held = "context" in df.columns
    rows = rows.withColumnRenamed("context", "__context") if held else rows
    out = scan_context(rows, "__cohort", scored).withColumnRenamed("context", "interaction").drop("__cohort", "__bin")
    return out.withColumnRenamed("__context", "context") if held else out


def scan_relational(df: DataFrame, fk: str, attribute: str, amount: str, other: DataFrame, onto: str, other_attribute: str) -> DataFrame:
    """df with relational: 0.4 + 0.6 times the rank share of the amount where the row's attribute
    differs from that of the row its key names, else 0."""
    o = other.groupBy(F.col(onto).alias("__onto")).agg(F.min(other_attribute).alias("__theirs"))
    rows = numbered_rows(df, [F.col(amount).asc_nulls_first()], "__i").join(o, F.col(fk) == F.col("__onto"), "left")
    top = max(1, df.count() - 1)
    differs = F.col("__theirs").isNotNull() & ~F.col(attribute).eqNullSafe(F.col("__theirs"))
    return rows.withColumn("relational", F.when(differs, 0.4 + 0.6 * F.col("__i") / top).otherwise(0.0)).drop("__i", "__onto", "__theirs")


def foreign_keys(df: DataFrame, other: DataFrame, onto: str) -> DataFrame:
    """(field, share): fields of df of the key's type whose values the other table's keys cover,
    by share; those that cover at least half of the distinct values."""
    kind, out = dict(other.dtypes)[onto], None
    same = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    for f, k in df.dtypes:
        if same.get(k, k) != same.get(kind, kind):
            continue
        values = df.select(F.col(f).alias("v")).where("v is not null").distinct()
        met = values.join(other.select(F.col(onto).alias("v"), F.lit(1).alias("hit")).distinct(), "v", "left")
        one = met.agg(F.lit(f).alias("field"), (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out.where("share >= 0.5") if out is not None else df.sparkSession.createDataFrame([], "field string, share double")


def scan_completion(df: DataFrame, key: str, field: str, k: int = 10) -> DataFrame:
    """(key, completion): how far each vector lies off the local tangent of its k neighbours, along
    the direction in which they vary least."""
    from .metric import Index

    import numpy as np
    import pandas as pd

    n = Index(df, key, field).nearest(df, key, field, k)
    v = df.select(F.col(key).alias("key"), F.col(field).cast("array<double>").alias("v"))
    n = n.join(v, "key").groupBy("query").agg(F.collect_list("v").alias("near")).join(v.withColumnRenamed("key", "query"), "query")

    def off(batches):
        for pdf in batches:
            out = []
            for q, near, x in zip(pdf["query"], pdf.near, pdf.v):
                near = np.vstack(near)
                c = near - near.mean(0)
                least = np.linalg.svd(c, full_matrices=True)[2][-1]
                out.append((q, float(abs((np.asarray(x) - near.mean(0)) @ least))))
            yield pd.DataFrame(out, columns=["key", "completion"])

    return n.mapInPandas(off, f"key {dict(df.dtypes)[key]}, completion double")


def fitted_weights(df: DataFrame, key: str, lenses, label: str, folds: int = 5) -> DataFrame:
    """(lens, weight, auc): weights of squashed lens scores learned from a 0/1 label by logistic
    regression on all rows; auc is the mean over `folds` of rows held out by a hash of the key."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    from .relational import cut

    rows = df.select(*[squash(F.coalesce(F.col(x).cast("double"), F.lit(0.0))).alias(x) for x in lenses], F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    rows = cut(rows)
    v = VectorAssembler(inputCols=list(lenses), outputCol="features").transform(rows)
    fit = LogisticRegression(maxIter=100, regParam=0.01)
    area = BinaryClassificationEvaluator()
    found = [area.evaluate(fit.fit(v.where(F.col("fold") != f)).transform(v.where(F.col("fold") == f))) for f in range(folds)]
    model = fit.fit(v)
    return df.sparkSession.createDataFrame([(n, float(w), sum(found) / folds) for n, w in zip(lenses, model.coefficients)], "lens string, weight double, auc double")


def episodes(df: DataFrame, order: str, ratio: float = 3.0, by: str | None = None) -> DataFrame:
    """([by,] at, gap, ratio): gaps of the sorted field of each series that are `ratio` times the
    series' median (its upper middle), or more. Without `by` all rows are one series, whose ranks
    are taken over ranges of values, not in one task."""
    one = "__one" if by is None else by
    rows = df.withColumn("__one", F.lit(0)) if by is None else df
    rows = numbered_rows(rows.where(F.col(order).isNotNull()).select(one, F.col(order).alias("at")), [one, "at"])
    after = rows.select((F.col("i") - 1).alias("i"), F.col(one).alias("__by"), F.col("at").alias("after"))
    gaps = rows.join(after, "i").where(F.col(one) == F.col("__by")).select(one, "at", (F.col("after") - F.col("at")).alias("gap"))
    ranks = numbered_rows(gaps.select(one, "gap"), [one, "gap"])
    g = ranks.groupBy(one).agg(F.min("i").alias("low"), F.count("*").alias("n"), F.max("gap").alias("top"))
    mid = ranks.select("i", "gap").join(g.select(F.col(one).alias("__by"), (F.col("low") + F.expr("n div 2")).alias("i"), "top"), "i")
    mid = mid.select(F.col("__by").alias(one), F.greatest(F.col("gap").cast("double"), 1e-6 * F.col("top")).alias("mid"))
    out = gaps.join(mid, one).withColumn("ratio", F.col("gap") / F.col("mid")).where(F.col("ratio") >= ratio).drop("mid")
    return out.drop("__one")
