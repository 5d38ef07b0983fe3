"""Scans, point reads, joins along keys, aggregation, windows, sets and recursion."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a lookup that are written into the plan; more become a semi-join.
INLINE_KEYS = 1_000


def point(df: DataFrame, project=None, **key) -> DataFrame:
    """The record at a single or composite key; Parquet statistics prune the scan."""
    out = df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in key.items()])).limit(1)
    return out.select(*project) if project else out


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row `found`; the scan stops at the first hit."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def lookup(df: DataFrame, field: str, values) -> DataFrame:
    """Rows whose field is one of the values."""
    values = list(dict.fromkeys(values))
    if len(values) <= INLINE_KEYS:
        return df.where(F.col(field).isin(*values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], df.select(field).schema)
    return df.join(keys, field, "left_semi")


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field, nulls left out."""
    return df.select(field).where(F.col(field).isNotNull()).distinct()


def overlay(base: DataFrame, recent: DataFrame, keys, deleted: DataFrame | None = None) -> DataFrame:
    """Merge on read: recent rows stand before base rows of their key, deleted keys are gone."""
    keys = list(keys)
    out = base.join(recent.select(*keys), keys, "left_anti").unionByName(recent)
    return out.join(deleted.select(*keys), keys, "left_anti") if deleted is not None else out


def pullback(left: DataFrame, right: DataFrame, along: str, onto: str | None = None, keep_left: bool = False, unique: bool = False) -> DataFrame:
    """Each left row with the right row its foreign key names, so there are at most as many rows as
    on the left: of right rows that repeat a key the least stands (rows are compared as structs).
    On equal names the left column stands. The right side is reduced to one row a key before the
    join, on the key that the join shuffles by anyway; `unique` says that it is one already, as a
    table's own key is, and saves that step."""
    onto = onto or along
    fields = [c for c in right.columns if c not in left.columns and c != onto]
    if unique:
        r = right.select(F.col(onto).alias("__onto"), *fields)
        return left.join(r, F.col(along) == F.col("__onto"), "left" if keep_left else "inner").drop("__onto")
    r = right.where(F.col(onto).isNotNull()).groupBy(F.col(onto).alias("__onto"))
    r = r.agg(F.min(F.struct(*fields)).alias("__r")).select("__onto", "__r.*") if fields else r.agg(F.lit(1).alias("__one")).drop("__one")
    return left.join(r, F.col(along) == F.col("__onto"), "left" if keep_left else "inner").drop("__onto")


def semi(left: DataFrame, right: DataFrame, along: str, onto: str | None = None) -> DataFrame:
    """Left rows whose key occurs on the right."""
    return left.join(right.select(F.col(onto or along).alias("__onto")), F.col(along) == F.col("__onto"), "left_semi")


def anti(left: DataFrame, right: DataFrame, along: str, onto: str | None = None) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    return left.join(right.select(F.col(onto or along).alias("__onto")), F.col(along) == F.col("__onto"), "left_anti")


def iterate(df: DataFrame, key: str, step: str, start, depth: int = 100, accumulate: str | None = None) -> DataFrame:
    """(depth, key[, total]): the nodes reached from `start` along the step field, by joins of the
    frontier. A node is listed at its least depth; the walk ends where a step is null, known, or too
    deep. total: the accumulated field summed along the way there (the least sum of equally short
    ways), the node's own value included. Two tables are kept, those of earlier rounds deleted."""
    value = F.col(accumulate).cast("double") if accumulate else F.lit(0.0)
    edges = df.select(F.col(key).alias("__k"), F.col(step).alias("__next")).where("__next is not null")
    values = df.groupBy(F.col(key).alias("__v")).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("__value"))
    first = df.where(F.col(key) == F.lit(start)).groupBy(key).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("total"))
    seen = front = cut(first.select(F.lit(0).alias("depth"), key, "total"))
    for d in range(1, depth + 1):
        front = front.join(edges, F.col(key) == F.col("__k")).groupBy(F.col("__next").alias(key)).agg(F.min("total").alias("total"))
        front = front.join(seen.select(key), key, "left_anti")
        if accumulate:
            front = front.join(values, F.col(key) == F.col("__v"), "left").withColumn("total", F.col("total") + F.coalesce("__value", F.lit(0.0)))
        front = cut(front.select(F.lit(d).alias("depth"), key, "total"))
        if front.isEmpty():
            break
        old, seen = seen, cut(seen.unionByName(front))
        dropped(old)
    return seen if accumulate else seen.drop("total")


def as_of(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str, fields) -> DataFrame:
    """left with the named fields of the last right row of its keys at or before its time (null
    without one; of right rows at one time the greatest). Both sides are merged in time order: no
    pairs are made."""
    on = list(on)
    values = F.struct(*fields)
    r = right.where(F.col(right_time).isNotNull()).groupBy(*on, F.col(right_time).alias("__t")).agg(F.max(values).alias("__r"))
    rows = left.withColumn("__t", F.col(left_time)).withColumn("__own", F.lit(1))
    both = rows.unionByName(r.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*on).orderBy(F.col("__t").asc_nulls_first(), "__own").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__r", F.last("__r", ignorenulls=True).over(before)).where("__own = 1")
    none = [c for c in fields if c in left.columns]
    return both.select(*left.columns, *[F.when(F.col(left_time).isNotNull(), F.col(f"__r.{f}")).alias(f"{f}_right" if f in none else f) for f in fields])


def theta(left: DataFrame, right: DataFrame, condition: Column, equal=()) -> DataFrame:
    """Pairs of rows that meet a condition; `equal` names columns that must agree, by which both
    sides are shuffled. Without any, the right side has to be small enough to broadcast."""
    if equal:
        return left.join(right, list(equal)).where(condition)
    if right.limit(INLINE_KEYS + 1).count() > INLINE_KEYS:
        raise ValueError(f"more than {INLINE_KEYS} rows on the right and no equal columns")
    return left.join(F.broadcast(right), condition)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the folder that the cluster names in spark.checkpoint.dir
    and read back, which outlives lost executors; where that is unset in a local session (tests), to
    a folder of the session's warehouse."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds"
    path = f"{folder.rstrip('/')}/tessera-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _offsets(rows: DataFrame, size: Column) -> DataFrame:
    """(__part, __before): what stands before each partition of rows; one row a partition."""
    got = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(size.alias("n")).collect())
    out, at = [], 0
    for p, n in got:
        out.append((p, at))
        at += n
    return rows.sparkSession.createDataFrame(out, "__part int, __before long")


def numbered_rows(df: DataFrame, by, name: str = "i") -> DataFrame:
    """df with its row number from 0 in the order of `by`: rows are range-partitioned and stored
    once, partitions counted, and each row's number is its partition's offset plus its place there.
    No task holds more than a partition; the driver sees one count for each. Rows that are equal in
    `by` are spread by their other fields."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.xxhash64(*[f"`{c}`" for c, k in df.dtypes if not k.startswith("map")])] if df.columns else []
    rows = cut(df.repartitionByRange(parts, *by, *rest).withColumn("__part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    rows = rows.withColumn("__place", place).join(F.broadcast(_offsets(rows, F.count("*"))), "__part")
    return rows.withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__before", "__place")


def ranked_values(df: DataFrame, by) -> DataFrame:
    """(by, first, times): the distinct tuples of `by` in order, with the row number from 0 of the
    first row that holds each and how many do: rows are combined before the shuffle, so a value
    that a third of all rows hold is one row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.groupBy(*by).agg(F.count("*").alias("times"))
    rows = cut(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()))
    before = F.sum("times").over(Window.partitionBy("__part").orderBy(*by)) - F.col("times")
    rows = rows.withColumn("__in", before).join(F.broadcast(_offsets(rows, F.sum("times"))), "__part")
    return rows.withColumn("first", F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")


def integrate(df: DataFrame, over=(), where: Column | None = None, having: Column | None = None, **measures: Column) -> DataFrame:
    """Grouped or global aggregation: integrate(df, ["a"], total=F.sum("x"), having=F.col("total") > 1)."""
    if where is not None:
        df = df.where(where)
    named = [m.alias(n) for n, m in measures.items()]
    out = df.groupBy(*over).agg(*named) if over else df.agg(*named)
    return out.where(having) if having is not None else out


def measure_if(condition: Column, value: Column | None = None) -> Column:
    """The value, or 1, where the condition holds: the argument of a conditional measure."""
    return F.when(condition, F.lit(1) if value is None else value)


def population(field) -> dict[str, Column]:
    """Population variance and deviation; 0 for fewer than two values."""
    few = F.count(field) < 2
    return {"variance": F.when(few, 0.0).otherwise(F.var_pop(field)), "stddev": F.when(few, 0.0).otherwise(F.stddev_pop(field))}


def ranked(df: DataFrame, over, by, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*over).orderBy(*by)).cast("long"))


def running(df: DataFrame, over, by, measure: Column, low: int | None, high: int, name: str) -> DataFrame:
    """A window measure over rows low..high of the order; low None for all before."""
    w = Window.partitionBy(*over).orderBy(*by).rowsBetween(Window.unboundedPreceding if low is None else low, high)
    return df.withColumn(name, measure.over(w))


def transported(df: DataFrame, field: str, over, by, shift: int, name: str) -> DataFrame:
    """The field of the row `shift` places on (LEAD), or back if negative (LAG)."""
    w = Window.partitionBy(*over).orderBy(*by)
    return df.withColumn(name, F.lead(field, shift).over(w) if shift > 0 else F.lag(field, -shift).over(w))


def page(df: DataFrame, by, first: int | None = None, skip: int = 0) -> DataFrame:
    """Rows in order, `skip` passed over, then `first` of them."""
    out = df.orderBy(*by)
    if skip:
        out = out.offset(skip)
    return out.limit(first) if first is not None else out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, with `side`."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def glued(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two restrictions with `conflict`: the key occurs in both with different rows."""
    both = a.unionByName(b).distinct()
    n = both.groupBy(key).agg(F.count("*").alias("__n"))
    return both.join(n, key).withColumn("conflict", F.col("__n") > 1).drop("__n")


def series(spark: SparkSession, low: int, high: int, step: int = 1, name: str = "k", **defaults) -> DataFrame:
    """low, low + step, ... up to high, with constant columns."""
    out = spark.range(low, high + 1, step).withColumnRenamed("id", name)
    return out.withColumns({k: F.lit(v) for k, v in defaults.items()}) if defaults else out


def filled(df: DataFrame, over: str, at: str, value: str, low: int, high: int, method: str = "linear", constant=0.0) -> DataFrame:
    """One row for every integer low..high of `at` in each group; missing values are carried
    forward ("transport"), interpolated between neighbours ("linear", null beyond the ends), or
    `constant`."""
    grid = df.select(over).distinct().withColumn(at, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    got = grid.join(df.select(over, F.col(at).cast("long").alias(at), value), [over, at], "left")
    if method == "constant":
        return got.withColumn(value, F.coalesce(value, F.lit(constant)))
    back = Window.partitionBy(over).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    if method == "transport":
        return got.withColumn(value, F.last(value, ignorenulls=True).over(back))
    on = Window.partitionBy(over).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    got = got.withColumn("__a", F.last(known, ignorenulls=True).over(back)).withColumn("__b", F.first(known, ignorenulls=True).over(on))
    slope = (F.col("__b.v") - F.col("__a.v")) / (F.col("__b.t") - F.col("__a.t"))
    line = F.when(F.col("__a.t") == F.col("__b.t"), F.col("__a.v")).otherwise(F.col("__a.v") + slope * (F.col(at) - F.col("__a.t")))
    return got.withColumn(value, line).drop("__a", "__b")
