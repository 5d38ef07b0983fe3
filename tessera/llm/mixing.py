"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its share of the target over its rows. A document's number
of copies inverts the Poisson distribution of that mean at a number hashed from the seed and the
document, so that any run, task or retry repeats it the same number of times; it is exploded by
that number, and the copies are shuffled globally by hashed keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import maybe_broadcast, stored

#: The largest mean inverted at once; a larger one is the sum of equal parts below it.
PART = 32.0


def unit(*parts) -> F.Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(df: DataFrame, weights: dict[str, float], source: str = "source", default_weight: float = 1.0, total: float | None = None) -> DataFrame:
    """(source, n, rate): rows of each source of df and its mean repetitions, so that `total` rows
    (default: as many as df has) are expected, in the ratio of the weights. A source without a
    weight, null among them, has default_weight; one of weight 0 has rate 0."""
    if min([default_weight, *weights.values()]) < 0:
        raise ValueError("weights must not be negative")
    counts = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default_weight))
    if weights:
        known = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        weight = F.coalesce(F.when(F.col("source").isNotNull(), known[F.col("source")]), weight)
    counts = stored(counts.withColumn("weight", weight), "rates")
    all_n, all_weight = counts.agg(F.sum("n"), F.sum("weight")).first()
    if not all_weight:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    total = float(all_n if total is None else total)
    return counts.select("source", "n", (F.col("weight") / F.lit(float(all_weight)) * F.lit(total) / F.col("n")).alias("rate"))


def _distribution(rate: F.Column) -> tuple[F.Column, F.Column]:
    """Number of parts, and cumulative probabilities of a part's 0, 1, 2, ... copies until they
    round to 1."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    mean = rate / parts
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    zero = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return parts, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["all"])


def replicated(df: DataFrame, weights: dict[str, float], id: str = "doc_id", source: str = "source", default_weight: float = 1.0, total: float | None = None, seed: int = 0, keys: bool = True) -> DataFrame:
    """df's rows, each repeated its Poisson number of times and shuffled globally, with the columns
    copy (from 0) and shuffle_key (32 hexadecimal digits) in place of any of these names; without
    keys, with df's own columns only.

    Rows that repeat an id get the same number of copies each; a null id counts as the text
    'null'. Rows of a source with rate 0 go. Ties of shuffle_key stand in any order. An empty
    table gives no rows."""
    r = rates(df, weights, source, default_weight, total)
    parts, cumulative = _distribution(F.col("rate"))
    r = r.where("rate > 0").select(F.col("source").alias("__source"), parts.alias("__parts"), cumulative.alias("__cumulative"))
    names = [c for c in df.columns if not keys or c not in ("copy", "shuffle_key")]
    own = df.select(*[f"`{c}`" for c in names])
    # One row per source; broadcast only if they are found to be few, else joined by a shuffle.
    own = own.join(maybe_broadcast(r, 10_000), F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("null"))
    drawn = F.transform(
        F.sequence(F.lit(1), "__parts"),
        lambda k: F.size(F.filter("__cumulative", lambda c: c <= unit(F.lit(str(seed)), key, k.cast("string")))),
    )
    copies = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    own = own.withColumn("__copies", copies).where("__copies > 0")
    own = own.select(*[f"`{c}`" for c in names], F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__copy"))
    own = own.withColumn("__key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("__copy").cast("string")).cast("binary")))
    own = own.repartition("__key").sortWithinPartitions("__key")
    return own.withColumnsRenamed({"__copy": "copy", "__key": "shuffle_key"}) if keys else own.drop("__copy", "__key")
