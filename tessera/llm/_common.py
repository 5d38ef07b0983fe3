"""What several corpus operators share: shared-folder tables, text blocks, whole-row helpers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into arrays at a time; bounds its memory.
BLOCK_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir; where it
    is unset in a local session (tests), a folder of the session's warehouse. On a cluster it has to
    be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, the session set to send Python workers batches of at most `most` bytes (or one row), as
    whole texts make large ones; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not now or int(now[1]) > most:
        conf.set(name, str(most))
    return df


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: allocators keep it otherwise,
    and workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the GNU library


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; others, also ones with clashing names,
    never enter the plan. narrowed(df, doc_id="id") selects id as doc_id."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def blocks(texts: list, most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: A key is hot with more rows than this, or than a MOST_HOT-th of all rows.
HOT_ROWS, MOST_HOT = 20_000, 1_000


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """(keys, salts) of the hot ones of counts (keys, rows), broadcast: fewer than MOST_HOT by
    construction. None if there are none, and joins need no salt."""
    counts = stored(counts, "counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    least = max(HOT_ROWS if hot_rows is None else hot_rows, total // MOST_HOT)
    hot = counts.where(F.col("rows") > least).select(*keys, F.ceil(F.col("rows") / least).cast("int").alias("__salts"))
    return None if hot.isEmpty() else F.broadcast(stored(hot, "hot"))


def salts(df: DataFrame, hot: DataFrame | None, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """df with the column salt: a hot key's rows are dealt by the hash of `by` to as many parts as
    their number asks for; without `by`, they are repeated for each part."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    n = F.coalesce("__salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*by), n).cast("int") if by else F.explode(F.sequence(F.lit(0), n - 1))
    return df.join(hot, keys, "left").withColumn("salt", salt).drop("__salts")


def salted(left: DataFrame, right: DataFrame, key: str, by: list[str], counts: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """left joined with right, which has few rows of each key, on key (inner), hot keys salted.

    counts: (key, rows) of left, if known; left must read stored tables, as it is also counted."""
    counts = left.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts
    hot = hot_keys(counts, [key], hot_rows)
    if hot is None:
        return left.join(right, key)
    return salts(left, hot, [key], by).join(salts(right, hot, [key]), [key, "salt"]).drop("salt")


#: Items of a sweep whose results are gathered before they join the others.
CHUNK = 128


def held(value: F.Column, use) -> F.Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sweep(items: F.Column, zero: F.Column, step, rows: str) -> F.Column:
    """Struct (state, all) after step(state, item) -> (state, array of results, of type `rows`) over
    all items in turn. Results join an array of their chunk, chunks are flattened at the end:
    appending to one array would copy it for every item."""

    def swept(all_items):
        none = F.array().cast(rows)
        last = F.floor((F.size(all_items) - 1) / CHUNK).cast("int")
        chunks = F.when(F.size(all_items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def one(s, x):
            state, more = step(s["state"], x)
            return F.struct(state.alias("state"), F.concat(s["all"], more).alias("all"))

        def chunk(s, i):
            part = F.aggregate(F.slice(all_items, i * CHUNK + 1, F.lit(CHUNK)), F.struct(s["state"].alias("state"), none.alias("all")), one)
            return held(part, lambda p: F.struct(p["state"].alias("state"), F.concat(s["all"], F.array(p["all"])).alias("all")))

        start = F.struct(zero.alias("state"), F.array().cast(f"array<{rows}>").alias("all"))
        return F.aggregate(chunks, start, chunk, lambda s: F.struct(s["state"].alias("state"), F.flatten(s["all"]).alias("all")))

    return held(items, swept)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows, found without counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` narrow rows; else without, and the join
    shuffles (AQE splits a skewed side)."""
    return F.broadcast(df) if small_enough(df, rows) else df
