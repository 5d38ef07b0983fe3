"""URL filters by a temporal list join.

Dated list entries (add or remove a key of a category at a time) become validity intervals, and
every capture is judged by the entries that were active when it was fetched. Keys are domains, which
cover their subdomains, and host/path prefixes, which cover longer paths; the longest active key
decides, and the category 'allow' lets the capture pass. DataFrame functions only.

A key is met as 128 bits of a hash chained over its labels or path segments, so the keys of a URL
take time and space in proportion to its length. Captures on listed keys are merged in time with
the intervals of each category of the key and take the last that began: each interval is read once
however many there are. Hot keys are salted before the first shuffle: a key's captures are dealt to
as many parts as its count asks for, and its intervals are repeated for each. What is broadcast is
the hot keys, at most MOST_HOT by construction, and a list counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import hot_keys, narrowed, salts, small_enough, stored, sweep

#: Most listed keys that are broadcast.
MOST_KEYS = 100_000


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of entries (key, category, action, effective):
    an 'add' is valid until the next entry of its key and category, or for ever (null valid_to).

    Repeated entries count once; at equal times 'remove' follows 'add', and intervals of no length
    are left out. Entries without key, category, action or time, or with another action, are
    ignored. A key's entries are ordered by month, and months by their first entry, so that no
    task sorts all entries of a hot key."""
    e = narrowed(entries, key="key", category="category", action="action", effective="effective")
    e = e.where("key is not null and category is not null and effective is not null and action in ('add', 'remove')").distinct()
    # Of entries with one time the removal stands.
    e = e.groupBy("key", "category", "effective").agg(F.max("action").alias("action"))
    e = e.withColumn("month", F.date_trunc("month", "effective"))
    months = e.groupBy("key", "category", "month").agg(F.min("effective").alias("first"))
    later = Window.partitionBy("key", "category").orderBy("month")
    months = months.withColumn("next_first", F.lead("first").over(later)).drop("first")
    inside = Window.partitionBy("key", "category", "month").orderBy("effective")
    e = e.withColumn("next", F.lead("effective").over(inside)).join(months, ["key", "category", "month"])
    e = e.where("action = 'add'").select("key", "category", F.col("effective").alias("valid_from"), F.coalesce("next", "next_first").alias("valid_to"))
    return e


def host(url: F.Column) -> F.Column:
    """Lower-cased host of a URL, without user, port and final dots; '' if it has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.lower(F.regexp_replace(found, r"\.+$", ""))


KEYS = "array<struct<k1:long,k2:long>>"


def _chained(parts: F.Column, kind: str, first: F.Column | None = None) -> F.Column:
    """KEYS of the hashes of all beginnings of parts (after `first`, if given), which do not end
    with an empty part."""
    seed = F.lit(kind) if first is None else F.concat(F.lit(kind), first)
    zero = F.struct(F.xxhash64(seed).alias("k1"), F.xxhash64(F.lit(1), seed).alias("k2"))

    def step(s, part):
        new = F.struct(F.xxhash64(s["k1"], part).alias("k1"), F.xxhash64(part, F.lit(1), s["k2"]).alias("k2"))
        return new, F.when(part != "", F.array(new)).otherwise(F.array().cast(KEYS))

    return sweep(parts, zero, step, KEYS)["all"]


def _domains(h: F.Column) -> F.Column:
    return _chained(F.reverse(F.split(h, r"\.")), "d")


def keys(url: F.Column) -> F.Column:
    """KEYS that cover a URL: of its host and parent domains, and of host/path prefixes at '/'."""
    h = host(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.when(h == "", F.array().cast(KEYS)).otherwise(F.concat(_domains(h), _chained(F.split(path, "/"), "p", h)))


def listed(key: F.Column) -> F.Column:
    """The struct (k1, k2) of a list entry's key, as keys() has it; null for one that covers nothing
    (an empty key, or one that ends with '/')."""
    parts = F.split(key, "/")
    path = _chained(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "p", F.get(parts, F.lit(0)))
    return F.when(~key.endswith("/") & (key != ""), F.element_at(F.when(F.contains(key, F.lit("/")), path).otherwise(_domains(key)), -1))


def judged(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", at: str = "fetched_at", most_keys: int = MOST_KEYS) -> DataFrame:
    """(id, url, fetched_at, n_active, category, blocked) for each row of captures.

    n_active counts the active (key, category) pairs that cover the URL; category is that of the
    longest key among them (then the lesser category), null without any; blocked says that there is
    one and it is not 'allow'. Captures without a URL, host or time match nothing; repeated rows
    stay and are judged alike. An empty key, or one that ends with "/", covers nothing. URLs and lists of entries may be of any length. Other columns play no
    part."""
    own = captures.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").alias("fetched_at"))
    spans = intervals(entries).withColumn("k", listed(F.col("key"))).where("k is not null")
    spans = stored(spans.select("k.*", F.char_length("key").alias("n"), "category", "valid_from", "valid_to"), "intervals")
    kinds = stored(spans.select("k1", "k2", "n", "category").distinct(), "kinds")
    # From here on a capture's URL is its digest, as it stands on a row for each of its keys.
    said = F.sha2(F.col("url").cast("binary"), 256).alias("u")
    met = own.where("url is not null and fetched_at is not null").select("id", said, "fetched_at", "url").distinct()
    met = met.select("id", "u", "fetched_at", F.explode(keys(F.col("url"))).alias("k")).select("id", "u", "fetched_at", "k.*")
    if small_enough(kinds, most_keys):
        met = met.join(F.broadcast(kinds), ["k1", "k2"])
    else:
        hot = hot_keys(met.groupBy("k1", "k2").agg(F.count("*").alias("rows")), ["k1", "k2"])
        met = salts(met, hot, ["k1", "k2"], ["id", "u"]).join(salts(kinds, hot, ["k1", "k2"]), ["k1", "k2", "salt"]).drop("salt")
    met = stored(met, "met")
    series = ["k1", "k2", "category"]
    hot = hot_keys(met.groupBy(*series).agg(F.count("*").alias("rows")), series)
    left = salts(met, hot, series, ["id", "u"]).select(*series, "salt", "n", "id", "u", "fetched_at", F.col("fetched_at").alias("time"), F.lit(1).alias("capture"))
    right = salts(spans, hot, series).select(*series, "salt", F.col("valid_from").alias("time"), F.struct("valid_to").alias("span"), F.lit(0).alias("capture"))
    before = Window.partitionBy(*series, "salt").orderBy("time", "capture").rowsBetween(Window.unboundedPreceding, 0)
    active = left.unionByName(right, allowMissingColumns=True).withColumn("last", F.last("span", ignorenulls=True).over(before))
    active = active.where("capture = 1 and last is not null and (last.valid_to is null or fetched_at < last.valid_to)")
    best = F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("best")
    found = active.groupBy("id", "u", "fetched_at").agg(F.count("*").alias("n_active"), best)
    own = own.withColumn("u", said)
    out = own.alias("o").join(found.alias("f"), F.expr("o.id <=> f.id and o.u = f.u and o.fetched_at = f.fetched_at"), "left")
    category = F.col("f.best.category")
    return out.select(
        F.col("o.id").alias(id),
        F.col("o.url").alias("url"),
        F.col("o.fetched_at").alias("fetched_at"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        category.alias("category"),
        F.coalesce(category != "allow", F.lit(False)).alias("blocked"),
    )


def demo_entries(pages: DataFrame, url: str = "url") -> DataFrame:
    """A dated list over the hosts of pages, for queries and tests: each host is listed, unlisted
    and perhaps listed again on days drawn from its md5; parent domains are parked for a fortnight;
    half of the hosts have an allowed /en prefix."""
    hosts = pages.select(host(F.col(url)).alias("host")).where("host <> ''").distinct()

    def draw(part: int, n: int) -> F.Column:
        return F.conv(F.substring(F.md5(F.col("host")), part, 4), 16, 10).cast("long") % n

    def day(n: F.Column) -> F.Column:
        return F.timestamp_seconds(F.lit(1704067200) + n * 86400).cast("timestamp_ntz")

    first = draw(1, 180)
    second = first + 1 + draw(5, 120)
    third = second + 1 + draw(9, 90)
    kind = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (draw(13, 3) + 1).cast("int"))
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    entry = lambda key, category, action, when: F.struct(key.alias("key"), category.alias("category"), F.lit(action).alias("action"), when.alias("effective"))
    rows = F.array(
        entry(F.col("host"), kind, "add", day(first)),
        entry(F.col("host"), kind, "remove", day(second)),
        F.when(draw(17, 3) == 0, entry(F.col("host"), kind, "add", day(third))),
        entry(parent, F.lit("parked"), "add", day(F.lit(152))),
        entry(parent, F.lit("parked"), "remove", day(F.lit(166))),
        F.when(draw(21, 2) == 0, entry(F.concat("host", F.lit("/en")), F.lit("allow"), "add", day(F.lit(60)))),
    )
    return hosts.select(F.explode(rows).alias("e")).where("e is not null").select("e.*").distinct()
