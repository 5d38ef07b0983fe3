"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut, dropped


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): every node of an edge with the smallest id it can reach.

    Each round points nodes at smaller neighbours, as in Kiveris et al. (2014), and halves the
    depth of the trees; links stay in tables of the shared folder, and only a count and a checksum
    reach the driver. A hub's links are dealt to as many parts as a shuffle has, each reduced to its
    minimum, so they never meet in one task. Nulls and loops are ignored; no edges give no rows."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.where("u <> v").distinct())
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def with_least(links: DataFrame) -> DataFrame:
        """links (u, v) with m, the least v of u, the links of a hub u being spread over parts."""
        links = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
        least = links.groupBy("u", "s").agg(F.min("v").alias("m"))
        low = least.groupBy("u").agg(F.min("m").alias("m"))
        return links.join(least.select("u", "s").join(low, "u"), ["u", "s"]).select("u", "v", "m")

    for _ in range(max_rounds):
        # Large star: neighbours larger than u go to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # The largest node of a star keeps its own link.
        large = cut(large.where("u <> v").distinct())
        # Small star: u and its smaller neighbours go to the smallest of them.
        found = with_least(large)
        small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = cut(small.union(found.select("u", F.col("m").alias("v"))).distinct())
        mark = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
        done = e.agg(*mark).first() == small.agg(*mark).first()
        dropped(e)
        dropped(large)
        e = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
