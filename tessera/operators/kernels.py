"""Smaller kernels: base geometry, commuting adjacencies, belief updates, neighbourhood samples,
Langevin dreams, completion over a metric, SU(2) fields on lattices and transport around loops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors as V
from .metric import Index
from .relational import cut, numbered_rows


def base_geometry(df: DataFrame, key: str) -> DataFrame:
    """(mode, start, step, share): 'flat' if the integer key goes on by its first step throughout,
    'nearly flat' over 0.95 of the way, else 'curved', as with fewer than two keys."""
    rows = numbered_rows(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")), ["k"])
    on = rows.select((F.col("i") - 1).alias("i"), F.col("k").alias("next"))
    first = rows.where("i < 2").agg(F.min("k").alias("start"), (F.max("k") - F.min("k")).alias("step"), F.count("*").alias("c"))
    gaps = rows.join(on, "i").join(F.broadcast(first), F.lit(True))
    share = gaps.agg(F.avg((F.expr("next - k = step") & (F.col("step") != 0)).cast("double")).alias("share"))
    mode = F.when(F.col("share") == 1, "flat").when(F.col("share") > 0.95, "nearly flat").otherwise("curved")
    return share.join(F.broadcast(first.drop("c")), F.lit(True)).select(mode.alias("mode"), "start", "step", F.coalesce("share", F.lit(0.0)).alias("share"))


def commuting(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(commute, max_entry): whether two adjacencies (src, dst, w) commute, and the greatest entry of
    AB - BA, from sparse products by joins."""

    def product(x, y):
        y = y.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("v"))
        return x.join(y, F.col("dst") == F.col("mid")).groupBy("src", "to").agg(F.sum(F.col("w") * F.col("v")).alias("p"))

    both = product(a, b).unionByName(product(b, a).withColumn("p", -F.col("p"))).groupBy("src", "to").agg(F.abs(F.sum("p")).alias("p"))
    return both.agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("max_entry")).select((F.col("max_entry") <= tolerance).alias("commute"), "max_entry")


def reweighted(p: DataFrame, likelihood: DataFrame) -> DataFrame:
    """(state, p): a belief updated by (state, l), normalised; states without a likelihood go."""
    out = p.join(likelihood, "state").select("state", (F.col("p") * F.col("l")).alias("p"))
    return out.join(F.broadcast(out.agg(F.sum("p").alias("t"))), F.lit(True)).where("t > 0").select("state", (F.col("p") / F.col("t")).alias("p"))


def moved(p: DataFrame, channel: DataFrame) -> DataFrame:
    """(state, p): a belief sent through a channel (state, to, q)."""
    return p.join(channel, "state").groupBy(F.col("to").alias("state")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def update_commutator(p: DataFrame, a, b, low: float = 0.3, high: float = 0.95) -> DataFrame:
    """(tv, hellinger, kl_bits, regime) between b(a(p)) and a(b(p)): sofic if KL diverges or TV is
    `high` or more, smooth if it is `low` or less, borderline between."""
    from .sealing import belief_distances

    d = belief_distances(b(a(p)), a(b(p)), "state", "p")
    regime = F.when(F.col("kl_bits").isNull() | (F.col("tv") >= high), "sofic").when(F.col("tv") <= low, "smooth").otherwise("borderline")
    return d.withColumn("regime", regime)


def sample_neighbourhood(df: DataFrame, key: str, at: dict[str, float], within: float, ranges: dict[str, float], n: int, seed: int = 1) -> DataFrame:
    """n records near a point, drawn without replacement by a hash of seed and key."""
    near = V.near(df, at, within, ranges)
    return near.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def dreams(df: DataFrame, field: str, n: int = 100, steps: int = 50, rate: float = 0.1, temperature: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, v): Langevin walks in the Gaussian fitted to a vector column, from its mean: each step
    moves by -rate (v - mean) and sqrt(2 rate temperature) times noise of the fitted covariance. At
    temperature 1 they come to be distributed as the fit, at 0 they rest at the mean."""
    import pandas as pd

    _, mean, cov = V.moments(df, field)
    lam, u = np.linalg.eigh(cov)
    root = u * np.sqrt(np.maximum(lam, 0.0))

    def walk(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng((seed, int(i)))
                v = mean.copy()
                for _ in range(steps):
                    v = v - rate * (v - mean) + math.sqrt(2 * rate * temperature) * (root @ rng.normal(size=len(mean)))
                out.append((i, v))
            yield pd.DataFrame(out, columns=["id", "v"])

    return df.sparkSession.range(n).mapInPandas(walk, "id long, v array<double>")


def reconstructed(df: DataFrame, key: str, field: str, rank: int = 2) -> DataFrame:
    """(key, v): vectors rebuilt from the `rank` main axes of their fit."""
    mean, v, _ = V.axes(df, field, rank)
    p = v.T @ v
    x = F.col(field).cast("array<double>")
    return df.select(key, F.array(*[V.dot(x, V._array(row)) + float(m - row @ mean) for row, m in zip(p, mean)]).alias("v"))


def completed_near(df: DataFrame, key: str, field: str, vector: str, radius: float) -> DataFrame:
    """(key, predicted, confidence): missing values from records within the radius of a vector
    column, weighed 1 - d / radius, outliers (modified z over 3) left out; two neighbours needed,
    confidence n_eff / (n_eff + 1) with n_eff = (sum w)**2 / sum w**2."""
    known, asked = df.where(F.col(field).isNotNull()), df.where(F.col(field).isNull())
    values = known.select(F.col(key).alias("key"), F.col(field).cast("double").alias("y"))
    n = Index(known, key, vector).sums_within(asked, key, vector, radius, values)
    # One row for each value in a neighbourhood, however many records hold it.
    n = cut(n.groupBy("query", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2")))
    med = n.groupBy("query").agg(F.percentile("y", 0.5, F.col("n")).alias("med"))
    dev = n.join(med, "query").withColumn("dev", F.abs(F.col("y") - F.col("med")))
    mad = dev.groupBy("query").agg(F.percentile("dev", 0.5, F.col("n")).alias("mad"))
    good = dev.join(mad, "query").where("mad = 0 and dev = 0 or mad > 0 and 0.6745 * dev / mad <= 3")
    n_eff = F.pow(F.sum("w"), 2) / F.sum("w2")
    out = good.groupBy("query").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("predicted"), n_eff.alias("e"), F.sum("n").alias("n")).where("n >= 2")
    return out.select(F.col("query").alias("key"), "predicted", (F.col("e") / (F.col("e") + 1)).alias("confidence"))


# -- SU(2) as unit quaternions (a, b, c, d)

def _times(p, q) -> list[Column]:
    a, b, c, d = p
    e, f, g, h = q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def _conjugate(p) -> list[Column]:
    return [p[0], -p[1], -p[2], -p[3]]


def haar(edges: DataFrame, seed: int = 1) -> DataFrame:
    """edges with u, a unit quaternion drawn evenly from SU(2) by a hash of seed and edge: any task
    or retry draws the same."""
    x = [((F.xxhash64(F.lit(seed), "e", F.lit(i)) / F.lit(2.0**64)) + 0.5) for i in range(3)]
    r, s = F.sqrt(1 - x[0]), F.sqrt(x[0])
    t1, t2 = 2 * math.pi * x[1], 2 * math.pi * x[2]
    return edges.withColumn("u", F.array(r * F.sin(t1), r * F.cos(t1), s * F.sin(t2), s * F.cos(t2)))


def identity_field(edges: DataFrame) -> DataFrame:
    return edges.withColumn("u", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def gauged(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with u turned by a vertex field (v, g): g(src) u g(dst)*; plaquettes do not change."""
    g = lambda name: vertices.select(F.col("v").alias(name), F.col("g").alias(f"g_{name}"))
    e = edges.join(g("src"), "src").join(g("dst"), "dst")
    part = lambda c: [F.get(c, F.lit(i)) for i in range(4)]
    return e.withColumn("u", F.array(*_times(_times(part("g_src"), part("u")), _conjugate(part("g_dst"))))).drop("g_src", "g_dst")


def plaquettes_su2(edges: DataFrame, nx: int, ny: int) -> DataFrame:
    """(v, trace): half the trace of the product around each face of a periodic square lattice."""
    e = edges.select("src", "axis", "u")
    v = e.where("axis = 0").select(F.col("src").alias("v"), F.col("u").alias("a"))
    x, y = F.col("v") % nx, F.expr(f"v div {nx}")
    v = v.withColumn("r", y * nx + (x + 1) % nx).withColumn("up", (y + 1) % ny * nx + x)
    for name, at, axis in (("b", "r", 1), ("c", "up", 0), ("d", "v", 1)):
        v = v.join(e.where(f"axis = {axis}").select(F.col("src").alias(at), F.col("u").alias(name)), at)
    part = lambda c: [F.get(c, F.lit(i)) for i in range(4)]
    around = _times(_times(part("a"), part("b")), _conjugate(_times(part("d"), part("c"))))
    return v.select("v", around[0].alias("trace"))


def mean_plaquette(edges: DataFrame, nx: int, ny: int) -> DataFrame:
    return plaquettes_su2(edges, nx, ny).agg(F.avg("trace").alias("mean"))


def loop_transport(edges: DataFrame, loop) -> DataFrame:
    """(u, angle): the ordered product of u along a loop of vertices, edges against their direction
    conjugated, and the angle that it turns by. Only the loop's edges are read; a missing edge is
    refused."""
    steps = list(zip(loop, [*loop[1:], loop[0]]))
    rows = edges.where(F.col("src").isin(*loop) & F.col("dst").isin(*loop)).select("src", "dst", "u").collect()
    known = {(r["src"], r["dst"]): np.array(r["u"]) for r in rows}
    total = np.array([1.0, 0, 0, 0])
    for a, b in steps:
        if (a, b) in known:
            q = known[(a, b)]
        elif (b, a) in known:
            q = known[(b, a)] * [1, -1, -1, -1]
        else:
            raise ValueError(f"no edge between {a} and {b}")
        total = np.array([float(x) for x in _times(total, q)])
    angle = 2 * math.acos(max(-1.0, min(1.0, float(total[0]))))
    return edges.sparkSession.createDataFrame([([float(x) for x in total], angle)], "u array<double>, angle double")


def cubic(spark, n: int, periodic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, x, y, z), edges (e, src, dst, axis)) of an n**3 lattice."""
    v = spark.range(n**3).select(F.col("id").alias("v"), (F.col("id") % n).alias("x"), (F.expr(f"id div {n}") % n).alias("y"), F.expr(f"id div {n * n}").alias("z"))
    out = None
    for axis, (c, step) in enumerate((("x", 1), ("y", n), ("z", n * n))):
        on = v.select(F.col("v").alias("src"), (F.col("v") + step * ((F.col(c) + 1) % n - F.col(c))).alias("dst"), F.lit(axis).alias("axis"), (F.col(c) + 1 < n).alias("inside"))
        out = on if out is None else out.unionByName(on)
    e = out.where(F.lit(periodic) | F.col("inside")).drop("inside")
    return v, e.select((F.col("src") * 3 + F.col("axis")).alias("e"), "src", "dst", "axis")


def truncated_icosahedron(spark) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, x, y, z), edges (e, src, dst)): 60 corners and 90 edges of length 2."""
    g = (1 + math.sqrt(5)) / 2
    found = set()
    for base in ((0, 1, 3 * g), (1, 2 + g, 2 * g), (g, 2, 2 * g + 1)):
        for s in range(8):
            p = [c * (-1 if s >> i & 1 else 1) + 0.0 for i, c in enumerate(base)]
            for r in range(3):
                found.add(tuple(round(p[(i + r) % 3], 9) + 0.0 for i in range(3)))
    points = sorted(found)
    edges = [(i, j) for i in range(60) for j in range(i + 1, 60) if abs(math.dist(points[i], points[j]) - 2) < 1e-6]
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "v long, x double, y double, z double")
    return v, spark.createDataFrame([(n, i, j) for n, (i, j) in enumerate(edges)], "e long, src long, dst long")


def running_product(df: DataFrame, by: str, order: str, angle: str) -> DataFrame:
    """df with frame, the angle of the ordered product of plane rotations up to each row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(angle).over(w)
    return df.withColumn("frame", F.atan2(F.sin(total), F.cos(total)))
