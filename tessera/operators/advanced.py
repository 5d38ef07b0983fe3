"""Composite and numerical verbs: capacity horizons, free energy, health, invariants, what-if,
provenance, density and neighbour methods, persistence, sampling, lattices.

Where a verb needs a matrix or an ordered walk, its size is bounded by a parameter and checked; a
larger input is refused loudly rather than cut."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import geometry as G
from . import graph as GR
from . import vectors as V
from .components import connected_components
from .metric import Index, placed
from .relational import cut, dropped, numbered_rows
from .series import in_order


def _one(spark, kind: str, *row) -> DataFrame:
    return spark.createDataFrame([row], kind)


def _rows(df: DataFrame, most: int) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got


# -- Geometry

def horizon(df: DataFrame, fields, indexed, tolerance: float = 1.0) -> DataFrame:
    """(k, gap, length, horizon, depth): tolerance / (k * length), length 1 / sqrt(gap), and I-IV."""
    gap = GR.spectral_gap(df, indexed).select(F.coalesce("gap", F.lit(0.0)).alias("gap"))
    out = G.curvature(df, fields).select("k").join(F.broadcast(gap), F.lit(True))
    out = out.withColumn("length", F.when(F.col("gap") > 0, 1 / F.sqrt("gap")))
    return out.withColumn("horizon", F.lit(tolerance) / (F.col("k") * F.col("length"))).withColumn("depth", G.depth(F.col("k"), F.col("gap")))


def lambda_budget(k: float, diameter: float, tolerance: float) -> float:
    return 1 - tolerance / (k * diameter**2)


def free_energy(df: DataFrame, key: str, index: str, field: str, span: float, taus=(0.1, 0.5, 1.0), points: int = 50) -> DataFrame:
    """(tau, f): -tau ln Z averaged over `points` strided records; Z = 1 + sum over the records that
    share `index` of exp(-|difference| / span / tau). The points, a fixed number, meet their
    neighbours by an equi-join."""
    n = df.count()
    step = max(1, n // points)
    p = numbered_rows(df, [key], "__r").where((F.col("__r") % step == 0) & (F.col("__r") < step * points))
    p = p.select(F.col(key).alias("__k"), F.col(index).alias("__i"), F.col(field).alias("__v"))
    d = F.abs(F.col("__v") - F.col(field)) / F.lit(span)
    z = F.broadcast(p).join(df, F.col("__i") == F.col(index)).groupBy("__k").agg(*[F.sum(F.when(F.col("__k") != F.col(key), F.exp(-d / t)).otherwise(0.0)).alias(f"z{i}") for i, t in enumerate(taus)])
    row = z.agg(*[F.avg(-t * F.log(1 + F.col(f"z{i}"))).alias(f"f{i}") for i, t in enumerate(taus)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(f"f{i}").alias("f")) for i, t in enumerate(taus)])))


def thermodynamics(df: DataFrame, key: str, index: str, field: str, span: float, taus=(0.1, 0.5, 1.0), points: int = 50) -> DataFrame:
    """(tau, f, heat, entropy, k): free energy, heat capacity tau**2 F'' by second differences of
    step 0.01 tau + 1e-6, entropy of the index and curvature. One pass gives all three F of a tau."""
    steps = [(t, 0.01 * t + 1e-6) for t in taus]
    f = free_energy(df, key, index, field, span, [x for t, h in steps for x in (max(t - h, 1e-15), t, t + h)], points)
    f = f.agg(F.map_from_entries(F.collect_list(F.struct("tau", "f"))).alias("f"))
    value = lambda t: F.col("f")[F.lit(float(t))]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("tau"), value(t).alias("f"), (t * t * (value(t + h) - 2 * value(t) + value(max(t - h, 1e-15))) / (h * h)).alias("heat")) for t, h in steps])
    out = f.select(F.inline(rows))
    for part in (G.entropy(df, [index]).select("entropy"), G.curvature(df, [field]).select("k")):
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def holonomy_near(df: DataFrame, f1: str, f2: str, around: str, at: dict[str, float], within: float, ranges: dict[str, float], metric: str = "euclid") -> DataFrame:
    """(groups, deficit) of the loop of group centroids of the records near a point."""
    return G.holonomy(V.near(df, at, within, ranges, metric), f1, f2, around)


def health(df: DataFrame, key: str, fields, indexed) -> DataFrame:
    """(records, k, confidence, entropy, beta_0, beta_1): one row that sums a table up."""
    out = df.agg(F.count("*").alias("records"))
    for part in (G.curvature(df, fields).select("k", "confidence"), G.entropy(df, indexed).select("entropy"), GR.betti(df, key, indexed)):
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def invariant(df: DataFrame, expression: str, key: str, fields, indexed, tolerance: float = 1.0) -> DataFrame:
    """(value): an arithmetic expression over k, confidence, capacity, entropy, beta_0, beta_1."""
    h = health(df, key, fields, indexed).withColumn("capacity", G.capacity("k", tolerance))
    return h.select(F.expr(expression).cast("double").alias("value"))


def gauge_test(a: DataFrame, b: DataFrame, f1: str, f2: str, around: str) -> DataFrame:
    """(delta, invariant): whether two tables' loops turn alike, to pi / 10."""
    both = G.holonomy(a, f1, f2, around).select(F.col("deficit").alias("a")).join(F.broadcast(G.holonomy(b, f1, f2, around).select(F.col("deficit").alias("b"))), F.lit(True))
    delta = F.abs(F.col("a") - F.col("b"))
    return both.select(F.least(delta, 2 * math.pi - delta).alias("delta")).withColumn("invariant", F.col("delta") < math.pi / 10)


def rotation(a, b) -> np.ndarray:
    """The rotation that turns direction a into b in their plane and leaves the rest."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    u = a / max(np.linalg.norm(a), 1e-300)
    w = b / max(np.linalg.norm(b), 1e-300)
    c = float(u @ w)
    v = w - c * u
    s = np.linalg.norm(v)
    if s < 1e-12:
        return np.eye(len(a))
    v = v / s
    return np.eye(len(a)) + (c - 1) * (np.outer(u, u) + np.outer(v, v)) + s * (np.outer(v, u) - np.outer(u, v))


def transport(df: DataFrame, key: str, start, end, fields) -> DataFrame:
    """(field, displacement, row): between two records, each field's change and its row of the
    rotation matrix."""
    got = {r[key]: [float(r[f]) for f in fields] for r in df.where(F.col(key).isin(start, end)).select(key, *fields).collect()}
    m = rotation(got[start], got[end])
    return df.sparkSession.createDataFrame([(f, got[end][i] - got[start][i], [float(x) for x in m[i]]) for i, f in enumerate(fields)], "field string, displacement double, row array<double>")


def perceive(past: np.ndarray, now: np.ndarray) -> float:
    """Coherence 1 - |R_now R_past' - I| / (2 sqrt(dim)), in [0, 1]."""
    n = len(past)
    return float(np.clip(1 - np.linalg.norm(now @ past.T - np.eye(n)) / (2 * math.sqrt(n)), 0, 1))


# -- Completion and provenance

def propagate(df: DataFrame, key: str, field: str, by: str, changes: DataFrame) -> DataFrame:
    """(key, before, after): predictions of missing values that change, appear (before null) or go
    (after null) if `changes` (key, field) held; a billionth of a value is no change."""
    held = df.join(changes.select(key, F.col(field).alias("__new")), key, "left").withColumn(field, F.coalesce("__new", field)).drop("__new")
    a = GR.completed(df, key, field, by).select("key", F.col("predicted").alias("before"))
    b = GR.completed(held, key, field, by).select("key", F.col("predicted").alias("after"))
    return a.join(b, "key", "full").where(F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("before") - F.col("after")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("before"))))


def completed_across(df: DataFrame, key: str, field: str, on: str, other: DataFrame, other_on: str, other_field: str, quality: float = 0.8) -> DataFrame:
    """(key, predicted, confidence): missing values from another table's records of the same key, at
    a discount."""
    m = other.where(F.col(other_field).isNotNull()).groupBy(F.col(other_on).alias("__on")).agg(F.avg(other_field).alias("predicted"), F.count("*").alias("n"))
    return df.where(F.col(field).isNull()).join(m, F.col(on) == F.col("__on")).select(F.col(key).alias("key"), "predicted", (F.lit(quality) * F.col("n") / (F.col("n") + 1)).alias("confidence"))


def suggest_adjacency(df: DataFrame, key: str, field: str, candidates, threshold: float = 3.0) -> DataFrame:
    """(candidate, contradictions): fields by which the values contradict their neighbours least."""
    from .anomaly import consistency

    out = None
    for c in candidates:
        one = consistency(df, key, c, field, threshold).agg(F.lit(c).alias("candidate"), F.count("*").alias("contradictions"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("contradictions", "candidate")


def mismatches(df: DataFrame, key: str, fk: str, attribute: str, other: DataFrame, onto: str, other_attribute: str) -> DataFrame:
    """(key, own, theirs): rows whose attribute differs from that of the row their key names."""
    o = other.select(F.col(onto).alias("__onto"), F.col(other_attribute).alias("theirs"))
    return df.join(o, F.col(fk) == F.col("__onto")).where(~F.col(attribute).eqNullSafe(F.col("theirs"))).select(F.col(key).alias("key"), F.col(attribute).alias("own"), "theirs")


def implications(edges: DataFrame, start, depth: int = 5) -> DataFrame:
    """(node, depth): what follows from `start` along (src, dst), breadth first; reversed edges give
    its reasons."""
    kind = dict(edges.dtypes)["src"]
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], f"node {kind}, depth int")
    for d in range(1, depth + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        front = cut(front.join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def resolved(df: DataFrame, incoming: DataFrame, key: str, field: str, tolerance: float, policy: str = "branch") -> DataFrame:
    """Incoming values that contradict known ones by more than the tolerance are allowed (both stay,
    branch 1), rejected, repaired (the mean), or branched (kept as branch 1 beside the old)."""
    new = incoming.select(key, F.col(field).alias("__new"))
    j = df.join(new, key, "left").withColumn("__bad", F.coalesce(F.abs(F.col(field) - F.col("__new")) > tolerance, F.lit(False)))
    own = j.withColumn(field, F.when(F.col("__new").isNull(), F.col(field)).when(~F.col("__bad"), F.col("__new")).when(F.lit(policy == "repair"), (F.col(field) + F.col("__new")) / 2).otherwise(F.col(field)))
    out = own.select(*df.columns, F.lit(0).alias("branch"))
    if policy in ("allow", "branch"):
        out = out.unionByName(j.where("__bad").withColumn(field, F.col("__new")).select(*df.columns, F.lit(1).alias("branch")))
    return out


# -- Density, neighbours, clusters

def neighbours_of(queries: DataFrame, rows: DataFrame, key: str, field: str, k: int) -> DataFrame:
    """(query, key, distance): the k nearest other rows of each query, exactly."""
    return Index(rows, key, field).nearest(queries, key, field, k)


def infer(known: DataFrame, asked: DataFrame, key: str, field: str, target: str, k: int = 20) -> DataFrame:
    """(key, predicted, confidence): tricube-weighted mean of the k nearest known targets."""
    n = neighbours_of(asked, known, key, field, k).join(known.select(F.col(key).alias("key"), F.col(target).cast("double").alias("t")), "key")
    top = F.max("distance").over(Window.partitionBy("query"))
    w = F.pow(1 - F.pow(F.least(F.col("distance") / F.greatest(top * 1.0001, F.lit(1e-12)), F.lit(1.0)), 3), 3)
    n = n.withColumn("w", w)
    return n.groupBy(F.col("query").alias("key")).agg((F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("predicted"), (F.pow(F.sum("w"), 2) / F.sum(F.pow("w", 2))).alias("n_eff")).withColumn("confidence", F.col("n_eff") / (F.col("n_eff") + 1)).drop("n_eff")


def vote(known: DataFrame, asked: DataFrame, key: str, field: str, label: str, k: int = 10) -> DataFrame:
    """(key, label): the most frequent label of the k nearest, ties to the lesser."""
    n = neighbours_of(asked, known, key, field, k).join(known.select(F.col(key).alias("key"), F.col(label).alias("label")), "key").groupBy("query", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("n"), "label")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("query").alias("key"), "label")


def local_density(rows: DataFrame, key: str, field: str, k: int = 10) -> DataFrame:
    """(key, lof): mean reachability density of the k neighbours over the row's own."""
    n = neighbours_of(rows, rows, key, field, k)
    kd = n.groupBy("query").agg(F.max("distance").alias("kd"))
    reach = n.join(kd.select(F.col("query").alias("key"), "kd"), "key").withColumn("reach", F.greatest("distance", "kd"))
    lrd = reach.groupBy("query").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-12))).alias("lrd"))
    both = n.join(lrd.select(F.col("query").alias("key"), F.col("lrd").alias("theirs")), "key").groupBy("query").agg(F.avg("theirs").alias("theirs"))
    return both.join(lrd, "query").select(F.col("query").alias("key"), (F.col("theirs") / F.col("lrd")).alias("lof"))


def usual_eps(rows: DataFrame, key: str, field: str, min_points: int = 4) -> float:
    """The distance to the min_points-th nearest other row that three quarters of the rows keep."""
    n = neighbours_of(rows, rows, key, field, min_points)
    d = cut(n.groupBy("query").agg(F.max("distance").alias("d")))
    found = d.orderBy("d").offset(max(0, int(0.75 * (d.count() - 1)))).limit(1).collect()
    return max(found[0]["d"] if found else 0.0, float(np.finfo(float).eps))


def dbscan(rows: DataFrame, key: str, field: str, eps: float | None = None, min_points: int = 4) -> DataFrame:
    """(key, cluster): density clusters over all pairs within eps, named by their least core key; null
    for noise. A border row takes the least cluster it touches. Without eps, usual_eps. The pairs
    are written out: their number is what eps makes it, quadratic in a cluster denser than eps."""
    eps = usual_eps(rows, key, field, min_points) if eps is None else eps
    n = cut(Index(rows, key, field).within(rows, key, field, eps).select("query", "key"))
    core = cut(n.groupBy("query").agg(F.count("*").alias("c")).where(F.col("c") + 1 >= min_points).select("query"))
    e = n.where(F.col("query") < F.col("key")).join(core, "query").join(core.select(F.col("query").alias("key")), "key")
    linked = connected_components(e.select(F.col("query").alias("a"), F.col("key").alias("b")))
    label = core.select(F.col("query").alias("id")).join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    edge = n.join(label, F.col("key") == F.col("id")).groupBy("query").agg(F.min("cluster").alias("edge"))
    all_rows = rows.select(F.col(key).alias("key"))
    return all_rows.join(label, F.col("key") == F.col("id"), "left").join(edge, F.col("key") == F.col("query"), "left").select("key", F.coalesce("cluster", "edge").alias("cluster"))


def eigenmap(edges: DataFrame, k: int, rounds: int = 12, steps: int = 4, seed: int = 1) -> DataFrame:
    """(key, u): the k leading vectors of D^-1/2 W D^-1/2 of a symmetric graph (src, dst, w), rows of
    length 1, by block power iteration: `steps` products with (I + S) / 2 a round, then the block is
    made orthonormal from its k x k Gram matrix, the only thing that reaches the driver."""
    degree = cut(edges.groupBy("src").agg(F.sum("w").alias("g")))
    s = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("g").alias("h")), "dst")
    s = cut(s.select("src", "dst", (F.col("w") / F.sqrt(F.col("g") * F.col("h"))).alias("w")))
    state = cut(degree.select(F.col("src").alias("key"), F.array(*[F.sqrt("g"), *[F.xxhash64("src", F.lit(seed + i)).cast("double") / 2.0**63 for i in range(1, k)]]).alias("u")))
    for _ in range(rounds):
        new = state
        for _ in range(steps):
            to = s.join(new.select(F.col("key").alias("dst"), "u"), "dst").groupBy("src").agg(*[F.sum(F.col("w") * F.get("u", F.lit(i))).alias(f"p{i}") for i in range(k)])
            new = new.join(to, F.col("key") == F.col("src")).select("key", F.array(*[(F.get("u", F.lit(i)) + F.col(f"p{i}")) / 2 for i in range(k)]).alias("u"))
        new = cut(new)
        row = new.agg(*[F.sum(F.get("u", F.lit(i)) * F.get("u", F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        lam, v = np.linalg.eigh(g)
        m = v / np.sqrt(np.maximum(lam, 1e-30 * max(lam.max(), 1e-300)))
        old, state = state, cut(new.select("key", F.array(*[sum((F.get("u", F.lit(i)) * float(m[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k)]).alias("u")))
        dropped(old)
        dropped(new)
    size = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return state.select("key", F.transform("u", lambda x: x / F.greatest(size, F.lit(1e-300))).alias("u"))


def spectral_clusters(rows: DataFrame, key: str, field: str, k: int = 3, neighbours: int = 10, seed: int = 1) -> DataFrame:
    """(key, cluster): k-means of the Laplacian eigenmap of the symmetric k-nearest graph."""
    from .inference import graph

    edges = graph(rows.select(F.col(key).alias("key"), F.col(field).cast("array<double>").alias("x")), neighbours)
    return V.kmeans(eigenmap(edges, k, seed=seed), "key", "u", k, seed)


#: Points of a block of persistence; edges that a forest is drawn over at a time.
BLOCK_POINTS, FOREST_EDGES = 1 << 11, 1 << 20


def _spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, length): a minimal spanning tree of all rows of x, grown from the first."""
    n = len(x)
    best, near, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    out, at = np.zeros(max(0, n - 1), np.int64), 0
    for i in range(n - 1):
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        out[i] = at
    return near[out], out, best[out]


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b, d) of a minimal spanning forest: every tree takes its shortest edge
    out, in rounds; of equal ones the first."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(d, kind="stable")
    u, v = ends[: len(a)][order], ends[len(a) :][order]
    tree, kept, at = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        x, y = tree[u[at]], tree[v[at]]
        out = x != y
        at, x, y = at[out], x[out], y[out]
        if not len(at):
            return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)
        first = np.full(len(nodes), len(at))
        np.minimum.at(first, x, np.arange(len(at)))
        np.minimum.at(first, y, np.arange(len(at)))
        own = np.flatnonzero(first < len(at))
        edge = first[own]
        to = np.arange(len(nodes))
        to[own] = np.where(x[edge] == own, y[edge], x[edge])
        # Two trees that take one edge point at each other: the lesser is the root.
        both = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[both] = np.flatnonzero(both)
        kept.append(at[np.unique(edge)])
        while (to[to] != to).any():
            to = to[to]
        tree = to[tree]


def _forest_of(edges: DataFrame) -> DataFrame:
    """A minimal spanning forest of edges (a, b, d), first of each partition, then of all in one task,
    which holds the edges of one forest and FOREST_EDGES more."""

    def grow(batches):
        held, waiting, n = None, [], 0

        def merged():
            rows = [np.concatenate(c) for c in zip(*([held] if held else []), *waiting)]
            keep = _forest(*rows)
            return tuple(c[keep] for c in rows)

        for batch in batches:
            waiting.append(tuple(batch[c].to_numpy() for c in ("a", "b", "d")))
            n += batch.num_rows
            if n >= max(FOREST_EDGES, len(held[0]) if held else 0):
                held, waiting, n = merged(), [], 0
        if waiting:
            held = merged()
        for s in range(0, len(held[0]) if held else 0, 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 65_536]) for c in held], names=["a", "b", "d"])

    kinds = "a long, b long, d double"
    return cut(cut(edges.mapInArrow(grow, kinds)).coalesce(1).mapInArrow(grow, kinds))


def persistence(df: DataFrame, fields) -> DataFrame:
    """(birth, death): bars of connected components as a ball around each row grows, the lengths of a
    minimal spanning tree, whatever the rows number; rows with a field missing are left out.

    Equal rows are one point and bars of length 0. Points lie in blocks, the leaves of a k-d tree. The
    trees over each block with the next one in order join all points, and no bar is longer than the
    longest edge of the forest of these. Of every other two blocks whose boxes are nearer than that
    edge, the tree over both may have shorter edges across; the bars are the forest of all."""
    names = [f"x{i}" for i in range(len(fields))]
    rows = df.select(*[F.col(f).cast("double").alias(x) for f, x in zip(fields, names)]).where(" and ".join(f"{x} is not null and abs({x}) < double('infinity')" for x in names))
    points = cut(rows.groupBy(*names).agg(F.count("*").alias("times")).select(F.array(*names).alias("v"), "times"))
    alike = points.where("times > 1").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("times") - 1)).alias("i"))
    points = cut(points.select(F.monotonically_increasing_id().alias("key"), "v"))
    n, dim, kinds = points.count(), len(names), "a long, b long, d double"
    cells, _, shape = placed(points, "bigint", dim, n, BLOCK_POINTS)
    blocks = sorted(shape)

    def trees(pairs: list[tuple[int, int]], across: bool, under: float) -> DataFrame:
        def tree(t: pa.Table) -> pa.Table:
            v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
            cell, key = t["cell"].to_numpy(), t["key"].to_numpy()
            a, b, d = _spanning(v)
            ok = (cell[a] != cell[b]) & (d < under) if across else np.ones(len(a), bool)
            return pa.table({"a": key[a[ok]], "b": key[b[ok]], "d": d[ok]})

        own = [(i, c) for i, pair in enumerate(pairs) for c in sorted(set(pair))]
        of = df.sparkSession.createDataFrame(own, "pair int, cell int")
        tasks = min(len(pairs), max(4 * df.sparkSession.sparkContext.defaultParallelism, len(pairs) // 16)) or 1
        met = cells.join(F.broadcast(of), "cell").repartition(tasks, "pair").groupBy("pair").applyInArrow(tree, kinds)
        return met

    bars = _forest_of(trees(list(zip(blocks, blocks[1:])) or [(c, c) for c in blocks], False, math.inf))
    longest = bars.agg(F.max("d")).first()[0]
    low, high = (np.array([shape[c][i] for c in blocks]).reshape(len(blocks), dim) for i in (1, 2))
    more = []
    for i in range(len(blocks) - 2):
        gap = np.maximum(0.0, np.maximum(low[i + 2 :] - high[i], low[i] - high[i + 2 :]))
        more += [(blocks[i], blocks[i + 2 + int(j)]) for j in np.flatnonzero(np.sqrt((gap**2).sum(1)) < longest)]
    if more:
        bars = _forest_of(bars.unionByName(trees(more, True, longest)))
    out = bars.select(F.lit(0.0).alias("birth"), F.col("d").alias("death"))
    return out.unionByName(alike.select(F.lit(0.0).alias("birth"), F.lit(0.0).alias("death"))).orderBy(F.desc("death"))


class _Charts:
    """Charts by their means: n, mean, m2, low and high of each, and which is nearest to a value, the
    first of equally near ones, by a search among the distinct means in order."""

    SPAN = 1_000

    def __init__(self):
        self.n, self.mean, self.m2, self.low, self.high = array("q"), array("d"), array("d"), array("d"), array("d")
        # Distinct means in blocks in order, the last of each block, and the charts of each mean: a heap,
        # with charts that have gone elsewhere since, and how many are there.
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.at: dict[float, list[int]] = {}
        self.live: dict[float, int] = {}

    def _add(self, m: float, i: int) -> None:
        if m in self.live:
            self.live[m] += 1
            heapq.heappush(self.at[m], i)
            return
        self.live[m], self.at[m] = 1, [i]
        b = min(bisect_left(self.tops, m), len(self.tops) - 1)
        if b < 0:
            self.blocks.append([m])
            self.tops.append(m)
            return
        block = self.blocks[b]
        insort(block, m)
        if len(block) > 2 * self.SPAN:
            self.blocks[b : b + 1] = [block[: self.SPAN], block[self.SPAN :]]
            self.tops.insert(b, block[self.SPAN - 1])
            b += 1
        self.tops[b] = self.blocks[b][-1]

    def _remove(self, m: float) -> None:
        self.live[m] -= 1
        if self.live[m]:
            return
        del self.live[m], self.at[m]
        b = bisect_left(self.tops, m)
        block = self.blocks[b]
        del block[bisect_left(block, m)]
        if block:
            self.tops[b] = block[-1]
        else:
            del self.blocks[b], self.tops[b]

    def _least(self, m: float) -> int:
        heap = self.at[m]
        while self.mean[heap[0]] != m:
            heapq.heappop(heap)
        return heap[0]

    def nearest(self, v: float) -> int | None:
        blocks = self.blocks
        if not blocks:
            return None
        b = bisect_left(self.tops, v)
        j = bisect_left(blocks[b], v) if b < len(blocks) else 0
        up = blocks[b][j] if b < len(blocks) else math.inf
        down = blocks[b][j - 1] if j else (self.tops[b - 1] if b else -math.inf)
        d = min(abs(v - up), abs(v - down))
        best = len(self.mean)
        x, y = b, j
        # Differences of several means may round to one.
        while x < len(blocks) and abs(v - blocks[x][y]) == d:
            best = min(best, self._least(blocks[x][y]))
            x, y = (x, y + 1) if y + 1 < len(blocks[x]) else (x + 1, 0)
        x, y = (b, j - 1) if j else (b - 1, len(blocks[b - 1]) - 1 if b else 0)
        while x >= 0 and abs(v - blocks[x][y]) == d:
            best = min(best, self._least(blocks[x][y]))
            x, y = (x, y - 1) if y else (x - 1, len(blocks[x - 1]) - 1 if x else 0)
        return best

    def take(self, v: float, tau: float, reach: float) -> None:
        i = self.nearest(v)
        if i is not None:
            n, mean, m2 = self.n[i], self.mean[i], self.m2[i]
            sd = math.sqrt(m2 / n) if n > 1 else abs(mean) * 0.1 + 1e-9
            d = v - mean
            if abs(d) <= reach * max(sd, 1e-9):
                new, m2 = mean + d / (n + 1), m2 + d * (v - mean - d / (n + 1))
                low, high = min(self.low[i], v), max(self.high[i], v)
                span = high - low
                if span == 0 or m2 / (n + 1) / span**2 <= max(tau, 0.25 if n < 3 else tau) + 1e-9:  # two values have 0.25
                    self.n[i], self.m2[i], self.low[i], self.high[i] = n + 1, m2, low, high
                    if new != mean:
                        self._remove(mean)
                        self.mean[i] = new
                        self._add(new, i)
                    return
        for field, x in ((self.n, 1), (self.mean, v), (self.m2, 0.0), (self.low, v), (self.high, v)):
            field.append(x)
        self._add(v, len(self.n) - 1)


def autochart(df: DataFrame, by: str, order: str, field: str, tau: float = 0.1, reach: float = 2.0) -> DataFrame:
    """(by, chart, n, mean, k): an online walk in order that confirms a value into the nearest chart
    (within `reach` deviations, its curvature staying under tau) or opens a new one. Values at one time
    come in their own order, missing ones are left out. A worker holds the charts of a series, not the
    series, and finds the nearest one by a search in order."""
    kind = df.schema[by].dataType

    def walk(who, batches):
        charts = _Charts()
        for (values,) in batches:
            for v in values[np.isfinite(values)].tolist():
                charts.take(v, tau, reach)
        n, mean, m2, low, high = (np.array(c) for c in (charts.n, charts.mean, charts.m2, charts.low, charts.high))
        k = np.where(high > low, m2 / np.maximum(n, 1) / np.where(high > low, high - low, 1.0) ** 2, 0.0)
        for s in range(0, len(n), 65_536):
            e = min(s + 65_536, len(n))
            yield pa.RecordBatch.from_arrays([pa.array([who] * (e - s), to_arrow_type(kind)), pa.array(np.arange(s, e, dtype=np.int32)), pa.array(n[s:e].astype(np.int32)), pa.array(mean[s:e]), pa.array(k[s:e])], names=[by, "chart", "n", "mean", "k"])

    return in_order(df, by, order, [field], walk, f"`{by}` {kind.simpleString()}, chart int, n int, mean double, k double")


# -- Sampling, forecasts, lattices

def sample(df: DataFrame, fields, n: int, seed: int = 1) -> DataFrame:
    """n records drawn from the diagonal Gaussian fit of the fields."""
    m = G.field_stats(df, fields)
    rows = df.sparkSession.range(n).join(F.broadcast(m), F.lit(True))
    return rows.select("id", *[(F.col(f"m_{f}") + F.col(f"s_{f}") * F.randn(seed + i)).alias(f) for i, f in enumerate(fields)])


def forecast(df: DataFrame, by: str, order: str, field: str, steps: int = 3) -> DataFrame:
    """(by, step, value): the mean-reverting walk of each series, fitted to its own lags."""
    w = Window.partitionBy(by).orderBy(order)
    x = df.select(by, order, F.col(field).cast("double").alias("v"), F.lag(field).over(w).cast("double").alias("p"))
    fit = x.groupBy(by).agg(F.regr_slope("v", "p").alias("a"), F.avg("v").alias("m"), F.max_by("v", order).alias("last"))
    return fit.select(by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "a", "m", "last").select(by, "step", (F.col("m") + F.pow("a", F.col("step").cast("double")) * (F.col("last") - F.col("m"))).alias("value"))


def lattice(spark, nx: int, ny: int, periodic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, x, y), edges (e, src, dst, axis)) of a square lattice."""
    v = spark.range(nx * ny).select(F.col("id").alias("v"), (F.col("id") % nx).alias("x"), F.expr(f"id div {nx}").alias("y"))
    right = v.select(F.col("v").alias("src"), (F.col("y") * nx + (F.col("x") + 1) % nx).alias("dst"), F.lit(0).alias("axis"), (F.col("x") + 1 < nx).alias("inside"))
    up = v.select(F.col("v").alias("src"), ((F.col("y") + 1) % ny * nx + F.col("x")).alias("dst"), F.lit(1).alias("axis"), (F.col("y") + 1 < ny).alias("inside"))
    e = right.unionByName(up).where(F.lit(periodic) | F.col("inside")).drop("inside")
    return v, e.select((F.col("src") * 2 + F.col("axis")).alias("e"), "src", "dst", "axis")


def plaquettes(edges: DataFrame, nx: int, ny: int, angle: str = "theta") -> DataFrame:
    """(v, flux): the sum of a U(1) field's angles around each face of a periodic lattice, and with
    cos(flux) its action, by joins of the face's four edges."""
    e = edges.select("src", "axis", F.col(angle).alias("t"))
    v = e.where("axis = 0").select(F.col("src").alias("v"), F.col("t").alias("a"))
    x, y = F.col("v") % nx, F.expr(f"v div {nx}")
    v = v.withColumn("r", y * nx + (x + 1) % nx).withColumn("u", (y + 1) % ny * nx + x)
    for name, at, axis in (("b", "r", 1), ("c", "u", 0), ("d", "v", 1)):
        v = v.join(e.where(f"axis = {axis}").select(F.col("src").alias(at), F.col("t").alias(name)), at)
    return v.select("v", (F.col("a") + F.col("b") - F.col("c") - F.col("d")).alias("flux"))


def laplacian(vertices: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(v, out): the graph Laplacian of a vertex function, d0 then its adjoint, by two joins."""
    f = vertices.select("v", F.col(value).alias("f"))
    d = edges.join(f.withColumnRenamed("v", "src").withColumnRenamed("f", "fs"), "src").join(f.withColumnRenamed("v", "dst").withColumnRenamed("f", "fd"), "dst")
    both = d.select(F.col("dst").alias("v"), (F.col("fd") - F.col("fs")).alias("x")).unionByName(d.select(F.col("src").alias("v"), (F.col("fs") - F.col("fd")).alias("x")))
    return both.groupBy("v").agg(F.sum("x").alias("out"))


def gibbs(edges: DataFrame, beta: float, chains: int = 4, sweeps: int = 50, seed: int = 1) -> DataFrame:
    """(chain, sweep, mean_spin): Ising heat bath on a small lattice, one chain a task; the lattice
    (checked, at most 100,000 edges) goes to every chain."""
    rows = _rows(edges.select("src", "dst"), 100_000)
    n = 1 + max((max(r["src"], r["dst"]) for r in rows), default=-1)
    nbr: list[list[int]] = [[] for _ in range(n)]
    for r in rows:
        nbr[r["src"]].append(r["dst"])
        nbr[r["dst"]].append(r["src"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chain in pdf.id:
                rng = np.random.default_rng(seed + int(chain))
                s = rng.choice([-1, 1], n)
                out = []
                for sweep in range(sweeps):
                    for i in range(n):
                        h = sum(s[j] for j in nbr[i])
                        s[i] = 1 if rng.random() < 1 / (1 + math.exp(-2 * beta * h)) else -1
                    out.append((int(chain), sweep, float(s.mean())))
                yield pd.DataFrame(out, columns=["chain", "sweep", "mean_spin"])

    return edges.sparkSession.range(0, chains, 1, chains).mapInPandas(run, "chain long, sweep int, mean_spin double")


def hodge_betti(vertices: int, edges: list[tuple[int, int]], faces: list[tuple[int, ...]]) -> tuple[int, int, int]:
    """Betti numbers of a small cell complex from ranks of its boundary maps."""
    d1 = np.zeros((vertices, len(edges)))
    for i, (a, b) in enumerate(edges):
        d1[a, i], d1[b, i] = -1, 1
    at = {e: (i, 1) for i, e in enumerate(edges)} | {(b, a): (i, -1) for i, (a, b) in enumerate(edges)}
    d2 = np.zeros((len(edges), len(faces)))
    for j, face in enumerate(faces):
        for a, b in zip(face, (*face[1:], face[0])):
            i, sign = at[(a, b)]
            d2[i, j] = sign
    r1 = np.linalg.matrix_rank(d1) if len(edges) else 0
    r2 = np.linalg.matrix_rank(d2) if len(faces) else 0
    return vertices - r1, len(edges) - r1 - r2, len(faces) - r2


def diameter(edges: DataFrame, most: int = 3_000) -> DataFrame:
    """(diameter): longest shortest path in hops of a small connected graph of (src, dst)."""
    rows = _rows(edges.select("src", "dst").distinct(), most * 20)
    nodes = sorted({x for r in rows for x in r})
    if len(nodes) > most:
        raise ValueError(f"more than {most} nodes")
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)), bool)
    for r in rows:
        a[at[r[0]], at[r[1]]] = a[at[r[1]], at[r[0]]] = True
    reach, hops = np.eye(len(nodes), dtype=bool), 0
    while not reach.all():
        new = reach | (reach.astype(np.float32) @ a.astype(np.float32) > 0)
        if (new == reach).all():
            return _one(edges.sparkSession, "diameter int", None)
        reach, hops = new, hops + 1
    return _one(edges.sparkSession, "diameter int", hops)


def euler(df: DataFrame, key: str, fields) -> DataFrame:
    """(euler): beta_0 - beta_1."""
    return GR.betti(df, key, fields).select((F.col("beta_0") - F.col("beta_1")).alias("euler"))


def prescribe(rows: DataFrame, key: str, field: str, k: int = 10) -> DataFrame:
    """(dimension, spread): intrinsic dimension by the ratios of neighbour distances, and the
    spread of the k-th distance over its mean; what methods suit follows from them."""
    n = neighbours_of(rows, rows, key, field, k)
    top = n.groupBy("query").agg(F.max("distance").alias("far"), F.avg(F.log(F.greatest("distance", F.lit(1e-12)))).alias("logs"))
    return top.agg((1 / F.avg(F.log(F.greatest("far", F.lit(1e-12))) - F.col("logs"))).alias("dimension"), (F.stddev_pop("far") / F.avg("far")).alias("spread"))


def attend_partition(df: DataFrame, key: str, fields: dict[str, float], ranges: dict[str, float], tau: float) -> DataFrame:
    """(key, weight): Boltzmann weights exp(-d / tau) of an approximate match."""
    d = F.sqrt(sum((F.pow((F.col(f) - v) / ranges[f], 2) for f, v in fields.items()), F.lit(0.0)))
    return df.select(key, F.exp(-d / tau).alias("weight"))


def approximate_neighbours(df: DataFrame, key: str, field: str, query, k: int = 10, bucket: float = 0.5, tables: int = 4) -> DataFrame:
    """(key, distance) by random projections, an index for Euclidean proximity."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    v = df.select(key, array_to_vector(F.col(field).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(v)
    return model.approxNearestNeighbors(v, Vectors.dense(list(query)), k, distCol="distance").select(key, "distance")


def within_ball(df: DataFrame, field: str, centre, radius: float) -> DataFrame:
    """df within a Euclidean ball of the vectors."""
    return df.where(V.squared(F.col(field), V._array(centre)) <= radius**2)
