"""Graphs: shared-value adjacency by counts, components, paths, spectra, flows, completion.

Two records are adjacent if they share the value of an indexed field. The cliques are never built:
degrees and edges follow from the sizes of groups by inclusion and exclusion over the subsets of
the fields, and spectra from the distinct tuples with their multiplicities."""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut, dropped

#: Most distinct tuples whose matrix the driver will solve.
MOST_TUPLES = 2_000


def _subsets(fields):
    return [s for n in range(1, len(fields) + 1) for s in combinations(fields, n)]


def degrees(df: DataFrame, key: str, fields) -> DataFrame:
    """(key, degree): of each record, how many others share one of the fields' values."""
    t = base = df.groupBy(*fields).agg(F.count("*").alias("__m"))
    total = F.lit(0)
    for s in _subsets(fields):
        t = t.join(base.groupBy(*s).agg(F.sum("__m").alias("__n")), list(s)).withColumn("__d_" + "_".join(s), F.col("__n") - 1).drop("__n")
        total = total + (1 if len(s) % 2 else -1) * F.col("__d_" + "_".join(s))
    t = t.select(*fields, total.alias("degree"))
    return df.select(key, *fields).join(t, list(fields)).select(key, "degree")


def edge_count(df: DataFrame, fields) -> DataFrame:
    """(edges): adjacent pairs, from pair counts of groups."""
    t = df.groupBy(*fields).agg(F.count("*").alias("__m"))
    out = None
    for s in _subsets(fields):
        sign = 1 if len(s) % 2 else -1
        one = t.groupBy(*s).agg(F.sum("__m").alias("n")).agg((sign * F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long"))).alias("e"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.sum("e").alias("edges"))


def components(df: DataFrame, fields, rounds: int = 50) -> DataFrame:
    """(fields, component): distinct tuples with the least tuple hash reachable over shared values;
    labels pass through values, so that a hub is a group and not its pairs."""
    t = cut(df.select(*fields).distinct().withColumn("component", F.xxhash64(*fields)))
    for _ in range(rounds):
        new = t
        for f in fields:
            new = new.join(new.groupBy(f).agg(F.min("component").alias("__c")), f).withColumn("component", F.least("component", "__c")).drop("__c")
        new = cut(new)
        if not new.join(t.withColumnRenamed("component", "__old"), list(fields)).where("component <> __old").limit(1).count():
            return new
        t = new
    raise RuntimeError("components did not settle")


def betti(df: DataFrame, key: str, fields) -> DataFrame:
    """(beta_0, beta_1): components, and edges - vertices + components."""
    b0 = components(df, fields).agg(F.countDistinct("component").alias("beta_0"))
    e, v = edge_count(df, fields), df.agg(F.count(key).alias("v"))
    return b0.join(F.broadcast(e), F.lit(True)).join(F.broadcast(v), F.lit(True)).select("beta_0", (F.col("edges") - F.col("v") + F.col("beta_0")).alias("beta_1"))


def neighbours(df: DataFrame, key: str, value, fields) -> DataFrame:
    """Keys of the records that share a value with one record."""
    own = df.where(F.col(key) == F.lit(value)).limit(1)
    out = None
    for f in fields:
        one = df.join(F.broadcast(own.select(f)), f, "left_semi").where(F.col(key) != F.lit(value)).select(key)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def spectral_gap(df: DataFrame, fields) -> DataFrame:
    """(gap, status): second eigenvalue of the normalised Laplacian of the shared-value graph, null
    where it is edgeless or disconnected. Records with one tuple are alike, so a matrix over the
    distinct tuples with their multiplicities has the spectrum that matters; beyond MOST_TUPLES of
    them the answer is null, with a status that says so."""
    spark = df.sparkSession
    kind = "gap double, status string"
    t = df.groupBy(*fields).agg(F.count("*").alias("__m"))
    rows = t.limit(MOST_TUPLES + 1).collect()
    if len(rows) > MOST_TUPLES:
        return spark.createDataFrame([(None, "too many distinct tuples")], kind)
    rows = [r for r in rows if any(r[f] is not None for f in fields)]
    v = [tuple(r[f] for f in fields) for r in rows]
    m = np.array([r["__m"] for r in rows], float)
    a = np.zeros((len(v), len(v)))
    for k in range(len(fields)):
        # Dense codes; a null is shared with nobody.
        codes = {}
        x = np.array([-1 if r[k] is None else codes.setdefault(r[k], len(codes)) for r in v])
        a[(x[:, None] == x[None, :]) & (x[:, None] >= 0)] = 1
    degree = a @ m - 1
    if not len(v) or degree.max(initial=0) == 0:
        return spark.createDataFrame([(None, "edgeless")], kind)
    s = np.sqrt(m / np.maximum(degree, 1e-300))
    n = a * s[:, None] * s[None, :] - np.diag(1 / np.maximum(degree, 1e-300))
    lam = np.sort(1 - np.linalg.eigvalsh(n))
    gap = float(lam[1]) if len(lam) > 1 else 1.0 + 1.0 / float(degree.max())
    return spark.createDataFrame([(None, "disconnected") if gap < 1e-9 else (gap, "measured")], kind)


def shortest(edges: DataFrame, start) -> DataFrame:
    """(node, distance, before): least weight sums from `start` over (src, dst, w), and the node
    before on such a path (the least; null for the start), by frontier joins until nothing falls,
    however many that takes; a cycle of negative weight is refused."""
    kind = dict(edges.dtypes)["src"]
    best = front = cut(edges.sparkSession.createDataFrame([(start, 0.0, None)], f"node {kind}, distance double, before {kind}"))
    for n in count(1):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("src").alias("b"))).alias("s"))
        seen = best.select(F.col("node").alias("dst"), F.col("distance").alias("old"))
        front = cut(step.join(seen, "dst", "left").where("old is null or s.d < old - 1e-12").select(F.col("dst").alias("node"), F.col("s.d").alias("distance"), F.col("s.b").alias("before")))
        if front.isEmpty():
            break
        old, best = best, cut(best.join(front.select("node"), "node", "left_anti").unionByName(front))
        dropped(old)
        # A distance that falls in round n has a path of n edges, whose n + 1 nodes differ.
        if n >= 32 and n & (n - 1) == 0 and best.count() <= n:
            raise ValueError("a cycle of negative weight")
    return best


def path(edges: DataFrame, start, end) -> DataFrame:
    """(step, node, distance) from start to end along a shortest path; no rows if there is none."""
    tree = cut(shortest(edges, start))
    back = tree.where(F.col("node") == F.lit(end))
    rows = []
    while (r := back.first()) is not None:
        rows.append((r["node"], r["distance"]))
        if r["before"] is None:
            break
        back = tree.where(F.col("node") == F.lit(r["before"]))
    rows = [(i, *r) for i, r in enumerate(reversed(rows))]
    return edges.sparkSession.createDataFrame(rows, f"step int, node {dict(edges.dtypes)['src']}, distance double")


def net_flow(edges: DataFrame) -> DataFrame:
    """(a, b, net) for a < b: the flow from a to b less that from b to a."""
    signed = F.when(F.col("src") < F.col("dst"), F.col("w")).otherwise(-F.col("w"))
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(signed).alias("net"))


def potential(net: DataFrame, rounds: int = 500, tolerance: float = 1e-12) -> DataFrame:
    """(node, phi): the least-squares potential of a net flow (a, b, net), by conjugate gradients on
    the graph's Laplacian. Vectors stay in tables with one number a node; a round is one join with
    the edges and one aggregation, so neither edges nor nodes have to fit anywhere."""
    e = cut(net.select("a", "b", "net"))
    ends = e.select(F.col("a").alias("node"), (-F.col("net")).alias("d")).union(e.select(F.col("b"), F.col("net")))
    state = cut(ends.groupBy("node").agg(F.sum("d").alias("r")).select("node", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    rr = first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if rr <= tolerance * first:
            return state.select("node", F.col("x").alias("phi"))
        pa, pb = state.select(F.col("node").alias("a"), F.col("p").alias("pa")), state.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        diff = e.join(pa, "a").join(pb, "b").select("a", "b", (F.col("pb") - F.col("pa")).alias("d"))
        ap = diff.select(F.col("a").alias("node"), (-F.col("d")).alias("d")).union(diff.select("b", "d")).groupBy("node").agg(F.sum("d").alias("ap"))
        held = cut(state.join(ap, "node"))
        pap = held.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not pap:
            return state.select("node", F.col("x").alias("phi"))
        alpha = rr / pap
        held2 = held.select("node", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = held2.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        old, state = state, cut(held2.withColumn("p", F.col("r") + new / rr * F.col("p")))
        rr = new
        dropped(old)
        dropped(held)
    raise RuntimeError(f"the potential did not settle in {rounds} rounds")


def circulation(edges: DataFrame) -> DataFrame:
    """(nodes, ratio): the share of squared net flow that no potential explains, over all edges."""
    net = cut(net_flow(edges))
    phi = cut(potential(net))
    both = net.join(phi.select(F.col("node").alias("a"), F.col("phi").alias("pa")), "a").join(phi.select(F.col("node").alias("b"), F.col("phi").alias("pb")), "b")
    rest = F.col("net") - (F.col("pb") - F.col("pa"))
    ratio = both.agg((F.sum(rest * rest) / F.greatest(F.sum(F.col("net") * F.col("net")), F.lit(1e-300))).alias("ratio"))
    return phi.agg(F.count("*").alias("nodes")).join(F.broadcast(ratio), F.lit(True))


def cyclic_edges(edges: DataFrame, top: int = 10) -> DataFrame:
    """(a, b, net, cyclic): the edges whose flow the potential explains least."""
    net = cut(net_flow(edges))
    phi = cut(potential(net))
    both = net.join(phi.select(F.col("node").alias("a"), F.col("phi").alias("pa")), "a").join(phi.select(F.col("node").alias("b"), F.col("phi").alias("pb")), "b")
    return both.select("a", "b", "net", (F.col("net") - (F.col("pb") - F.col("pa"))).alias("cyclic")).orderBy(F.desc(F.abs("cyclic")), "a", "b").limit(top)


def completed(df: DataFrame, key: str, field: str, by: str) -> DataFrame:
    """(key, predicted, confidence): missing values from the neighbours that share `by`, at equal
    weights, outliers (modified z over 3) left out; confidence n / (n + 1); two neighbours needed."""
    from .anomaly import group_median

    known = df.where(F.col(field).isNotNull() & F.col(by).isNotNull())
    dev = known.join(group_median(known, by, field).drop("n"), by).withColumn("dev", F.abs(F.col(field) - F.col("med")))
    mad = group_median(dev, by, "dev", "mad").drop("n")
    good = dev.join(mad, by).where("mad = 0 and dev = 0 or mad > 0 and 0.6745 * dev / mad <= 3")
    mean = good.groupBy(by).agg(F.avg(field).alias("predicted"), F.count("*").alias("n")).where("n >= 2")
    return df.where(F.col(field).isNull()).join(mean, by).select(F.col(key).alias("key"), "predicted", (F.col("n") / (F.col("n") + 1)).alias("confidence"))


def spectrum(df: DataFrame, fields) -> DataFrame:
    """(i, value, multiplicity): the whole spectrum of the normalised Laplacian of the shared-value
    graph, from the distinct tuples: their quotient's values, and 1 + 1/degree for the alike
    records of a tuple, once less than they are. Beyond MOST_TUPLES tuples it is refused."""
    rows = [r for r in df.groupBy(*fields).agg(F.count("*").alias("__m")).limit(MOST_TUPLES + 1).collect() if any(r[f] is not None for f in fields)]
    if len(rows) > MOST_TUPLES:
        raise ValueError("too many distinct tuples")
    m = np.array([r["__m"] for r in rows], float)
    a = np.zeros((len(rows), len(rows)))
    for f in fields:
        codes: dict = {}
        x = np.array([-1 if r[f] is None else codes.setdefault(r[f], len(codes)) for r in rows])
        a[(x[:, None] == x[None, :]) & (x[:, None] >= 0)] = 1
    degree = a @ m - 1
    keep = degree > 0
    a, m, degree = a[keep][:, keep], m[keep], degree[keep]
    s = np.sqrt(m / degree)
    values = [(float(v), 1) for v in 1 - np.linalg.eigvalsh(a * s[:, None] * s[None, :] - np.diag(1 / degree))] if len(m) else []
    values += [(1 + 1 / float(d), int(n) - 1) for d, n in zip(degree, m) if n > 1]
    values = sorted((round(v, 12) + 0.0, n) for v, n in values)
    return df.sparkSession.createDataFrame([(i, v, n) for i, (v, n) in enumerate(values)], "i int, value double, multiplicity int")


def mixing(df: DataFrame, fields) -> DataFrame:
    """(gap, mixing, cheeger_low, cheeger_high): 1 / gap and the bounds gap / 2 and sqrt(2 gap) of
    the bottleneck (Cheeger's inequality); null where there is no gap."""
    g = spectral_gap(df, fields).select("gap")
    return g.select("gap", (1 / F.col("gap")).alias("mixing"), (F.col("gap") / 2).alias("cheeger_low"), F.sqrt(2 * F.col("gap")).alias("cheeger_high"))


def conductance(df: DataFrame, fields, inside) -> DataFrame:
    """(cut, volume, conductance) of the records that meet the condition `inside`: edges to the
    others over the lesser sum of degrees, from group sizes by inclusion and exclusion."""
    t = df.withColumn("__in", inside)
    base = t.groupBy(*fields).agg(F.sum(F.when(F.col("__in"), 1).otherwise(0)).alias("__a"), F.sum(F.when(F.col("__in"), 0).otherwise(1)).alias("__b"))
    sums = None
    for s in _subsets(fields):
        sign = 1 if len(s) % 2 else -1
        g = base.where(" and ".join(f"`{c}` is not null" for c in s)).groupBy(*s).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
        one = g.agg((sign * F.sum(F.col("a") * F.col("b"))).alias("c"), (sign * F.sum(F.col("a") * (F.col("a") - 1))).alias("x"), (sign * F.sum(F.col("b") * (F.col("b") - 1))).alias("y"))
        sums = one if sums is None else sums.unionByName(one)
    total = sums.agg(F.sum("c").alias("cut"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    volume = F.least(F.col("x") + F.col("cut"), F.col("y") + F.col("cut"))
    return total.select("cut", volume.alias("volume"), F.when(volume > 0, F.col("cut") / volume).alias("conductance"))


def ricci(points: DataFrame, key: str, fields, a, b, most: int = 2_000) -> DataFrame:
    """(distance, w1, curvature) between two records: 1 - W1 / distance, W1 the greedy transport of
    the neighbourhoods (the record itself and the records no farther than the two are apart) at
    equal weights; at most `most` rows in either, more are refused."""
    x = F.array(*[F.col(f).cast("double") for f in fields])
    rows = points.select(F.col(key).alias("k"), x.alias("x"))
    ends = {r["k"]: np.array(r["x"]) for r in rows.where(F.col("k").isin(a, b)).collect()}
    d = float(np.linalg.norm(ends[a] - ends[b]))
    kind = "distance double, w1 double, curvature double"
    if d < 1e-12:
        return points.sparkSession.createDataFrame([(0.0, 0.0, 1.0)], kind)

    def around(c):
        at = F.array(*[F.lit(float(v)) for v in c])
        far = F.sqrt(F.aggregate(F.zip_with("x", at, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        got = rows.where(far <= d).orderBy("k").limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} rows in a neighbourhood")
        return np.array([r["x"] for r in got])

    p, q = around(ends[a]), around(ends[b])
    cost = np.linalg.norm(p[:, None] - q[None], axis=2)
    left, right, w1 = np.full(len(p), 1 / len(p)), np.full(len(q), 1 / len(q)), 0.0
    for i, j in zip(*np.unravel_index(np.argsort(cost, axis=None, kind="stable"), cost.shape)):
        moved = min(left[i], right[j])
        if moved > 0:
            w1 += moved * cost[i, j]
            left[i] -= moved
            right[j] -= moved
    return points.sparkSession.createDataFrame([(d, float(w1), float(1 - w1 / d))], kind)
