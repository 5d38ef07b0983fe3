"""Whole jobs over tables that were too large for a step: blocks, ties and copies against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import advanced as X
from tessera.operators import geometry as G
from tessera.operators import inference as I
from tessera.operators import kernels as K
from tessera.operators import metric
from tessera.operators import series as S


def table(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{key} long, v array<double>")


def test_leaves_stay_small_and_exact(spark, monkeypatch):
    """F1, F5, F8: cells of two dimensions hold no more rows as the table grows; copies are one point."""
    monkeypatch.setattr(metric, "LEAF_ROWS", 256, raising=False)
    rng = np.random.default_rng(3)
    x = np.vstack((rng.integers(0, 60, (3000, 2)), np.zeros((300, 2)), rng.normal(200, 5, (1500, 2)), rng.normal(0, 900, (40, 2)))).astype(float)
    df = table(spark, x)
    index = metric.Index(df, "id", "v")
    distinct = len(np.unique(x, axis=0))
    assert index.cells.count() == distinct and sum(n for n, *_ in index.shape.values()) == distinct
    assert max(n for n, *_ in index.shape.values()) <= 1024 and len(index.shape) > 4
    got: dict = {}
    for r in index.nearest(df.where("id % 41 = 0"), "id", "v", 7).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["key"]))
    for q in range(0, len(x), 41):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [k for _, k in sorted(got[q])] == [i for _, i in sorted((d[i], i) for i in range(len(x)) if i != q)[:7]]


def test_many_dimensions_visit_a_part_once(spark):
    """F9 to F17: where no cell can be left out, a query is not sent to one cell after another."""
    df = table(spark, np.random.default_rng(4).normal(size=(3000, 32)))
    index = metric.Index(df, "id", "v")
    q = df.select(F.col("id").alias("key"), "v", F.lit(None).cast("double").alias("bound"))
    assert index._visits(q, None).count() == 3000


def test_shared_fits_are_those_of_each_row(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (900, 2)).astype(float)
    y = x @ [2.0, -1.0] + rng.normal(0, 0.1, 900)
    known = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(800)], "key long, x array<double>, y double")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(800, 900)], "key long, x array<double>")
    got = {r["key"]: (r["mean"], r["scale"]) for r in I.local_linear(known, asked).collect()}
    for i in range(800, 900):
        d = np.sqrt(((x[:800] - x[i]) ** 2).sum(1))
        near = np.lexsort((np.arange(800), d))[:20]
        assert got[i] == pytest.approx(I.local_fit(x[i], d[near], x[near], y[near], 0.5))
    known_too = I.local_linear(known, known.select("key", "x").where("key < 5")).collect()
    assert len(known_too) == 5 and all(abs(r["mean"] - y[r["key"]]) < 3 for r in known_too)


def plain_charts(values, tau=0.1, reach=2.0):
    charts = []
    for v in values:
        best = min(range(len(charts)), key=lambda i: abs(v - charts[i][1]), default=None)
        if best is not None:
            n, mean, m2, low, high = charts[best]
            sd = math.sqrt(m2 / n) if n > 1 else abs(mean) * 0.1 + 1e-9
            if abs(v - mean) <= reach * max(sd, 1e-9):
                d = v - mean
                new = [n + 1, mean + d / (n + 1), m2 + d * (v - mean - d / (n + 1)), min(low, v), max(high, v)]
                span = new[4] - new[3]
                if span == 0 or new[2] / new[0] / span**2 <= max(tau, 0.25 if n < 3 else tau) + 1e-9:
                    charts[best] = new
                    continue
        charts.append([1, v, 0.0, v, v])
    return [(c[0], c[1]) for c in charts]


@pytest.mark.parametrize("span", [2, 1000])
def test_nearest_charts_are_found_in_order(monkeypatch, span):
    """the same charts as a walk over all of them, ties included."""
    monkeypatch.setattr(X._Charts, "SPAN", span)
    rng = np.random.default_rng(6)
    for values in (np.round(rng.exponential(50, 1500), 1), rng.integers(-4, 5, 900).astype(float), 1e15 + rng.integers(0, 50, 600), rng.normal(size=800)):
        charts = X._Charts()
        for v in values.tolist():
            charts.take(v, 0.1, 2.0)
        assert list(zip(charts.n, charts.mean)) == plain_charts(values.tolist())


def test_autochart_of_a_long_series(spark):
    """a walk whose charts number a third of 60,000 values."""
    v = np.random.default_rng(7).normal(0, 1000, 60_000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [(None, 1, 5.0), (None, 2, None)], "g string, t int, x double")
    got = {r["g"]: (r["n"], r["c"]) for r in X.autochart(df, "g", "t", "x").groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
    assert got["a"][0] == 60_000 and got["a"][1] > 10_000 and got[None] == (1, 1)


@pytest.mark.parametrize("size", [64, 100_000])
def test_persistence_of_many_rows(spark, monkeypatch, size):
    """more than 2,000 rows, copies among them, over blocks and in one."""
    monkeypatch.setattr(X, "BLOCK_POINTS", size, raising=False)
    rng = np.random.default_rng(8)
    x = np.vstack((rng.normal(0, 1, (900, 2)), rng.normal(40, 3, (900, 2)), rng.integers(0, 9, (400, 2)), [[500.0, 500.0]]))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double")
    left, best, at, want = np.ones(len(x), bool), np.full(len(x), np.inf), 0, []
    for _ in range(len(x) - 1):
        left[at] = False
        best = np.minimum(best, np.sqrt(((x - x[at]) ** 2).sum(1)))
        at = int(np.where(left, best, np.inf).argmin())
        want.append(best[at])
    got = [r["death"] for r in X.persistence(df, ["a", "b"]).collect()]
    assert np.allclose(got, sorted(want, reverse=True))
    assert X.persistence(df.limit(0), ["a", "b"]).count() == 0 and X.persistence(df.limit(1), ["a", "b"]).count() == 0


def test_wasserstein_in_ranges(spark):
    """no window over all rows in one partition; values that repeat, unequal sizes."""
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0, 3, 700), 1), np.round(rng.exponential(4, 1100), 1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 1.0), ("a", None)], "g string, v double")
    out = G.wasserstein(df, "g", "a", "b", "v")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Window")[-1]
    q = np.unique(np.concatenate((np.arange(1, 701) / 700, np.arange(1, 1101) / 1100)))
    a.sort(), b.sort()
    va, vb = a[np.minimum(np.ceil(q * 700 - 1e-9).astype(int) - 1, 699)], b[np.minimum(np.ceil(q * 1100 - 1e-9).astype(int) - 1, 1099)]
    assert out.first()[0] == pytest.approx(math.sqrt((np.diff(q, prepend=0) * (va - vb) ** 2).sum()))
    assert G.wasserstein(df, "g", "a", "none", "v").first()[0] is None


def test_kappa_rank_rounds_as_sql(spark, tmp_path):
    """doubles whose decimal digits and scaled value round apart."""
    import duckdb

    from tessera.plans import catalog

    rng = np.random.default_rng(10)
    prices = (5_000_000_000 + rng.integers(-400_000, 400_000, 3000) * 2 + 1) / 2e10
    rows = [(i, 0, float(p)) for i, p in enumerate(prices)] + [(3000, 0, 0.0), (3001, 1, 1.0)]
    middle = float(np.mean([r[2] for r in rows]))
    df = spark.createDataFrame([(i, c, float(v - middle + 0.5)) for i, c, v in rows], "o_orderkey long, o_custkey long, o_totalprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    with duckdb.connect() as c:
        c.execute("set threads = 1")
        c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        want = sorted(c.execute(catalog.oracle_sql()["kappa_rank"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["kappa_rank"](spark, str(tmp_path)).collect())) == want


def test_completed_near_sums_pairs(spark, monkeypatch):
    """a row for each value of a neighbourhood reaches the shuffle, not one for each pair."""
    rng = np.random.default_rng(11)
    x = np.vstack((rng.normal(0, 0.2, (400, 3)), np.repeat(rng.normal(0, 0.2, (5, 3)), 30, 0)))
    y = rng.integers(0, 3, len(x)).astype(float)
    rows = [(i, x[i].tolist(), None if i % 5 == 0 else float(y[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "k long, v array<double>, y double")
    values = df.where("y is not null").select(F.col("k").alias("key"), "y")
    sums = metric.Index(df.where("y is not null"), "k", "v").sums_within(df.where("y is null"), "k", "v", 0.5, values)
    assert sums.count() <= 3 * 110 * 2
    got = {r["key"]: (r["predicted"], r["confidence"]) for r in K.completed_near(df, "k", "y", "v", 0.5).collect()}
    known = np.array([i for i in range(len(x)) if i % 5])
    for i in range(0, len(x), 5):
        d = np.sqrt(((x[known] - x[i]) ** 2).sum(1))
        near, w = y[known[d < 0.5]], 1 - d[d < 0.5] / 0.5
        dev = np.abs(near - np.median(near))
        mad = np.median(dev)
        ok = dev == 0 if mad == 0 else 0.6745 * dev / mad <= 3
        e = w[ok].sum() ** 2 / (w[ok] ** 2).sum()
        assert got[i] == pytest.approx(((w[ok] * near[ok]).sum() / w[ok].sum(), e / (e + 1)))


def test_rotations_in_pieces():
    """the area of each shift by pieces of the path is that of the shifted increments."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=400).cumsum(), rng.normal(size=400).cumsum()
    dx, dy = np.diff(x), np.diff(y)

    def area(dy):
        px, py = np.concatenate(([0], dx.cumsum()[:-1])), np.concatenate(([0], dy.cumsum()[:-1]))
        return abs((px * dy - py * dx).sum())

    shifts = np.random.default_rng(1).integers(1, len(dy), 199)
    want = (1 + sum(area(np.roll(dy, int(k))) >= area(dy) for k in shifts)) / 200
    assert S.rotations(x, y) == S.rotations(x, y, step=7) == want
