"""Exact neighbours, numbering, as-of joins and pullbacks against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import advanced as X
from tessera.operators import metric
from tessera.operators import relational as R


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("small", [False, True])
def test_nearest_and_within(spark, monkeypatch, small):
    if small:  # several pivots, parts and blocks
        monkeypatch.setattr(metric, "PART_BYTES", 8 * 5 * 20)
        monkeypatch.setattr(metric, "QUERY_BYTES", 8 * 5 * 7)
    rng = np.random.default_rng(5)
    x = np.vstack((rng.normal(0, 1, (150, 5)), rng.normal(8, 0.1, (80, 5)), np.ones((20, 5))))
    df = table(spark, x)
    index = metric.Index(df, "id", "v")
    assert not small or (len(index.shape) > 1 and max(index.parts.values()) > 1)
    asked = df.where("id % 3 = 0")
    got = sorted((r["query"], r["distance"], r["key"]) for r in index.nearest(asked, "id", "v", 4).collect())
    want, near = [], set()
    for q in range(0, len(x), 3):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want += [(q, d, i) for d, i in sorted((float(d[i]), i) for i in range(len(x)) if i != q)[:4]]
        near |= {(q, i) for i in range(len(x)) if i != q and d[i] <= 0.9}
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in sorted(want)]
    assert np.allclose([d for _, d, _ in got], [d for _, d, _ in sorted(want)])
    assert {(r["query"], r["key"]) for r in index.within(asked, "id", "v", 0.9).collect()} == near
    assert X.neighbours_of(df.limit(0), df, "id", "v", 3).count() == 0
    assert X.neighbours_of(df, df.limit(0), "id", "v", 3).count() == 0


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(metric, "PART_BYTES", 8 * 2 * 10)
    x = np.vstack([np.random.default_rng(1).normal(c * 100, 1, (40, 2)) for c in range(10)])
    df = table(spark, x)
    index = metric.Index(df, "id", "v")
    q = df.select(F.col("id").alias("key"), "v", F.lit(3.0).alias("bound"))
    assert index._visits(q, None).count() < 400 * sum(index.parts.values()) / 2


def test_numbered_rows(spark):
    rows = [(i * 37 % 101, "x" * (i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted((r["i"], r["a"], r["b"]) for r in R.numbered_rows(df, ["a", "b"]).collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows))]
    assert R.numbered_rows(df.limit(0), ["a"]).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", None), (5, "a", 7), (6, None, 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 7, 30.0), ("a", 7, 20.0), ("b", 10, 5.0), ("a", None, 99.0)], "k string, at int, v double")
    got = {r["id"]: r["v"] for r in R.as_of(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: None, 5: 30.0, 6: None}


def test_theta(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 9)], "k int, x int"), spark.createDataFrame([(1, 4), (1, 6), (2, 1)], "k int, y int")
    assert sorted(map(tuple, R.theta(a, b, F.col("x") > F.col("y"), ["k"]).collect())) == [(1, 5, 4), (2, 9, 1)]
    assert R.theta(a, b.drop("k"), F.col("x") < F.col("y")).count() == 1
    with pytest.raises(ValueError):
        R.theta(a, spark.range(5000), F.col("x") < F.col("id"))


def test_pullback_gives_one_row(spark):
    a = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, k int")
    b = spark.createDataFrame([(7, "y"), (7, "x"), (9, "z"), (None, "w")], "k int, v string")
    assert sorted(map(tuple, R.pullback(a, b, "k").collect())) == [(1, 7, "x")]
    assert sorted(map(tuple, R.pullback(a, b, "k", keep_left=True).collect()), key=str) == [(1, 7, "x"), (2, 8, None), (3, None, None)]


def test_iterate_accumulates(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 10.0), (3, 1, 100.0), (9, None, 5.0)], "k int, next int, w double")
    got = sorted(map(tuple, R.iterate(df, "k", "next", 1, accumulate="w").collect()))
    assert got == [(0, 1, 1.0), (1, 2, 11.0), (2, 3, 111.0)]
    assert sorted(map(tuple, R.iterate(df, "k", "next", 2, 1).collect())) == [(0, 2), (1, 3)]


def test_propagate_shows_what_appears_and_goes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5.0), (3, "a", None), (4, "b", None), (5, "b", 1.0), (6, "b", 1.0)], "k int, g string, v double")
    changes = spark.createDataFrame([(3, 7.0), (4, 2.0)], "k int, v double")
    got = {r["key"]: (r["before"], r["after"]) for r in X.propagate(df, "k", "v", "g", changes).collect()}
    assert got == {1: (None, 6.0), 4: (1.0, None)}
