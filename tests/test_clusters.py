"""Density clusters against a plain version over all pairs."""

import numpy as np
import pyarrow.parquet as pq

from tessera.operators import advanced as X


def brute(x, eps, min_points=4):
    """Labels by the least core row; -1 for noise."""
    near = np.array([np.sqrt(((x - v) ** 2).sum(1)) <= eps for v in x])
    core = near.sum(1) >= min_points
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        low = np.array([min(label[i], label[near[i] & core].min(initial=len(x))) if core[i] else len(x) for i in range(len(x))])
        if (low == label).all():
            break
        label = low
    out = [label[near[i] & core].min(initial=len(x)) for i in range(len(x))]
    return [-1 if c == len(x) else int(c) for c in out]


def found(spark, x, **more):
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["key"]: r["cluster"] for r in X.dbscan(df, "id", "v", **more).collect()}
    return [-1 if got[i] is None else got[i] for i in range(len(x))]


def test_dense_blobs_within_eps_are_one(spark):
    x = np.array([[0.0]] * 60 + [[0.9]] * 60 + [[1.9]] + [[5.0]] * 2)
    assert found(spark, x, eps=1.0) == brute(x, 1.0) == [0] * 121 + [-1] * 2


def test_long_chain_is_one(spark):
    x = np.arange(300.0)[:, None]
    assert found(spark, x, eps=1.0, min_points=3) == [1] * 300


def test_eps_from_the_data(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    ids, x = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)
    d = np.array([np.sort(np.sqrt(((x - v) ** 2).sum(1)))[4] for v in x])
    eps = X.usual_eps(df, "vec_id", "embedding")
    assert eps == np.sort(d)[int(0.75 * (len(x) - 1))]
    got = {r["key"]: r["cluster"] for r in X.dbscan(df, "vec_id", "embedding").collect()}
    want = [None if c < 0 else ids[c] for c in brute(x, eps)]
    assert [got[i] for i in ids] == want and any(c is not None for c in want)
