"""M-tree search against all inner products."""

import numpy as np
import pytest

from tessera.llm import mtree


@pytest.mark.parametrize("kind", ["normal", "equal", "clusters", "few"])
def test_tree_equals_brute_force(kind):
    rng = np.random.default_rng(3)
    n = 7 if kind == "few" else 3000
    v = {"equal": np.ones((n, 8), int), "clusters": rng.integers(-60, 60, (10, 8))[rng.integers(0, 10, n)] + rng.integers(-3, 4, (n, 8))}.get(kind, rng.integers(-90, 90, (n, 8)))
    ids = rng.permutation(n) + 5
    tree = mtree.MTree(ids, v, (v**2).sum(1).max())
    queries = ids[:20].tolist()
    want = mtree.brute_force(ids.tolist(), v.tolist(), queries, 5)
    for q in queries:
        got = tree.search(v[ids.tolist().index(q)], 5, q)
        assert [(i, s) for s, i in got] == list(want[want.query_id == q][["vec_id", "score"]].itertuples(index=False, name=None))
    if kind == "clusters":
        assert tree.computed < 20 * n / 2  # most distances are never computed


def test_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 6).tolist(), "x") for i in range(400)]
    rows += [(400, None, "x"), (450, [0.1] * 5 + [None], "x"), (500, [0.1] * 5 + [float("nan")], "x"), (None, [0.1] * 6, "x"), (550, [float("inf")] * 6, "x"), (600, [0.5, 0.5], "x"), (601, [0.5, 0.25], "x"), (650, [], "x"), (0, rows[7][1], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    v = [np.floor(256 * np.array(e)).astype(int).tolist() for _, e, _ in rows[:400]]
    ids = [*range(400), 0]
    v.append(v[7])
    want = []
    for at in [*range(0, 400, 50), 400]:
        scores = sorted((-int(np.dot(v[at], x)), ids[i]) for i, x in enumerate(v) if i != at)[:5]
        want += [(ids[at], r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    want += [(600, 1, 601, 128 * 128 + 128 * 64)]
    for shard, block in ((100, 2), (7, 1000), (16_384, 3)):
        got = mtree.top_inner_products(df, k=5, every=50, shard=shard, block=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert mtree.top_inner_products(df.limit(0)).count() == 0


def test_shards_are_pruned_and_scores_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, (20, 8))
    x = centre[np.arange(600) % 20] + rng.normal(0, 0.01, (600, 8))
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    pairs, searched = [], mtree._searched

    def counted(p, *a):
        pairs.append(p.count())
        return searched(p, *a)

    monkeypatch.setattr(mtree, "_searched", counted)
    for scale in (256.0, 2.0**28):
        got = mtree.top_inner_products(df, k=3, every=60, scale=scale, shard=20).collect()
        v = np.floor(scale * x).astype(np.int64).astype(object)
        want = []
        for q in range(0, 600, 60):
            near = sorted((-int((v[i] * v[q]).sum()), i) for i in range(600) if i != q)[:3]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert pairs[0] == 10 and pairs[1] < 10 * 30 / 2


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mtree.top_inner_products(df, k=3).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 3, 65536), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 2, 65536)]
