"""Smaller kernels, points, the result cache and conversions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import language, points
from tessera.operators import advanced as X
from tessera.operators import kernels as K
from tessera.operators import patterns as PT
from tessera.operators import sealing as SE
from tessera.operators import vectors as V
from tessera.sources import convert


def test_base_geometry(spark):
    def mode(keys):
        return K.base_geometry(spark.createDataFrame([(k,) for k in keys], "k long"), "k").first()

    assert tuple(mode(range(5, 500, 5))) == ("flat", 5, 5, 1.0) and mode([*range(100), 205])["mode"] == "nearly flat"
    assert mode([1, 2, 9, 30])["mode"] == "curved" and mode([3])["mode"] == "curved"


def test_commuting(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 5, 1.0) for i in range(5)], "src int, dst int, w double")
    twice = spark.createDataFrame([(i, (i + 2) % 5, 3.0) for i in range(5)], "src int, dst int, w double")
    one = spark.createDataFrame([(0, 1, 2.0)], "src int, dst int, w double")
    assert K.commuting(ring, twice).first()["commute"] and tuple(K.commuting(ring, one).first()) == (False, 2.0)


def test_updates(spark):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "state string, p double")
    l1, l2 = (spark.createDataFrame(v, "state string, l double") for v in ([("a", 0.9), ("b", 0.1)], [("a", 0.2), ("b", 0.8)]))
    swap = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "state string, to string, q double")
    assert K.update_commutator(p, lambda x: K.reweighted(x, l1), lambda x: K.reweighted(x, l2)).first()["tv"] == pytest.approx(0, abs=1e-12)
    got = K.update_commutator(p, lambda x: K.reweighted(x, l1), lambda x: K.moved(x, swap)).first()
    assert got["tv"] == pytest.approx(0.8) and got["regime"] == "borderline"


def test_dreams_follow_the_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) @ [[1, 0.8], [0, 0.5]] + [3, -1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r["v"] for r in K.dreams(df, "v", 600, 60, 0.1).collect()])
    assert np.allclose(got.mean(0), x.mean(0), atol=0.2) and np.allclose(np.cov(got.T), np.cov(x.T) / 0.95, atol=0.3)
    assert np.allclose([r["v"] for r in K.dreams(df, "v", 3, 5, temperature=0.0).collect()], x.mean(0))
    back = np.array([r["v"] for r in K.reconstructed(df, "id", "v", 2).orderBy("id").collect()])
    assert np.allclose(back, x)
    mean, v, _ = V.axes(df, "v", 1)
    assert np.allclose([r["v"] for r in K.reconstructed(df, "id", "v", 1).orderBy("id").collect()], mean + (x - mean) @ v.T @ v)


def quaternion(p, q):
    a, b = (np.array([[x[0] + 1j * x[1], x[2] + 1j * x[3]], [-x[2] + 1j * x[3], x[0] - 1j * x[1]]]) for x in (p, q))
    return a @ b


def test_su2(spark):
    v, e = X.lattice(spark, 3, 3)
    field = K.haar(e, 2)
    u = {(r["src"], r["axis"]): r["u"] for r in field.collect()}
    assert np.allclose([np.linalg.norm(q) for q in u.values()], 1)
    eye = [1, 0, 0, 0]
    m = {k: quaternion(q, eye) for k, q in u.items()}
    got = {r["v"]: r["trace"] for r in K.plaquettes_su2(field, 3, 3).collect()}
    for s in range(9):
        right, up = s // 3 * 3 + (s + 1) % 3, (s + 3) % 9
        loop = m[(s, 0)] @ m[(right, 1)] @ np.linalg.inv(m[(up, 0)]) @ np.linalg.inv(m[(s, 1)])
        assert got[s] == pytest.approx(np.trace(loop).real / 2)
        assert K.loop_transport(field, [s, right, (right + 3) % 9, up]).first()["angle"] == pytest.approx(2 * math.acos(max(-1, min(1, got[s]))), abs=1e-6)
    g = K.haar(v.select(F.col("v").alias("e"), "v"), 7).select("v", F.col("u").alias("g"))
    again = {r["v"]: r["trace"] for r in K.plaquettes_su2(K.gauged(field, g), 3, 3).collect()}
    assert all(again[s] == pytest.approx(got[s]) for s in got)
    with pytest.raises(ValueError):
        K.loop_transport(field, [0, 4])


def test_haar_is_even(spark):
    edges = spark.range(20_000).select(F.col("id").alias("e"))
    u = np.array([r["u"] for r in K.haar(edges, 1).collect()])
    assert np.allclose(np.linalg.norm(u, axis=1), 1) and np.allclose(u.mean(0), 0, atol=0.02) and np.allclose(u.T @ u / len(u), np.eye(4) / 4, atol=0.01)


def test_completion_over_a_metric(spark):
    rows = [(1, [0.0], None), (2, [0.5], 4.0), (3, [0.2], 6.0), (4, [0.9], 5.0), (5, [3.0], 100.0), (6, [9.0], None), (7, [0.4], 900.0), (8, [0.6], 5.0)]
    df = spark.createDataFrame(rows, "k int, v array<double>, y double")
    got = {r["key"]: (r["predicted"], r["confidence"]) for r in K.completed_near(df, "k", "y", "v", 1.0).collect()}
    w, y = np.array([0.5, 0.8, 0.1, 0.4]), np.array([4.0, 6.0, 5.0, 5.0])
    n = w.sum() ** 2 / (w**2).sum()
    assert got == {1: pytest.approx(((w * y).sum() / w.sum(), n / (n + 1)))}


def test_explanations(spark):
    df = spark.createDataFrame([(1, 3.0, "x"), (2, 12.0, "x"), (3, 50.0, "x"), (4, 1.0, "y")], "k int, v double, s string")
    p = PT.Pattern("p", ("v < 10", "s = 'x'"), "greatest(10 - v, 0) / 2")
    tree = [tuple(r) for r in PT.explained(df, p, "k", 1).collect()]
    assert tree[0][0] == 0 and tree[0][2] == 3.5 and max(d for d, _, _ in tree) >= 2 and any(e == "v" and x == 3.0 for _, e, x in tree)
    menu = {r["conjunct"]: (r["gained"], r["cost"]) for r in PT.menu(df, p).collect()}
    assert menu == {"v < 10": (2, pytest.approx(2 / 49)), "s = 'x'": (1, None)}


def test_secrets():
    shares = SE.split(b"a secret of some length", 5, 3)
    assert SE.joined(shares[1:4]) == SE.joined([shares[0], shares[4], shares[2]]) == b"a secret of some length"
    with pytest.raises(ValueError):
        SE.joined(shares[:2])
    with pytest.raises(ValueError):
        SE.split(b"x", 2, 3)
    a, b = SE.ratchet(b"key")
    assert a != b and SE.ratchet(a) != (a, b)


def test_noisy_fields(spark):
    df = spark.range(20_000).select((F.col("id") % 100).cast("double").alias("v")).select("v", SE.probabilistic("v", -2.0, 5.0, 3.0).alias("w"))
    r = SE.probabilistic_recovered("w", -2.0, 5.0, 3.0)
    assert set(r) == {"count", "sum", "avg", "variance"} and "median" in SE.probabilistic_recovered("w", -2.0, 5.0, 0.0)
    got = df.agg(r["avg"].alias("m"), r["variance"].alias("v")).first()
    assert got["m"] == pytest.approx(49.5, abs=0.1) and got["v"] == pytest.approx(833.25, rel=0.02)


def test_points_and_cache(spark):
    s = language.Session(spark).add("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    p, clock = points.Points(s, "t"), [0.0]
    cache = points.ResultCache(s, 2, 60.0, clock=lambda: clock[0])
    assert [r["k"] for r in cache.rows_of("COVER t ALL RANK BY k")] == [1, 2] and cache.hits == 0
    assert len(cache.rows_of("COVER t  ALL RANK BY k")) == 2 and cache.hits == 1
    p.upsert([{"k": 3, "v": "c"}, {"k": 1, "v": "z"}])
    assert [r["v"] for r in cache.rows_of("COVER t ALL RANK BY k")] == ["z", "b", "c"] and cache.hits == 1
    clock[0] = 61.0
    cache.rows_of("COVER t ALL RANK BY k")
    assert cache.hits == 1
    p.patch(2, v="w")
    p.delete([1])
    assert [(r["k"], r["v"]) for r in p.list(first=5).collect()] == [(2, "w"), (3, "c")] and p.get(3).count() == 1
    for n in range(4):
        cache.rows_of(f"COVER t FIRST {n + 1}")
    assert len(cache.held) == 2
    with pytest.raises(ValueError):
        p.upsert([{"k": 1, "nope": 2}])


def test_conversions(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text('k,v,note\n1,2.5,"x, y"\n2,,z\n')
    want = [{"k": 1, "v": 2.5, "note": "x, y"}, {"k": 2, "v": None, "note": "z"}]
    for a, b in (("a.csv", "b.txt"), ("b.txt", "c.json"), ("c.json", "d.txt"), ("d.txt", "e.csv")):
        assert convert.main([f"{tmp_path}/{a}", f"{tmp_path}/{b}"]) == 0
        assert convert.read(f"{tmp_path}/{b}") == want
    assert convert.main(["profile", f"{tmp_path}/e.csv"]) == 0 and "1 missing" in capsys.readouterr().out and convert.main([]) == 2
    assert [json.loads(x) for x in convert.lines(spark.createDataFrame([(1, "a")], "k int, v string"))] == [{"k": 1, "v": "a"}]


def test_row_functions_of_the_system(spark):
    s = language.Session(spark).add("t", spark.createDataFrame([(1, 2.0)], "k int, v double"), "k")
    row = s.execute("COVER t ALL PROJECT (k, CURRENT_BUNDLE() AS b, VERSION() AS x, CURRENT_ROLE() AS r)").first()
    assert row["b"] == "t" and row["x"] and row["r"]
