"""Paths, flows and components go on to the end, over all edges."""

import numpy as np
import pytest

from tessera.operators import graph as GR
from tessera.operators.components import connected_components

EDGES = "src int, dst int, w double"


def test_more_than_twenty_hops(spark):
    rows = [(i, i + 1, 1.0) for i in range(22)] + [(0, 22, 100.0)]
    df = spark.createDataFrame(rows, EDGES).coalesce(1)
    got = {r["node"]: (r["distance"], r["before"]) for r in GR.shortest(df, 0).collect()}
    assert got == {i: (float(i), i - 1 if i else None) for i in range(23)}
    assert [tuple(r) for r in GR.path(df, 3, 6).collect()] == [(0, 3, 0.0), (1, 4, 1.0), (2, 5, 2.0), (3, 6, 3.0)]
    assert GR.path(df, 6, 3).count() == 0


def plain(rows):
    net = {}
    for a, b, w in rows:
        if a != b:
            k = (min(a, b), max(a, b))
            net[k] = net.get(k, 0.0) + (w if a < b else -w)
    nodes = sorted({x for k in net for x in k})
    b = np.zeros((len(net), len(nodes)))
    for i, (x, y) in enumerate(net):
        b[i, nodes.index(x)], b[i, nodes.index(y)] = -1, 1
    w = np.array(list(net.values()))
    rest = w - b @ np.linalg.lstsq(b, w, rcond=None)[0]
    return len(nodes), float((rest**2).sum() / (w**2).sum()), dict(zip(net, rest))


def test_circulation_takes_all_edges(spark):
    rng = np.random.default_rng(4)
    many = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.random(900))]
    for rows in ([(i, j, float(j - i)) for i in range(12) for j in range(i)], many, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (7, 8, 2.0)]):
        df = spark.createDataFrame(rows, EDGES)
        got, (nodes, ratio, rest) = GR.circulation(df).first(), plain(rows)
        assert got["nodes"] == nodes and got["ratio"] == pytest.approx(ratio, abs=1e-8)
    got = {(r["a"], r["b"]): r["cyclic"] for r in GR.cyclic_edges(df, 3).collect()}
    assert all(rest[k] == pytest.approx(v, abs=1e-8) for k, v in got.items()) and len(got) == 3


def test_spectral_gap_tells_values_apart(spark):
    for a, b in ((-1, -2), (1, 2)):
        df = spark.createDataFrame([(a, 0), (b, 1)], "x int, y int")
        assert GR.spectral_gap(df, ["x", "y"]).first()["status"] == "edgeless"
    df = spark.createDataFrame([(None, 0), (None, 1)], "x int, y int")
    assert GR.spectral_gap(df, ["x", "y"]).first()["status"] == "edgeless"


def test_components_of_hubs_and_chains(spark):
    rows = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 380)] + [(500, 500), (None, 3), (380, 600)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(200)} | {i: 300 for i in [*range(300, 381), 600]}
