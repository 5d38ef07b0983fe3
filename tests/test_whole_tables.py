"""Queries without SQL run over whole tables and vectors."""

import numpy as np
import pyarrow.parquet as pq

from tessera.operators import graph as GR
from tessera.operators import vectors as V
from tessera.plans import applied


def test_circulation_takes_all_orders(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(GR, "circulation", lambda edges: seen.append(edges) or edges)
    applied.circulation(spark, sf)
    total = sum(r["w"] for r in seen[0].collect())
    assert np.isclose(total, np.sum(pq.read_table(f"{sf}/orders.parquet")["o_totalprice"].to_numpy()))


def test_mixture_takes_all_components(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "mixture", lambda rows, key, field, k: seen.append((rows, field)) or rows)
    applied.mixture(spark, sf)
    rows, field = seen[0]
    assert {len(r[field]) for r in rows.select(field).collect()} == {64}
