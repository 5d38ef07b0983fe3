"""Readers, writers, codec, and streams run to the end of their files."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.sources import files
from tessera.streaming import subscriptions as S

VALUES = st.one_of(st.none(), st.integers(-(2**40), 2**40), st.booleans(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": VALUES, "b": st.integers(0, 3), "c": st.text("xy\\\t\nN", max_size=3)}), max_size=12))
def test_codec_round_trip(records):
    assert files.decode(files.encode(records)) == records


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text('name,age\n"a, ""b""",3\nc,4\n')
    df = files.ingest_csv(spark, str(tmp_path / "e.csv"))
    assert sorted(map(tuple, df.collect())) == [('a, "b"', 3), ("c", 4)]
    (tmp_path / "bad.csv").write_text("name,age\n,3\n")
    with pytest.raises(Exception, match="empty key"):
        files.ingest_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "e.jsonl").write_text('{"id": 1, "v": [1, 2]}\n{"id": 2, "v": [3, 4]}\n')
    assert dict(files.ingest_jsonl(spark, str(tmp_path / "e.jsonl"), "id").dtypes)["v"] == "array<double>"
    np.savez(tmp_path / "a.npz", m=np.arange(6.0).reshape(3, 2))
    assert sorted((r["row_idx"], r["vector"]) for r in files.ingest_npz(spark, str(tmp_path / "a.npz")).collect()) == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    back = spark.read.csv(files.emit_csv(df, str(tmp_path), "out"), header=True, escape='"')
    assert back.columns == ["age", "name"] and back.count() == 2
    with pytest.raises(PermissionError):
        files.emit_csv(df, str(tmp_path), "../out")
    files.snapshot(df, str(tmp_path), "s1")
    with pytest.raises(Exception):
        files.snapshot(df, str(tmp_path), "s1")


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4).write.parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def ran(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert ran(S.matching(stream(), F.col("event_type") == "click"), "m").count() == e.where("event_type = 'click'").count()
    assert ran(S.anomalies(stream(), e, ["value"]), "a").count() == S.anomalies(e, e, ["value"]).count() > 0
    got = {r["event_type"]: r for r in ran(S.running_moments(stream(), "event_type", "value"), "r", "update").orderBy("n").collect()}
    for r in G.curvature(e, ["value"], ["event_type"]).collect():
        assert abs(got[r["event_type"]]["k"] - r["k"]) < 1e-9
    want = S.windows(e, "ts", [], "1 day", n=F.count("*"))
    assert ran(S.windows(stream(), "ts", [], "1 day", n=F.count("*"), late="60 days"), "w", "complete").exceptAll(want).count() == 0
    hits = []
    S.trigger(stream(), F.col("value") > 400, lambda df, n: hits.append(df.count()), str(tmp_path / "t")).awaitTermination(120)
    assert sum(hits) == e.where("value > 400").count()
    told = []
    S.recomputed(stream(), lambda df: df.agg(F.avg("value")).first()[0], 0.0, lambda *x: told.append(x), str(tmp_path / "c")).awaitTermination(120)
    assert told
