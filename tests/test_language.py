"""Statements of the query language against the DataFrame API."""

import pytest

from tessera import language
from tessera.operators import patterns


@pytest.fixture
def s(spark, sf):
    out = language.Session(spark)
    for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("events", "event_id")):
        out.add(t, spark.read.parquet(f"{sf}/{t}.parquet"), k)
    return out


def test_reads(s):
    o = s.tables["orders"]
    assert s.execute("COVER orders ALL").count() == o.count()
    got = s.execute("COVER orders ON o_orderstatus = 'F' WHERE o_totalprice > 1000 AND (o_custkey < 50 OR o_custkey >= 100) RANK BY o_totalprice DESC FIRST 5 SKIP 2 PROJECT (o_orderkey, o_totalprice - 100 AS net)")
    want = o.where("o_orderstatus = 'F' and o_totalprice > 1000 and (o_custkey < 50 or o_custkey >= 100)").orderBy("o_totalprice", ascending=False).limit(7).collect()[2:]
    assert [r["o_orderkey"] for r in got.collect()] == [r["o_orderkey"] for r in want] and got.columns == ["o_orderkey", "net"]
    assert s.execute("SECTION orders AT o_orderkey = 7 PROJECT (o_custkey)").count() == 1
    assert s.execute("EXISTS SECTION orders AT o_orderkey = -1").first()[0] is False
    assert s.execute("COVER orders ON o_orderstatus IN ('F', 'P') DISTINCT o_orderstatus").count() == 2
    assert s.execute("COVER events WHERE ts >= '2024-01-10' AND event_type MATCHES '/^cl/'").count() > 0
    assert s.execute("COVER customer WHERE c_mktsegment CONTAINS 'BUILD' EMIT JSON").columns == ["line"]


def test_aggregates_and_joins(s):
    got = s.execute("INTEGRATE orders OVER o_orderstatus MEASURE COUNT(*) AS n, SUM(o_totalprice) FILTER (WHERE o_custkey < 50) AS part HAVING n > 10 RANK BY n DESC")
    assert got.columns == ["o_orderstatus", "n", "part"] and got.count() == 3
    out = s.execute("PULLBACK orders ALONG o_custkey ONTO customer ALONG c_nationkey ONTO nation PRESERVE LEFT")
    assert out.count() == s.tables["orders"].count() and "n_name" in out.columns
    assert s.execute("FIBER RANK orders OVER o_orderstatus RANK BY o_totalprice").where("rank = 1").count() == 3
    assert "sum_value" in s.execute("FIBER SUM events OF value OVER user_id WINDOW ts ROWS (UNBOUNDED, 0)").columns
    assert "value_shift" in s.execute("TRANSPORT events OF value ALONG ts SHIFT -1 OVER user_id").columns
    both = "(COVER nation ALL PROJECT (n_nationkey)) WITH (COVER nation WHERE n_nationkey < 5 PROJECT (n_nationkey))"
    assert s.execute(f"UNION {both}").count() == 25 and s.execute(f"INTERSECT {both}").count() == 5
    assert s.execute("WITH big AS (COVER orders WHERE o_totalprice > 100000) INTEGRATE big MEASURE COUNT(*) AS n").first()[0] > 0
    assert "big" not in s.tables


def test_geometry(s):
    assert 0 < s.execute("CURVATURE orders ON o_totalprice").first()["k"] < 1
    assert s.execute("CURVATURE orders ON o_totalprice BY o_orderstatus").count() == 3
    assert 0 < s.execute("CONFIDENCE orders").first()[0] < 1
    assert s.execute("ENTROPY orders ON o_orderstatus, o_orderpriority").first()["distinct"] == 15
    assert s.execute("PREDICT customer ON c_acctbal BY c_nationkey").count() > 5
    assert "Filter" in s.execute("EXPLAIN COVER orders WHERE o_custkey = 3").first()[0]
    patterns.define("dear", ["o_totalprice > 100000"], "o_totalprice", replace=True)
    assert s.execute("HUNT dear IN orders TOP 3").count() == 3


def test_changes(s):
    s.execute("GENERATE BASE grid FROM k=1 TO k=9 STEP 2 WITH (v=0)")
    s.execute("SECTION grid (k: 2, v: 7); SECTION grid (k: 3, v: 5) UPSERT; REDEFINE grid AT k=1 SET (v: 4); RETRACT grid ON v = 0")
    assert sorted(tuple(r) for r in s.execute("COVER grid ALL").collect()) == [(1, 4), (2, 7), (3, 5)]
    s.execute("LENS few AS COVER grid WHERE v > 4")
    assert s.execute("COVER few ALL").count() == 2
    assert {r["name"] for r in s.execute("SHOW BUNDLES").collect()} >= {"grid", "orders"}


@pytest.mark.parametrize("text", ["COVER nothing ALL", "COVER orders WHERE nofield = 1", "COVER orders ALL extra words", "FROB orders", "INTEGRATE orders MEASURE FROB(o_custkey)", "COVER orders WHERE o_custkey", "COVER orders ALL FIRST 'x'", "COVER ? ALL"])
def test_errors_are_loud(s, text):
    with pytest.raises(language.LanguageError):
        s.execute(text)
    with pytest.raises(NotImplementedError):
        s.execute("ATLAS BEGIN")


def one(df):
    return df.first().asDict()


def test_geometry_verbs(s):
    from tessera.operators import geometry as G

    k = G.curvature(s.tables["customer"], ["c_nationkey", "c_acctbal"]).first()["k"]
    assert one(s.execute("CAPACITY customer TOLERANCE 2.5")) == pytest.approx({"k": k, "capacity": 2.5 / k})
    h = one(s.execute("HORIZON customer ON (c_nationkey, c_mktsegment)"))
    assert h["horizon"] == pytest.approx(1 / (k * h["length"])) and one(s.execute("DEPTH customer ON (c_nationkey)"))["depth"] == "IV"
    assert s.execute("FREEENERGY customer BY c_nationkey ON c_acctbal TOLERANCE 0.5").count() == 1
    assert one(s.execute("HEALTH customer ON (c_nationkey)"))["records"] == s.tables["customer"].count()
    assert one(s.execute("PROJECT INVARIANT (curvature * 2 + capacity(0.5)) FROM customer"))["value"] == pytest.approx(2 * k + 0.5 / k)
    assert s.execute("MUTUAL orders ON o_orderstatus, o_orderpriority").first()[0] >= 0
    assert s.execute("FISHER customer ON c_acctbal").count() == 1 and s.execute("CORRELATE customer ON c_acctbal, c_nationkey").count() == 3
    assert one(s.execute("HOLONOMY customer ON FIBER (c_acctbal, c_custkey) AROUND c_nationkey"))["groups"] == 25
    near = one(s.execute("HOLONOMY customer NEAR (c_acctbal = 5000) WITHIN 0.2 METRIC EUCLIDEAN ON FIBER (c_acctbal, c_custkey) AROUND c_nationkey"))
    assert near["groups"] <= 25
    assert s.execute("GAUGE customer VS customer ON FIBER (c_acctbal, c_custkey) AROUND c_nationkey").first()["invariant"]
    s.execute("GAUGE customer TRANSFORM (c_acctbal = 3)")
    assert one(s.execute("CAPACITY customer"))["k"] == pytest.approx(k)
    why = s.execute("EXPLAIN SECTION orders AT o_orderkey IN (1, 7)").collect()
    assert {r["o_orderkey"] for r in why} == {1, 7} and why[0]["kappa"] >= why[1]["kappa"]
    assert s.execute("EXPLAIN SECTION orders AT o_orderkey = 1 VECTOR (o_totalprice, o_custkey)").first()["length"] > 0
    assert s.execute("KAPPA_RANK orders ON o_totalprice").where("kappa_rank = 1").count() >= 1
    best = s.execute("SAMENESS_RANK customer TO (c_acctbal = 1000, c_nationkey = 3)").where("sameness_rank = 1").first()
    assert best["same"] + best["dist"] ** 2 == pytest.approx(1)


def test_row_functions(s):
    n = s.tables["orders"].count()
    loud = s.execute("COVER orders WHERE ANOMALY() = TRUE PROJECT (o_orderkey, Z_SCORE() AS z, CONFIDENCE() AS c)")
    assert loud.columns == ["o_orderkey", "z", "c"] and 0 < loud.count() < n and loud.where("z <= 2").count() == 0
    assert s.execute("COVER orders WHERE Z_SCORE() > 2").count() == loud.count() and s.execute("COVER orders WHERE Z_SCORE() > 2").columns == s.tables["orders"].columns
    assert s.execute("COVER orders WHERE CURVATURE(o_totalprice) < 0.1 AND CONFIDENCE() >= 0.5").count() < n
    near = s.execute("COVER orders NEAR (o_totalprice = 100000, o_custkey = 50) WITHIN 0.1 FIRST 5").collect()
    assert len(near) == 5 and [r["distance"] for r in near] == sorted(r["distance"] for r in near)


def test_graph_verbs(s, spark):
    b = one(s.execute("BETTI customer ON (c_nationkey)"))
    assert one(s.execute("EULER customer ON (c_nationkey)"))["euler"] == b["beta_0"] - b["beta_1"]
    gap = one(s.execute("SPECTRAL customer"))["gap"]
    assert gap is None and s.execute("SPECTRAL customer ON c_mktsegment FULL").count() > 1
    m = one(s.execute("MIXING customer ON (c_nationkey, c_mktsegment)"))
    assert m["mixing"] == pytest.approx(1 / m["gap"]) and s.execute("LAPLACIAN customer ON (c_nationkey)").count() > 1
    assert s.execute("SPECTRAL orders ON FIBER (o_totalprice, o_custkey) MODES 2").count() == 2
    assert 0 <= one(s.execute("CONDUCTANCE customer ON (c_nationkey) WHERE c_acctbal > 5000"))["conductance"] <= 1
    s.add("edges", spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 0, 1.0)], "src int, dst int, w double"), "src")
    assert [r["node"] for r in s.execute("GEODESIC edges FROM src = 0 TO dst = 2").collect()] == [0, 1, 2]
    assert one(s.execute("CIRCULATION edges"))["nodes"] == 3 and s.execute("CIRCULATION edges TOP 2").count() == 2
    assert s.execute("RICCI nation BETWEEN 3 AND 9").first()["distance"] > 0


def test_series_verbs(s):
    kinds = s.tables["events"].select("event_type").distinct().count()
    assert s.execute("TEXTURE events ON value ALONG ts OVER event_type WITH Q = 2.0, MIN_LAG = 1").count() == kinds
    assert s.execute("TEXTURE events ON value ALONG ts").columns == ["n", "hurst", "r2", "verdict"]
    assert s.execute("PRECEDENCE events ON value, user_id ALONG ts").count() == 1
    assert s.execute("CADENCE events ON ts").first()["verdict"] in ("STEADY", "BURSTY", "THROTTLED")
    assert s.execute("EPISODIC events ON ts OVER event_type RATIO 4").where("ratio < 4").count() == 0
    assert s.execute("TREND events ON value ALONG ts OVER user_id WINDOW 5").count() == s.tables["events"].count()
    assert s.execute("CHANGEPOINTS events ON value ALONG ts WINDOW 20 THRESHOLD 3").columns == ["i", "stat"]
    last = s.execute("ASOF events WITH events ON user_id ALONG ts MATCH ts PROJECT (value)")
    assert last.where("value <> value_right").count() == 0


def test_anomaly_and_model_verbs(s, spark, sf):
    n = s.tables["events"].count()
    assert 0 < s.execute("ANOMALIES events ON value SIGMA 1.5").count() < n
    assert s.execute("OUTLIER events ON value SIGMA 1.5 BY event_type").where("abs(z) <= 1.5").count() == 0
    got = s.execute("SCAN events ON value CONTEXT event_type INTERACTION event_type * user_id VELOCITY user_id ALONG ts BUDGET 0.1")
    assert got.count() == n and 0 < got.where("flagged").count() <= 0.1 * n + 1
    s.add("held", s.tables["customer"].selectExpr("c_custkey", "c_nationkey", "c_mktsegment", "case when c_custkey % 5 > 0 then c_acctbal end as v"), "c_custkey")
    assert s.execute("COMPLETE held ON v BY c_nationkey").count() > 0
    assert s.execute("PROPAGATE held ON v BY c_nationkey SETTING (COVER customer WHERE c_custkey = 5 PROJECT (c_custkey, c_acctbal AS v))").count() > 0
    assert s.execute("SUGGEST_ADJACENCY held ON v FROM (c_nationkey, c_mktsegment)").count() == 2
    for method in ("local_linear", "ols", "knn"):
        assert s.execute(f"INFER held PREDICT v FROM (c_custkey, c_nationkey) USING {method} K 8").count() == 30
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    s.add("vectors", e, "vec_id")
    at = ", ".join(["0.1"] * 64)
    assert s.execute(f"ATTEND vectors ON embedding TO ({at}) SIGMA 0.5 TOP 3").count() == 3
    assert len(s.execute("REDUCE vectors ON embedding MODES 3 WHITEN").first()["reduced"]) == 3
    assert s.execute("CLUSTER vectors ON embedding USING kmeans K 4").select("cluster").distinct().count() <= 4
    assert s.execute("PARTITION customer AT c_acctbal = 100 TOLERANCE 0.5").count() == s.tables["customer"].count()


def test_patterns(s):
    s.execute("DEFINE OR REPLACE PATTERN dear AS o_totalprice BETWEEN 200000 AND 900000 AND o_orderstatus = 'F' WEIGHT (o_totalprice / 1000)")
    want = s.tables["orders"].where("o_totalprice between 200000 and 900000 and o_orderstatus = 'F'")
    assert s.execute("HUNT dear IN orders").count() == want.count() > 0
    assert s.execute("SHOW PATTERNS").where("name = 'dear'").count() == 1
    assert s.execute("VERDICT dear IN orders BUDGET 1").first()["n_matches"] == want.count() and s.execute("RELAX dear IN orders").count() == 2
    s.execute("DROP PATTERN dear")
    assert s.execute("SHOW PATTERNS").where("name = 'dear'").count() == 0


def test_gaps_moves_and_files(s, spark, tmp_path):
    s.add("sparse", spark.createDataFrame([("a", 1, 1.0), ("a", 4, 4.0), ("b", 2, 7.0)], "g string, t long, v double"), "t")
    line = {(r["g"], r["t"]): r["v"] for r in s.execute("FILL sparse ON v ALONG t OVER g USING INTERPOLATE LINEAR").collect()}
    assert line[("a", 2)] == 2.0 and line[("b", 4)] is None
    assert {(r["g"], r["t"]): r["v"] for r in s.execute("FILL sparse ON v ALONG t OVER g USING CONSTANT (0.5)").collect()}[("a", 2)] == 0.5
    s.add("few", s.tables["nation"].limit(0), "n_nationkey")
    s.execute("TRANSPLANT nation INTO few WHERE n_regionkey = 1 RETRACT SOURCE")
    assert s.tables["few"].count() == 5 and s.tables["nation"].count() == 20
    assert s.execute("PRODUCT few WITH sparse").count() == 15
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n2,3.5\n")
    s.execute(f"INGEST mine FROM '{tmp_path}/a.csv' FORMAT CSV KEY id")
    assert s.execute("INTEGRATE mine MEASURE SUM(x) AS x").first()["x"] == 6.0
    assert s.execute("SHOW FIELDS mine").count() == 2 and s.execute("SHOW STATISTICS mine").count() >= 1 and s.execute("PROFILE mine").count() == 2
    s.execute("SNAPSHOT mine AS 'mine-as-it-was'")
    root = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    assert spark.read.parquet(f"{root}/mine-as-it-was").count() == 2
    assert one(s.execute("DIFF sparse AGAINST sparse SHOW CURVATURE"))["delta_k"] == 0


def test_recursion(s, spark):
    s.add("chain", spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 4.0), (8, 9, 8.0)], "k int, next int, w double"), "k")
    got = s.execute("ITERATE chain START AT k = 1 STEP ALONG next UNTIL VOID ACCUMULATE SUM(w)")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1.0), (1, 2, 3.0), (2, 3, 7.0)]
    text = "WITH RECURSIVE r AS ((COVER chain WHERE k = 1 PROJECT (k, next)) UNION (COVER chain ON k IN (COVER r ALL PROJECT (next)) PROJECT (k, next))) COVER r ALL"
    assert sorted(r["k"] for r in s.execute(text).collect()) == [1, 2, 3] and "r" not in s.tables


def test_subscriptions(s, spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    s.add("live", spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "event_id")
    for i, text in enumerate(("SUBSCRIBE live ON event_type = 'click'", "SUBSCRIBE ANOMALIES live ON value AGAINST events")):
        q = s.execute(text).writeStream.format("memory").queryName(f"sub{i}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("sub0").count() == events.where("event_type = 'click'").count() and 0 < spark.table("sub1").count() < events.count()


def test_errors_stay_loud(s):
    for text in ("TEXTURE events ON nothing ALONG ts", "INFER events PREDICT value FROM (user_id) USING magic", "CLUSTER events", "BETTI nowhere", "SCAN events CONTEXT", "PROJECT INVARIANT (system) FROM customer"):
        with pytest.raises(language.LanguageError):
            s.execute(text)
