"""Queries of functions, graphs, patterns, vectors and models, writes and sealing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import graph as GR
from ..operators import patterns as PT
from ..operators import sealing as SE
from ..operators import vectors as V
from ..operators import writes as WR
from .catalog import register, table


def _t(spark, d, name):
    return table(spark, d, name)


# -- Scalar functions

@register("fn_math", """
    SELECT o_orderkey, abs(o_custkey - 50) AS a, round(o_totalprice, 1) AS r, ceil(o_totalprice)::BIGINT AS c, floor(o_totalprice)::BIGINT AS f, round(pow(o_custkey, 2), 6) AS p, round(sqrt(o_totalprice), 8) AS sq,
        round(cbrt(o_totalprice), 8) AS cb, round(ln(o_totalprice), 8) AS l, round(log10(o_totalprice), 8) AS l10, round(log2(o_totalprice), 8) AS l2, round(exp(o_custkey / 1000000), 8) AS e, o_custkey % 7 AS m,
        sign(o_custkey - 50)::DOUBLE AS sg, greatest(o_custkey, 40) AS g, least(o_custkey, 40) AS le, trunc(o_totalprice)::BIGINT AS tr FROM orders""")
def fn_math(spark, d):
    k, t = F.col("o_custkey"), F.col("o_totalprice")
    return _t(spark, d, "orders").select(
        "o_orderkey", F.abs(k - 50).alias("a"), F.round(t, 1).alias("r"), F.ceil(t).alias("c"), F.floor(t).alias("f"), F.round(F.pow(k, F.lit(2)), 6).alias("p"), F.round(F.sqrt(t), 8).alias("sq"),
        F.round(F.cbrt(t), 8).alias("cb"), F.round(F.ln(t), 8).alias("l"), F.round(F.log10(t), 8).alias("l10"), F.round(F.log2(t), 8).alias("l2"), F.round(F.exp(k / 1000000), 8).alias("e"), (k % 7).alias("m"),
        F.signum(k - 50).alias("sg"), F.greatest(k, F.lit(40)).alias("g"), F.least(k, F.lit(40)).alias("le"), t.cast("long").alias("tr"),
    )


@register("fn_string", """
    SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, substr(c_name, 2, 4) AS s, left(c_name, 3) AS lf, right(c_name, 3) AS rt, c_name || '-' || c_mktsegment AS c, concat_ws('/', c_name, c_mktsegment) AS cw,
        replace(c_name, '0', 'o') AS rp, trim('  ' || c_name || ' ') AS t, ltrim('  x ') AS lt, rtrim(' x  ') AS rtr, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, reverse(c_name) AS rv, repeat('ab', 3) AS re,
        strpos(c_name, '0') AS po, split_part(c_name, '#', 1) AS sp, md5(c_name) AS h FROM customer""")
def fn_string(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return _t(spark, d, "customer").select(
        "c_custkey", F.upper(n).alias("u"), F.lower(n).alias("l"), F.length(n).cast("long").alias("n"), F.substring(n, 2, 4).alias("s"), F.left(n, F.lit(3)).alias("lf"), F.right(n, F.lit(3)).alias("rt"), F.concat(n, F.lit("-"), m).alias("c"),
        F.concat_ws("/", n, m).alias("cw"), F.replace(n, F.lit("0"), F.lit("o")).alias("rp"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.ltrim(F.lit("  x ")).alias("lt"), F.rtrim(F.lit(" x  ")).alias("rtr"),
        F.lpad(m, 12, "*").alias("lp"), F.rpad(m, 12, "*").alias("rpd"), F.reverse(n).alias("rv"), F.repeat(F.lit("ab"), 3).alias("re"), F.instr(n, "0").cast("long").alias("po"), F.split_part(n, F.lit("#"), F.lit(1)).alias("sp"), F.md5(n.cast("binary")).alias("h"),
    )


@register("fn_date", """
    SELECT event_id, epoch_us(ts) // 1000000 AS epoch, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, hour(ts)::INT AS h, dayofweek(ts)::INT AS dow, dayofyear(ts)::INT AS doy, date_trunc('hour', ts)::TIMESTAMP AS tr, ts + INTERVAL 3 DAY AS ad,
        date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS df, strftime(ts, '%Y/%m/%d') AS fm, strptime('2024-02-03', '%Y-%m-%d')::DATE AS pd FROM events""")
def fn_date(spark, d):
    t = F.col("ts")
    return _t(spark, d, "events").select(
        "event_id", F.unix_seconds(t.cast("timestamp")).alias("epoch"), F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.hour(t).alias("h"), (F.dayofweek(t) - 1).alias("dow"), F.dayofyear(t).alias("doy"),
        F.date_trunc("hour", t).cast("timestamp_ntz").alias("tr"), (t + F.expr("INTERVAL 3 DAY")).alias("ad"), F.datediff(t, F.lit("2024-01-01").cast("date")).alias("df"), F.date_format(t, "yyyy/MM/dd").alias("fm"), F.to_date(F.lit("2024-02-03"), "yyyy-MM-dd").alias("pd"),
    )


@register("fn_cast", "SELECT o_orderkey, o_totalprice::BIGINT::VARCHAR AS s, (o_custkey::VARCHAR)::INT AS i, try_cast(o_orderpriority AS INT) AS bad, (o_custkey % 2)::BOOLEAN AS b FROM (SELECT *, floor(o_totalprice) AS o_floor FROM orders) WHERE o_totalprice = o_floor OR o_orderkey < 50")
def fn_cast(spark, d):
    o = _t(spark, d, "orders").where("o_totalprice = floor(o_totalprice) or o_orderkey < 50")
    return o.select("o_orderkey", F.bround("o_totalprice").cast("long").cast("string").alias("s"), F.col("o_custkey").cast("string").cast("int").alias("i"), F.expr("try_cast(o_orderpriority as int)").alias("bad"), (F.col("o_custkey") % 2).cast("boolean").alias("b"))


@register("fn_conditional", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS i, coalesce(nullif(s_nationkey, 3), -1) AS c, greatest(s_nationkey, 5) AS g, least(s_nationkey, 5) AS l FROM supplier")
def fn_conditional(spark, d):
    n = F.col("s_nationkey")
    return _t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("i"), F.coalesce(F.nullif(n, F.lit(3)), F.lit(-1)).alias("c"), F.greatest(n, F.lit(5)).alias("g"), F.least(n, F.lit(5)).alias("l"))


@register("fn_array", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def fn_array(spark, d):
    v = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("s"), F.round(v[0].cast("double"), 6).alias("first"))


@register("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, to_json(struct_pack(id := event_id, type := event_type))::VARCHAR AS j FROM events")
def fn_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("j"))


@register("fn_trigram", """
    WITH g AS (SELECT c_custkey, list_distinct(list_transform(range(1, length(c_mktsegment) - 1), lambda i: substr(lower(c_mktsegment), i, 3))) AS a, list_distinct(list_transform(range(1, length('MACHINERY') - 1), lambda i: substr('machinery', i, 3))) AS b FROM customer)
    SELECT c_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) AS s, round(sqrt(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 8) AS d FROM g""")
def fn_trigram(spark, d):
    """SAME and DIST of two texts: S + d^2 = 1."""
    s = A.jaccard(A.trigrams(F.col("c_mktsegment")), A.trigrams(F.lit("MACHINERY")))
    return _t(spark, d, "customer").select("c_custkey", F.round(s, 8).alias("s"), F.round(F.sqrt(1 - s), 8).alias("d"))


# -- Graphs

@register("graph_degrees", """
    SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) + count(*) OVER (PARTITION BY c_mktsegment) - count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1 AS degree FROM customer""")
def graph_degrees(spark, d):
    return GR.degrees(_t(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"])


@register("graph_edges", """
    SELECT count(*) AS edges FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND (a.c_nationkey = b.c_nationkey OR a.c_mktsegment = b.c_mktsegment)""")
def graph_edges(spark, d):
    return GR.edge_count(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("betti1", """
    WITH RECURSIVE v AS (SELECT DISTINCT s_nationkey AS a, floor(s_acctbal / 2000)::INT AS b FROM supplier), reach(a, b, ra, rb) AS (SELECT a, b, a, b FROM v UNION SELECT v.a, v.b, r.ra, r.rb FROM reach r JOIN v ON v.a = r.a OR v.b = r.b),
    e AS (SELECT count(*) AS e FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND (x.s_nationkey = y.s_nationkey OR floor(x.s_acctbal / 2000) = floor(y.s_acctbal / 2000))),
    b AS (SELECT count(DISTINCT m) AS b FROM (SELECT a, b, min((ra, rb)) AS m FROM reach GROUP BY a, b))
    SELECT b AS beta_0, e - (SELECT count(*) FROM supplier) + b AS beta_1 FROM e, b""")
def betti1(spark, d):
    s = _t(spark, d, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 2000).cast("int"))
    return GR.betti(s, "s_suppkey", ["s_nationkey", "band"])


@register("neighbours", "SELECT c_custkey FROM customer WHERE c_custkey <> 7 AND (c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7) OR c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7))")
def neighbours(spark, d):
    return GR.neighbours(_t(spark, d, "customer"), "c_custkey", 7, ["c_nationkey", "c_mktsegment"])


@register("spectral_gap")
def spectral_gap(spark, d):
    return GR.spectral_gap(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


def _flows(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") * 7 % 25).cast("int").alias("dst"), "o_totalprice")
    return e.groupBy("src", "dst").agg(F.sum("o_totalprice").alias("w"))


_FLOWS = "(SELECT c_nationkey AS src, (o_orderkey * 7 % 25)::INT AS dst, sum(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@register("net_flow", f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(CASE WHEN src < dst THEN w ELSE -w END), 2) AS net FROM {_FLOWS} WHERE src <> dst GROUP BY ALL")
def net_flow(spark, d):
    return GR.net_flow(_flows(spark, d)).select("a", "b", F.round("net", 2).alias("net"))


@register("circulation")
def circulation(spark, d):
    return GR.circulation(_flows(spark, d))


@register("geodesic", f"""
    WITH RECURSIVE e AS (SELECT src, dst, 1 AS w FROM {_FLOWS} WHERE dst = (src * 3 + 1) % 25 OR dst = (src + 2) % 25), r(node, n) AS (SELECT 0, 0 UNION SELECT dst, n + 1 FROM r JOIN e ON e.src = r.node WHERE n < 25)
    SELECT node, min(n)::DOUBLE AS distance FROM r GROUP BY node""")
def geodesic(spark, d):
    return GR.shortest(_ring(spark, d), 0).select("node", "distance")


def _ring(spark, d):
    return _flows(spark, d).where("dst = (src * 3 + 1) % 25 or dst = (src + 2) % 25").select("src", "dst", F.lit(1.0).alias("w"))


@register("complete", """
    WITH h AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer),
    m AS (SELECT *, median(v) OVER (PARTITION BY c_nationkey) AS med FROM h WHERE v IS NOT NULL), a AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY c_nationkey) AS mad FROM m),
    p AS (SELECT c_nationkey, avg(v) AS predicted, count(*) AS n FROM a WHERE (mad = 0 AND v = med) OR (mad > 0 AND 0.6745 * abs(v - med) / mad <= 3) GROUP BY ALL HAVING count(*) >= 2)
    SELECT c_custkey AS key, round(predicted, 6) AS predicted, round(n / (n + 1), 8) AS confidence FROM h JOIN p USING (c_nationkey) WHERE v IS NULL""")
def complete(spark, d):
    h = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("v"))
    return GR.completed(h, "c_custkey", "v", "c_nationkey").select("key", F.round("predicted", 6).alias("predicted"), F.round("confidence", 8).alias("confidence"))


# -- Patterns

_CHEAP = PT.Pattern("cheap", ("o_totalprice < 60000", "o_orderstatus = 'F'", "o_custkey < 100"), "greatest(100000 - o_totalprice, 0) / 1000")


@register("hunt", "SELECT o_orderkey, round(greatest(100000 - o_totalprice, 0) / 1000, 8) AS _score FROM orders WHERE o_totalprice < 60000 AND o_orderstatus = 'F' AND o_custkey < 100 ORDER BY _score DESC, o_orderkey LIMIT 20")
def hunt(spark, d):
    return PT.hunt(_t(spark, d, "orders"), _CHEAP, "o_orderkey", top=20).select("o_orderkey", F.round("_score", 8).alias("_score"))


@register("hunt_excluding", "SELECT o_orderkey, round(greatest(100000 - o_totalprice, 0) / 1000, 8) AS _score FROM orders WHERE o_totalprice < 60000 AND o_orderstatus = 'F' AND o_custkey < 100 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def hunt_excluding(spark, d):
    gone = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return PT.hunt(_t(spark, d, "orders"), _CHEAP, "o_orderkey", excluding=[gone]).select("o_orderkey", F.round("_score", 8).alias("_score"))


_MISS = "(o_totalprice >= 60000)::INT + (o_orderstatus <> 'F')::INT + (o_custkey >= 100)::INT"


@register("hunt_near_miss", f"SELECT o_orderkey, {_MISS} AS violated FROM orders WHERE {_MISS} = 1")
def hunt_near_miss(spark, d):
    return PT.near_misses(_t(spark, d, "orders"), _CHEAP, "o_orderkey").select("o_orderkey", "violated")


@register("sudoku_sat", f"SELECT CASE WHEN n_matches > 0 THEN 'sat' WHEN near_miss_count > 0 THEN 'near_miss' ELSE 'unsat' END AS verdict, * FROM (SELECT count(*) FILTER (WHERE {_MISS} = 0) AS n_matches, count(*) FILTER (WHERE {_MISS} BETWEEN 1 AND 2) AS near_miss_count FROM orders)")
def sudoku_sat(spark, d):
    return PT.verdict(_t(spark, d, "orders"), _CHEAP, "o_orderkey", 2)


@register("relaxation", f"SELECT c AS conjunct, n AS gained FROM (SELECT 'o_totalprice < 60000' AS c, count(*) FILTER (WHERE o_totalprice >= 60000 AND {_MISS} = 1) AS n FROM orders UNION ALL SELECT 'o_orderstatus = ''F''', count(*) FILTER (WHERE o_orderstatus <> 'F' AND {_MISS} = 1) FROM orders UNION ALL SELECT 'o_custkey < 100', count(*) FILTER (WHERE o_custkey >= 100 AND {_MISS} = 1) FROM orders)")
def relaxation(spark, d):
    return PT.relaxation(_t(spark, d, "orders"), _CHEAP)


# -- Vectors and models

_QUERY = [math.sin(i + 1) for i in range(64)]
_LIST = "[" + ", ".join(repr(x) for x in _QUERY) + "]::DOUBLE[64]"
_VEC = "(SELECT vec_id, label, embedding::DOUBLE[]::DOUBLE[64] AS e FROM embeddings)"


def _similar(metric: str, sql: str) -> None:
    @register(f"vector_topk_{metric}", f"SELECT vec_id, round({sql}, 8) AS score FROM {_VEC} ORDER BY {sql} DESC, vec_id LIMIT 10")
    def run(spark, d):
        return V.top_k(_t(spark, d, "embeddings"), "vec_id", "embedding", _QUERY, 10, metric).select("vec_id", F.round("score", 8).alias("score"))


_similar("cosine", f"array_cosine_similarity(e, {_LIST})")
_similar("l2", f"-array_distance(e, {_LIST})")
_similar("dot", f"array_inner_product(e, {_LIST})")


@register("near_euclid", "SELECT o_orderkey, round(sqrt(pow((o_totalprice - 100000) / 500000, 2) + pow((o_custkey - 50) / 1500, 2)), 8) AS distance FROM orders WHERE sqrt(pow((o_totalprice - 100000) / 500000, 2) + pow((o_custkey - 50) / 1500, 2)) <= 0.05")
def near_euclid(spark, d):
    out = V.near(_t(spark, d, "orders"), {"o_totalprice": 100000.0, "o_custkey": 50.0}, 0.05, {"o_totalprice": 500000.0, "o_custkey": 1500.0})
    return out.orderBy("distance").select("o_orderkey", F.round("distance", 8).alias("distance"))


@register("near_cosine", "SELECT l_orderkey, l_linenumber, round(d, 8) AS distance FROM (SELECT l_orderkey, l_linenumber, 1 - (l_quantity * 30 + l_tax * 100000 * 1) / (sqrt(pow(l_quantity, 2) + pow(l_tax * 100000, 2)) * sqrt(901)) AS d FROM lineitem) WHERE d <= 0.01")
def near_cosine(spark, d):
    li = _t(spark, d, "lineitem").withColumn("t", F.col("l_tax") * 100000)
    return V.near(li, {"l_quantity": 30.0, "t": 1.0}, 0.01, {}, "cosine").select("l_orderkey", "l_linenumber", F.round("distance", 8).alias("distance"))


@register("attend", f"WITH d AS (SELECT vec_id, pow(array_distance(e, {_LIST}), 2) AS d FROM {_VEC}), w AS (SELECT vec_id, exp(-(d - min(d) OVER ()) / 2) AS w FROM d) SELECT vec_id, round(w / sum(w) OVER (), 8) AS weight FROM w")
def attend(spark, d):
    return V.attend(_t(spark, d, "embeddings"), "vec_id", "embedding", _QUERY).select("vec_id", F.round("weight", 8).alias("weight"))


@register("kde", f"SELECT round(avg(exp(-pow(array_distance(e, {_LIST}), 2) / 50)), 8) AS density FROM {_VEC}")
def kde(spark, d):
    return V.density(_t(spark, d, "embeddings"), "embedding", _QUERY, 5.0).select(F.round("density", 8).alias("density"))


@register("membership", """
    WITH c AS (SELECT avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_extendedprice) AS mp, var_pop(l_extendedprice) AS vp FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_orderkey, l_linenumber, l_quantity, round(pow(l_quantity - mq, 2) / vq + pow(l_extendedprice - mp, 2) / vp, 6) AS d2 FROM lineitem, c WHERE pow(l_quantity - mq, 2) / vq + pow(l_extendedprice - mp, 2) / vp <= 0.5""")
def membership(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return V.membership(li, ["l_quantity", "l_extendedprice"], "l_returnflag", "R", 0.5).select("l_orderkey", "l_linenumber", "l_quantity", F.round("d2", 6).alias("d2"))


@register("regression", """
    SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def regression(spark, d):
    return V.regression(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("coefficient", 4).alias("coefficient"))


@register("ridge_path")
def ridge_path(spark, d):
    return V.regression(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], 10.0)


@register("kmeans")
def kmeans(spark, d):
    return V.kmeans(_t(spark, d, "embeddings"), "vec_id", "embedding", 10)


@register("mixture")
def mixture(spark, d):
    return V.mixture(_t(spark, d, "embeddings"), "vec_id", "embedding", 3)


@register("pca")
def pca(spark, d):
    return V.pca(_t(spark, d, "embeddings"), "vec_id", "embedding", 2)


@register("spectral_modes")
def spectral_modes(spark, d):
    return V.modes(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("als")
def als(spark, d):
    e = _t(spark, d, "events").groupBy("user_id", F.abs(F.hash("event_type") % 100).alias("item")).agg(F.avg("value").alias("r"))
    return V.factors(e, "user_id", "item", "r")


# -- Writes

@register("upsert_merge", """
    SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 9999999, 'new', 1.5""")
def upsert_merge(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(1.5).alias("s_acctbal"))
    rows = rows.unionByName(spark.range(1).select(F.lit(9999999).cast("long").alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(1.5).alias("s_acctbal")))
    return WR.upsert(s, rows, ["s_suppkey"])


@register("update_delete", "SELECT s_suppkey, round(CASE WHEN s_nationkey < 5 THEN 0 ELSE s_acctbal END + CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END, 2) AS s_acctbal FROM supplier WHERE s_nationkey <> 7")
def update_delete(spark, d):
    steps = [
        lambda t: WR.update(t, F.col("s_nationkey") < 5, s_acctbal=0.0),
        lambda t: WR.increment(t, F.col("s_suppkey") % 2 == 0, "s_acctbal", 10),
        lambda t: WR.delete(t, F.col("s_nationkey") == 7),
    ]
    return WR.apply_all(_t(spark, d, "supplier"), steps).select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@register("ttl_expire", "SELECT event_id FROM events WHERE event_id % 3 = 0 OR epoch_ms(ts) > 1705276800000")
def ttl_expire(spark, d):
    e = _t(spark, d, "events").withColumn("_ttl", F.when(F.col("event_id") % 3 != 0, F.unix_millis(F.col("ts").cast("timestamp"))))
    return WR.expired(e, 1705276800000).select("event_id")


@register("versioned_conflicts", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3")
def versioned_conflicts(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(2).alias("v"))
    rows = s.where("s_suppkey % 10 in (3, 4)").withColumn("v", F.when(F.col("s_suppkey") % 10 == 3, 1).otherwise(2))
    return WR.versioned(s, rows, "s_suppkey", "v")[1].select("s_suppkey")


@register("auto_increment", "SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name) AS n_nationkey, r_name FROM region")
def auto_increment(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return WR.numbered(n, _t(spark, d, "region").select("r_name"), "n_nationkey", ["r_name"])


# -- Sealing

@register("affine_sum_recovery", "SELECT o_orderstatus, count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max FROM orders GROUP BY o_orderstatus")
def affine_sum_recovery(spark, d):
    o = _t(spark, d, "orders").select("o_orderstatus", SE.affine("o_totalprice", -3.0, 11.0).alias("w"))
    r = SE.recovered("w", -3.0, 11.0)
    digits = {"sum": 2, "avg": 4, "min": 4, "max": 4}
    return o.groupBy("o_orderstatus").agg(r["count"].alias("count"), *[F.round(r[k], n).alias(k) for k, n in digits.items()])


@register("affine_var_recovery", "SELECT o_orderstatus, round(var_pop(o_totalprice) / 1e6, 4) AS variance, round(stddev_pop(o_totalprice), 4) AS stddev, round(max(o_totalprice) - min(o_totalprice), 4) AS range, round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderstatus")
def affine_var_recovery(spark, d):
    o = _t(spark, d, "orders").select("o_orderstatus", SE.affine("o_totalprice", 2.5, -9.0).alias("w"))
    r = SE.recovered("w", 2.5, -9.0)
    return o.groupBy("o_orderstatus").agg(F.round(r["variance"] / 1e6, 4).alias("variance"), *[F.round(r[k], 4).alias(k) for k in ("stddev", "range", "median")])


@register("indexed_lookup", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def indexed_lookup(spark, d):
    """An equality asked of the digests: the literal is digested too."""
    c = _t(spark, d, "customer").select("c_custkey", SE.indexed("c_mktsegment", "k1").alias("w"))
    lit = spark.range(1).select(F.lit("BUILDING").alias("v")).select(SE.indexed("v", "k1").alias("w"))
    return c.join(F.broadcast(lit), "w", "left_semi").select("c_custkey")


@register("sealed_round_trip", "SELECT n_nationkey, n_name FROM nation")
def sealed_round_trip(spark, d):
    key = b"0123456789abcdef"
    n = _t(spark, d, "nation").select("n_nationkey", SE.sealed("n_name", key).alias("w"))
    return n.select("n_nationkey", SE.unsealed("w", key).alias("n_name"))


@register("key_rotation", "SELECT s_suppkey, s_acctbal FROM supplier")
def key_rotation(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", SE.affine("s_acctbal", 2.0, 5.0).alias("w"))
    s = s.select("s_suppkey", SE.rekeyed("w", 2.0, 5.0, -4.0, 1.0).alias("w"))
    return s.select("s_suppkey", F.round(SE.unaffine("w", -4.0, 1.0), 2).alias("s_acctbal"))


@register("content_version")
def content_version(spark, d):
    return SE.content_version(_t(spark, d, "nation"))


@register("merkle_root")
def merkle_root(spark, d):
    return SE.merkle_root(_t(spark, d, "nation"), "n_nationkey")


_P = "SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = {} GROUP BY ALL"
_PQ = f"(SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM ({_P.format(0)})) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM ({_P.format(1)})) AS q FROM ({_P.format(0)}) a FULL JOIN ({_P.format(1)}) b USING (event_type))"


@register("tv_distance", f"SELECT round(sum(abs(p - q)) / 2, 8) AS tv FROM {_PQ}")
def tv_distance(spark, d):
    return _beliefs(spark, d).select(F.round("tv", 8).alias("tv"))


@register("hellinger", f"SELECT round(sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2), 8) AS hellinger, round(sum(p * log2(p / q)), 8) AS kl_bits FROM {_PQ}")
def hellinger(spark, d):
    return _beliefs(spark, d).select(F.round("hellinger", 8).alias("hellinger"), F.round("kl_bits", 8).alias("kl_bits"))


def _beliefs(spark, d):
    e = _t(spark, d, "events").select("event_type", F.lit(1).alias("n"), "user_id")
    return SE.belief_distances(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), "event_type", "n")
