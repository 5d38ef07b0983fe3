"""Queries of the relational core: scans, predicates, joins, aggregation, windows, sets, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import relational as R
from .catalog import register, table


def _t(spark, d, *names):
    out = [table(spark, d, n) for n in names]
    return out if len(out) > 1 else out[0]


# -- The four published benchmark queries, their dates moved into the tables' range

@register("tpch_q1", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def tpch_q1(spark, d) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = lambda c, n=2: F.round(c, n)
    return R.integrate(
        _t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], where=P.le("l_shipdate", "1998-09-02", nulls="sql"),
        sum_qty=r(F.sum("l_quantity")), sum_base_price=r(F.sum("l_extendedprice")), sum_disc_price=r(F.sum(price)),
        sum_charge=r(F.sum(price * (1 + F.col("l_tax")))), avg_qty=r(F.avg("l_quantity"), 6), avg_price=r(F.avg("l_extendedprice"), 6),
        avg_disc=r(F.avg("l_discount"), 6), count_order=F.count("*"),
    )


@register("tpch_q3", """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
    FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def tpch_q3(spark, d) -> DataFrame:
    c, o, li = _t(spark, d, "customer", "orders", "lineitem")
    o = o.where(F.col("o_orderdate") < P.at("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    o = R.semi(o, c.where(P.eq("c_mktsegment", "BUILDING")), "o_custkey", "c_custkey")
    li = li.where(F.col("l_shipdate") > P.at("1998-03-15")).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = R.pullback(li, o, "l_orderkey", "o_orderkey", unique=True)
    out = R.integrate(joined, ["l_orderkey", "o_orderdate"], revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4))
    return R.page(out, [F.desc("revenue"), "o_orderdate", "l_orderkey"], 10).select("l_orderkey", "revenue", "o_orderdate")


@register("tpch_q6", """
    SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def tpch_q6(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    when = P.all_of(F.col("l_shipdate") >= P.at("1996-01-01"), F.col("l_shipdate") < P.at("1997-01-01"), P.between("l_discount", 0.05, 0.07), P.lt("l_quantity", 24, nulls="sql"))
    return R.integrate(li, where=when, revenue=F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4))


@register("tpch_q14", """
    SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS promo_revenue
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""")
def tpch_q14(spark, d) -> DataFrame:
    li, p = _t(spark, d, "lineitem", "part")
    li = li.where((F.col("l_shipdate") >= P.at("1995-09-01")) & (F.col("l_shipdate") < P.at("1995-10-01")))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = R.pullback(li.select("l_partkey", "l_extendedprice", "l_discount"), p.select("p_partkey", "p_type"), "l_partkey", "p_partkey", unique=True)
    promo = F.sum(F.when(F.col("p_type").startswith("PROMO"), price).otherwise(0.0))
    return R.integrate(joined, promo_revenue=F.round(100.0 * promo / F.sum(price), 8))


# -- Predicates

_HOLED = "(SELECT event_id, user_id, event_type, ts, CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM events)"


def _holed(spark, d) -> DataFrame:
    """events with nulls put in, which the tables lack."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return e.withColumn("value", F.when(F.col("value") >= 5, F.col("value")))


def _predicate(name: str, tables: str, columns: str, sql: str, predicate, holed: bool = False) -> None:
    source = _HOLED if holed else tables

    @register(name, f"SELECT {columns} FROM {source} WHERE {sql}")
    def run(spark, d) -> DataFrame:
        df = _holed(spark, d) if holed else _t(spark, d, tables)
        return df.where(predicate()).select(*[c.strip() for c in columns.split(",")])


_predicate("pred_eq", "customer", "c_custkey, c_name", "c_mktsegment = 'BUILDING'", lambda: P.eq("c_mktsegment", "BUILDING"))
_predicate("pred_neq_nullsafe", "events", "event_id, value", "value IS DISTINCT FROM 100", lambda: P.ne("value", 100), True)
_predicate("pred_range", "orders", "o_orderkey, o_totalprice", "o_totalprice > 100000 AND o_totalprice >= 100000.5", lambda: P.all_of(P.gt("o_totalprice", 100000), P.ge("o_totalprice", 100000.5)))
_predicate("pred_lt_null_matching", "events", "event_id, value", "value IS NULL OR value < 20", lambda: P.all_of(P.lt("value", 20), P.le("value", 20)), True)
_predicate("pred_between", "orders", "o_orderkey, o_totalprice", "o_totalprice BETWEEN 50000 AND 60000", lambda: P.between("o_totalprice", 50000, 60000))
_predicate("pred_in", "orders", "o_orderkey, o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda: P.one_of("o_orderpriority", ["1-URGENT", "2-HIGH"]))
_predicate("pred_not_in", "events", "event_id, value", "value IS NULL OR value NOT IN (10, 20)", lambda: P.not_in("value", [10.0, 20.0]), True)
_predicate("pred_isnull", "events", "event_id", "value IS NULL", lambda: P.void("value"), True)
_predicate("pred_defined", "events", "event_id, value", "value IS NOT NULL", lambda: P.defined("value"), True)
_predicate("pred_contains_ci", "part", "p_partkey, p_name", "contains(lower(p_name), 'e')", lambda: P.contains("p_name", "E"))
_predicate("pred_starts_ci", "part", "p_partkey, p_type", "starts_with(lower(p_type), 'pro')", lambda: P.starts_with("p_type", "pRo"))
_predicate("pred_ends_ci", "customer", "c_custkey, c_mktsegment", "lower(c_mktsegment) LIKE '%ing'", lambda: P.ends_with("c_mktsegment", "ING"))
_predicate("pred_regex", "customer", "c_custkey, c_name", "regexp_matches(c_name, '[13579]$')", lambda: P.matches("c_name", "[13579]$"))
_predicate("pred_glob", "part", "p_partkey, p_brand", "regexp_full_match(p_brand, 'Brand#1.')", lambda: P.glob("p_brand", "Brand#1?"))
_predicate(
    "pred_or_groups", "orders", "o_orderkey", "(o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 5000)",
    lambda: P.any_group([[P.eq("o_orderstatus", "F"), P.gt("o_totalprice", 200000)], [P.eq("o_orderstatus", "O"), P.lt("o_totalprice", 5000, nulls="sql")]]),
)
_predicate("pred_timestamp_literal", "events", "event_id, ts", "ts >= TIMESTAMP '2024-01-10 12:30:00' AND ts < epoch_ms(1705276800000)", lambda: (F.col("ts") >= P.at("2024-01-10T12:30Z")) & (F.col("ts") < P.at(1705276800000)))
_predicate("free_text_search", "customer", "c_custkey", "contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR contains(lower(c_mktsegment), 'mach')", lambda: P.any_of(P.search(["c_name", "c_mktsegment"], "12"), P.search(["c_mktsegment"], "MACH")))


# -- Scans, point reads, projections

@register("scan_all", "SELECT r_regionkey, r_name FROM region")
def scan_all(spark, d):
    return _t(spark, d, "region")


@register("point_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_read(spark, d):
    return R.point(_t(spark, d, "orders"), ["o_orderkey", "o_totalprice"], o_orderkey=7)


@register("point_read_composite", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def point_read_composite(spark, d):
    return R.point(_t(spark, d, "conversations"), ["conv_id", "turn", "role"], conv_id=3, turn=1)


@register("exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1e12")
def exists(spark, d):
    return R.exists(_t(spark, d, "orders"), F.col("o_totalprice") > 1e12)


@register("range_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (1, 5, 9, 77)")
def range_in(spark, d):
    return R.lookup(_t(spark, d, "lineitem"), "l_orderkey", [1, 5, 9, 77, 5]).select("l_orderkey", "l_linenumber", "l_quantity")


@register("distinct", f"SELECT DISTINCT event_type FROM {_HOLED} WHERE event_type IS NOT NULL")
def distinct(spark, d):
    return R.distinct_values(_t(spark, d, "events"), "event_type")


@register("count_where", f"SELECT count(*) AS n, count(value) AS n_value FROM {_HOLED} WHERE event_type = 'click'")
def count_where(spark, d):
    return R.integrate(_holed(spark, d), where=P.eq("event_type", "click"), n=F.count("*"), n_value=F.count("value"))


@register("project_computed", """
    SELECT o_orderkey, round(o_totalprice - 100, 2) AS net, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size,
        coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders""")
def project_computed(spark, d):
    size = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "middle").otherwise("small")
    return _t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - 100, 2).alias("net"), size.alias("size"), F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("priority"))


@register("topk_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def topk_page(spark, d):
    return R.page(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, 10)


@register("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def sort_multi(spark, d):
    return R.page(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey", F.desc("c_acctbal"), "c_custkey"])


@register("limit_unsorted", "SELECT 20::BIGINT AS n, 20::BIGINT AS distinct_keys, 20::BIGINT AS known")
def limit_unsorted(spark, d):
    """Which rows come is free: twenty, of different keys, all of them rows of the table."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    known = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    some = o.limit(20).join(known, F.expr("o_orderkey = k and o_totalprice = p"), "left")
    return some.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"), F.count("k").alias("known"))


@register("overlay_merge", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 7""")
def overlay_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    recent = o.where(F.col("o_orderkey") % 10 == 3).withColumn("o_totalprice", F.lit(0.0))
    return R.overlay(o, recent, ["o_orderkey"], o.where(F.col("o_orderkey") % 10 == 7))


# -- Joins

@register("join_inner", "SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return R.pullback(o.select("o_orderkey", "o_custkey"), c.select("c_custkey", "c_name", "c_acctbal"), "o_custkey", "c_custkey", unique=True)


@register("join_left", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY') ON o_custkey = c_custkey")
def join_left(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    c = c.where(P.eq("c_mktsegment", "MACHINERY")).select("c_custkey", "c_name")
    return R.pullback(o.select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey", keep_left=True, unique=True)


@register("join_chain", """
    SELECT o_orderkey, o_custkey, c_nationkey, n_name, n_regionkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join_chain(spark, d):
    o, c, n, r = _t(spark, d, "orders", "customer", "nation", "region")
    out = R.pullback(o.select("o_orderkey", "o_custkey"), c.select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey", unique=True)
    return R.pullback(R.pullback(out, n, "c_nationkey", "n_nationkey", unique=True), r, "n_regionkey", "r_regionkey", unique=True)


@register("join_self", """
    SELECT a.s_suppkey, a.s_nationkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal > b.s_acctbal""")
def join_self(spark, d):
    a = _t(spark, d, "supplier").alias("a")
    b = _t(spark, d, "supplier").alias("b")
    on = "a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and a.s_acctbal > b.s_acctbal"
    return a.join(b, F.expr(on)).select("a.s_suppkey", "a.s_nationkey", F.col("b.s_suppkey").alias("other"))


@register("join_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def join_semi(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return R.semi(o, c.where("c_acctbal > 9000"), "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice")


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_anti(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return R.anti(c, o.where(P.eq("o_orderstatus", "P")), "c_custkey", "o_custkey").select("c_custkey")


@register("join_cross", "SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    """PRODUCT of two tables whose sizes are fixed: 5 regions and 25 nations."""
    r, n = _t(spark, d, "region", "nation")
    return r.select("r_name").join(n.select("n_name"), F.lit(True))


@register("join_merge_names", "SELECT s_suppkey AS k, s_name AS name, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_merge_names(spark, d):
    """Both sides have `name`; the left one stands."""
    s, n = _t(spark, d, "supplier", "nation")
    left = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_nationkey")
    return R.pullback(left, n.select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey"), "s_nationkey", "n_nationkey")


@register("iterate_recursive", """
    WITH RECURSIVE walk(depth, k) AS (SELECT 0, 40::BIGINT UNION ALL SELECT depth + 1, k // 2 FROM walk WHERE k // 2 > 0)
    SELECT depth, k FROM walk""")
def iterate_recursive(spark, d):
    """ITERATE along a parent field: event ids as a binary heap."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("k"))
    tree = e.withColumn("parent", F.expr("if(k div 2 > 0, k div 2, null)"))
    return R.iterate(tree, "k", "parent", 40)


@register("range_join", """
    SELECT e.event_id, o.label FROM events e JOIN (VALUES ('low', 0, 50), ('mid', 50, 200), ('high', 200, 10000)) o(label, lo, hi) ON e.value >= o.lo AND e.value < o.hi""")
def range_join(spark, d):
    bands = spark.createDataFrame([("low", 0, 50), ("mid", 50, 200), ("high", 200, 10000)], "label string, lo int, hi int")
    return _t(spark, d, "events").join(F.broadcast(bands), F.expr("value >= lo and value < hi")).select("event_id", "label")


# -- Aggregation

@register("agg_global", "SELECT count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events")
def agg_global(spark, d):
    return R.integrate(_t(spark, d, "events"), n=F.count("*"), total=F.round(F.sum("value"), 2), mean=F.round(F.avg("value"), 6), low=F.min("value"), high=F.max("value"))


@register("agg_group", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg_group(spark, d):
    return R.integrate(_t(spark, d, "events"), ["event_type"], n=F.count("*"), mean=F.round(F.avg("value"), 6))


@register("agg_multi", f"SELECT event_type, user_id % 7 AS g, count(*) AS n, count(value) AS n_value, round(sum(value), 2) AS total, max(ts) AS last FROM {_HOLED} GROUP BY ALL")
def agg_multi(spark, d):
    e = _holed(spark, d).withColumn("g", F.col("user_id") % 7)
    return R.integrate(e, ["event_type", "g"], n=F.count("*"), n_value=F.count("value"), total=F.round(F.sum("value"), 2), last=F.max("ts"))


@register("agg_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS sum_o FROM orders GROUP BY o_orderpriority")
def agg_filter_clause(spark, d):
    return R.integrate(
        _t(spark, d, "orders"), ["o_orderpriority"],
        n_f=F.count(R.measure_if(P.eq("o_orderstatus", "F"))), sum_o=F.round(F.sum(R.measure_if(P.eq("o_orderstatus", "O"), F.col("o_totalprice"))), 2),
    )


@register("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, d):
    return R.integrate(_t(spark, d, "orders"), ["o_custkey"], having=F.col("n") > 12, n=F.count("*"))


@register("agg_stddev_pop", "SELECT event_type, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY event_type")
def agg_stddev_pop(spark, d):
    m = R.population("value")
    return R.integrate(_t(spark, d, "events"), ["event_type"], variance=F.round(m["variance"], 4), stddev=F.round(m["stddev"], 6))


@register("agg_array", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_array(spark, d):
    return R.integrate(_t(spark, d, "nation"), ["n_regionkey"], names=F.array_join(F.sort_array(F.collect_list("n_name")), ","))


@register("agg_rank_first", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 5")
def agg_rank_first(spark, d):
    out = R.integrate(_t(spark, d, "lineitem"), ["l_suppkey"], total=F.round(F.sum("l_extendedprice"), 2))
    return R.page(out, [F.desc("total"), "l_suppkey"], 5)


@register("agg_restrict", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY l_returnflag")
def agg_restrict(spark, d):
    li, p = _t(spark, d, "lineitem", "part")
    return R.integrate(R.semi(li, p.where("p_size < 5"), "l_partkey", "p_partkey"), ["l_returnflag"], n=F.count("*"))


@register("agg_spreadsheet", """
    SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS q1, round(stddev_samp(value), 6) AS sd,
        round(sum(value) FILTER (WHERE user_id < 50), 2) AS sumif, count(*) FILTER (WHERE value > 100) AS countif, round(avg(value) FILTER (WHERE user_id < 50), 6) AS averageif,
        min(value) FILTER (WHERE user_id < 50) AS minif, max(value) FILTER (WHERE user_id < 50) AS maxif FROM events GROUP BY event_type""")
def agg_spreadsheet(spark, d):
    few = R.measure_if(F.col("user_id") < 50, F.col("value"))
    return R.integrate(
        _t(spark, d, "events"), ["event_type"],
        med=F.round(F.median("value"), 6), p90=F.round(F.percentile("value", 0.9), 6), q1=F.round(F.percentile("value", 0.25), 6), sd=F.round(F.stddev_samp("value"), 6),
        sumif=F.round(F.sum(few), 2), countif=F.count(R.measure_if(F.col("value") > 100)), averageif=F.round(F.avg(few), 6), minif=F.min(few), maxif=F.max(few),
    )


@register("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return _t(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return _t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("agg_approx_distinct")
def agg_approx_distinct(spark, d):
    return _t(spark, d, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


# -- Windows

def _window(name, sql, make):
    @register(name, sql)
    def run(spark, d) -> DataFrame:
        e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
        return make(e)


_E = "FROM events"
_window("win_row_number", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank {_E}", lambda e: R.ranked(e, ["event_type"], ["value", "event_id"]).select("event_id", "rank"))
_window("win_cumsum", f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS total {_E}", lambda e: R.running(e, ["user_id"], ["ts"], F.sum("value"), None, 0, "total").select("event_id", F.round("total", 4).alias("total")))
_window("win_moving_avg", f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS mean {_E}", lambda e: R.running(e, ["user_id"], ["ts"], F.avg("value"), -7, 7, "mean").select("event_id", F.round("mean", 6).alias("mean")))
_window("win_percent_rank", f"SELECT event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 8) AS pr {_E}", lambda e: e.select("event_id", F.round(F.percent_rank().over(R.Window.partitionBy("event_type").orderBy("value")), 8).alias("pr")))
_window("win_lag", f"SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS before {_E}", lambda e: R.transported(e, "value", ["user_id"], ["ts"], -1, "before").select("event_id", "before"))
_window("win_lead", f"SELECT event_id, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS after {_E}", lambda e: R.transported(e, "value", ["user_id"], ["ts"], 2, "after").select("event_id", "after"))


@register("win_delta", """
    WITH days AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)
    SELECT event_type, day, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY day), 4) AS delta FROM days""")
def win_delta(spark, d):
    days = R.integrate(_t(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], v=F.sum("value"))
    out = R.transported(days, "v", ["event_type"], ["day"], -1, "before")
    return out.select("event_type", "day", F.round(F.col("v") - F.col("before"), 4).alias("delta"))


# -- Sets, subqueries, series

def _nations(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a = c.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k"))
    return a, s.where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))


_A, _B = "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000)", "(SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000)"


@register("set_union", f"SELECT k FROM {_A} UNION SELECT k FROM {_B}")
def set_union(spark, d):
    return R.union(*_nations(spark, d))


@register("set_intersect", f"SELECT k FROM {_A} INTERSECT SELECT k FROM {_B}")
def set_intersect(spark, d):
    return R.intersect(*_nations(spark, d))


@register("set_subtract", f"SELECT k FROM {_A} EXCEPT SELECT k FROM {_B}")
def set_subtract(spark, d):
    return R.subtract(*_nations(spark, d))


@register("set_diff", f"SELECT k, 'a' AS side FROM (SELECT k FROM {_A} EXCEPT ALL SELECT k FROM {_B}) UNION ALL SELECT k, 'b' FROM (SELECT k FROM {_B} EXCEPT ALL SELECT k FROM {_A})")
def set_diff(spark, d):
    return R.difference(*_nations(spark, d))


@register("set_glue", """
    SELECT c_custkey, v, count(*) OVER (PARTITION BY c_custkey) > 1 AS conflict FROM (
        SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_nationkey < 10
        UNION SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END FROM customer WHERE c_nationkey BETWEEN 5 AND 15)""")
def set_glue(spark, d):
    c = _t(spark, d, "customer")
    a = c.where("c_nationkey < 10").select("c_custkey", F.col("c_acctbal").alias("v"))
    b = c.where("c_nationkey between 5 and 15").select("c_custkey", F.expr("if(c_custkey % 3 = 0, 0D, c_acctbal)").alias("v"))
    return R.glued(a, b, "c_custkey")


@register("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def in_subquery(spark, d):
    p, li = _t(spark, d, "part", "lineitem")
    return R.semi(p.select("p_partkey"), li.where("l_quantity > 49"), "p_partkey", "l_partkey")


@register("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
def cte(spark, d):
    big = _t(spark, d, "orders").where("o_totalprice > 100000")
    return R.integrate(big, ["o_orderstatus"], n=F.count("*"))


@register("generate_series", "SELECT range AS k, 0 AS v FROM range(5, 101, 5)")
def generate_series(spark, d):
    return R.series(spark, 5, 100, 5, v=0)


_SPARSE = "(SELECT event_type, (epoch_us(ts) // 600000000 - 2840112)::BIGINT AS t, avg(value) AS v FROM events GROUP BY ALL)"


def _sparse(spark, d):
    """Means of ten-minute slots, many of them empty, of the thirty days from 2024-01-01."""
    t = F.expr("unix_seconds(cast(ts as timestamp)) div 600 - 2840112")
    return _t(spark, d, "events").groupBy("event_type", t.alias("t")).agg(F.avg("value").alias("v"))


@register("fill_linear", f"""
    WITH s AS {_SPARSE}, g AS (SELECT event_type, t FROM (SELECT DISTINCT event_type FROM s), (SELECT unnest(range(0, 4320)) AS t)),
    j AS (SELECT g.event_type, g.t, s.v, max(s.t) OVER a AS ta, min(s.t) OVER b AS tb FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.t = s.t
        WINDOW a AS (PARTITION BY g.event_type ORDER BY g.t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY g.event_type ORDER BY g.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT j.event_type, j.t, round(CASE WHEN ta = tb THEN x.v ELSE x.v + (y.v - x.v) / (tb - ta) * (j.t - ta) END, 9) AS v
    FROM j LEFT JOIN s x ON x.event_type = j.event_type AND x.t = ta LEFT JOIN s y ON y.event_type = j.event_type AND y.t = tb""")
def fill_linear(spark, d):
    out = R.filled(_sparse(spark, d), "event_type", "t", "v", 0, 4319)
    return out.withColumn("v", F.round("v", 9))


@register("fill_transport", f"""
    WITH s AS {_SPARSE}, g AS (SELECT event_type, t FROM (SELECT DISTINCT event_type FROM s), (SELECT unnest(range(0, 4320)) AS t))
    SELECT g.event_type, g.t, round(last_value(v IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.t ROWS UNBOUNDED PRECEDING), 9) AS v
    FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.t = s.t""")
def fill_transport(spark, d):
    return R.filled(_sparse(spark, d), "event_type", "t", "v", 0, 4319, "transport").withColumn("v", F.round("v", 9))
