"""Queries of the engine's own operators over the test tables, each with SQL to hold it against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.control import ontology as O
from millrace.control import security as S
from millrace.control.lineage import LineageStore
from millrace.control.versioning import diff_frame
from millrace.functions import transforms as X
from millrace.functions.types import SCHEMAS, Field, Schema
from millrace.operators import infer as I
from millrace.operators import quality as Q
from millrace.operators import relational as R
from millrace.pipelines import support
from millrace.plans.check import PlanChecker
from millrace.plans.compile import Compiler
from millrace.plans.ir import Aggregate, Aggregation, Cast, Filter, Join, JoinKey, Map, Pipeline, Source, Union, WindowStep
from millrace.sources import connectors as C
from millrace.sources import incremental as N
from millrace.streaming import incremental as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- flagship ------------------------------------------------------------------------------------------------------

@query("""
WITH cases AS (
  SELECT 'order_' || o_orderkey AS case_id, o_orderstatus AS subject, o_orderpriority AS ticket_type, 'orders' AS source_system FROM orders
  UNION ALL SELECT 'event_' || event_id, props, event_type, 'events' FROM events),
m AS (SELECT *, CASE ticket_type WHEN '1-URGENT' THEN 'ECONOMY' WHEN '2-HIGH' THEN 'SMALL' WHEN '3-MEDIUM' THEN 'NOSUCH' WHEN 'purchase' THEN 'LARGE'
  WHEN 'error' THEN 'ECONOMY' END AS matched_category FROM cases)
SELECT case_id, subject, ticket_type, matched_category, coalesce(n, 0) AS matched_article_count, source_system
FROM m LEFT JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ON matched_category = p_type""")
def flagship_support_pipeline(spark, d):
    return support.flagship(spark, d)


@query("""
SELECT case_id, subject, ticket_type, jco.matched_category, coalesce(n, 0) AS matched_article_count, source_system FROM (
  SELECT case_id, subject, ticket_type, source_system, m.category AS matched_category FROM joined_case_output j LEFT JOIN ticket_type_map m USING (ticket_type)) jco
LEFT JOIN (SELECT category, count(*) AS n FROM knowledge_articles GROUP BY 1) a ON jco.matched_category = a.category""")
def flagship_case_articles(spark, d):
    """The mapping as a table rather than a parameter; sizes decide how it is joined."""
    cases = t(spark, d, "joined_case_output").select("case_id", "subject", "ticket_type", "source_system")
    per = t(spark, d, "knowledge_articles").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    out = cases.join(t(spark, d, "ticket_type_map"), "ticket_type", "left").join(per, "category", "left")
    return out.select("case_id", "subject", "ticket_type", F.col("category").alias("matched_category"), F.coalesce("n", F.lit(0)).alias("matched_article_count"), "source_system")


@query("""
SELECT 'order_' || o_orderkey AS case_id, CASE WHEN o_totalprice > 100000 THEN 'big' END AS subject, o_orderpriority AS ticket_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ECONOMY' END AS matched_category, 'orders' AS source_system,
  CASE WHEN o_orderpriority = '1-URGENT' THEN (SELECT count(*) FROM part WHERE p_type = 'ECONOMY') ELSE 0 END AS matched_article_count
FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'""")
def plan_compiled(spark, d):
    """A plan of six kinds of steps, from JSON, compiled and run."""
    plan = Pipeline("orders", [Source("orders", "parquet", f"{d}/orders.parquet"), Source("part", "parquet", f"{d}/part.parquet")], [
        Filter("wanted", "orders", "o_orderstatus != 'P'"),
        Map("cases", "wanted", mapper="order_cases"),
        Map("articles", "part", mapper="part_articles"),
        Join("joined", "cases", "articles", [JoinKey("ticket_type", "category", {"1-URGENT": "ECONOMY"})]),
    ])
    c = Compiler(spark)
    c.register_mapper("order_cases", lambda df: df.select(F.concat(F.lit("order_"), "o_orderkey").alias("case_id"), F.when(F.col("o_totalprice") > 100000, "big").alias("subject"), F.col("o_orderpriority").alias("ticket_type"), F.lit("orders").alias("source_system")))
    c.register_mapper("part_articles", lambda df: df.select(F.col("p_type").alias("category"), "p_partkey"))
    return support.joined_output(c.run(Pipeline.from_json(plan.to_json())))


# -- projection, cast, map -----------------------------------------------------------------------------------------

@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS BIGINT) AS v FROM orders")
def cast_try(spark, d):
    raw = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("v"))
    return R.cast_column(raw, "v", "Integer")


@query("SELECT 'v' AS field, count(*) AS n_values, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_failed FROM orders")
def cast_failure_count(spark, d):
    raw = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("v"))
    return R.cast_failures(raw, "v", "Integer")


@query(r"SELECT p_partkey, regexp_replace(nullif(CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '   ' ELSE ' ' || p_name || chr(9) END, ''), '^\s+|\s+$', '', 'g') AS v FROM part")
def map_trim(spark, d):
    k = F.col("p_partkey") % 5
    return t(spark, d, "part").select("p_partkey", X.trim_whitespace(F.when(k == 0, "").when(k == 1, "   ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t")))).alias("v"))


@query("SELECT event_id, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, '') AS v FROM events")
def map_empty_to_none(spark, d):
    return t(spark, d, "events").select("event_id", X.empty_to_none(F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type"))).alias("v"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN date_trunc('day', o_orderdate) WHEN 3 THEN date_trunc('day', o_orderdate)
  ELSE date_trunc('second', o_orderdate) END AS v FROM orders""")
def map_parse_ts(spark, d):
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(at, "yyyy-M-d")).when(k == 3, F.date_format(at, "M/d/yyyy")).when(k == 4, F.date_format(at, "dd.MM.yyyy"))
    return t(spark, d, "orders").select("o_orderkey", X.parse_timestamp(text).alias("v"))


@query("SELECT 'cust_' || c_custkey AS case_id, c_name FROM customer")
def map_prefix_id(spark, d):
    return t(spark, d, "customer").select(X.prefix_id(F.col("c_custkey"), "cust_").alias("case_id"), "c_name")


@query("SELECT id, CASE WHEN completed THEN 'Closed' ELSE 'Open' END AS status FROM api_sample")
def map_status_flag(spark, d):
    return t(spark, d, "api_sample").select("id", X.flag_status(F.col("completed")).alias("status"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part")
def map_row_index(spark, d):
    return C.with_position(t(spark, d, "part").select("p_partkey"), "position", "p_partkey")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' END AS v FROM orders")
def map_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.lookup(F.col("o_orderpriority"), {"1-URGENT": "now", "5-LOW": "later"}).alias("v"))


@query("SELECT 'api_' || id AS case_id, title AS subject, CASE WHEN completed THEN 'Closed' ELSE 'Open' END AS status, 'support_activity_api' AS source_system FROM api_sample")
def map_activity_cases(spark, d):
    return support.map_activity(t(spark, d, "api_sample")).select("case_id", "subject", "status", "source_system")


def _chain() -> X.TransformChain:
    return X.TransformChain().add("name", "trim_whitespace").add("brand", "empty_to_none").add("id", "prefix_id", prefix="part_")


def _chain_input(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")).alias("brand"))


@query("SELECT 'part_' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def chain_full(spark, d):
    return _chain().apply(_chain_input(spark, d))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def chain_preview_1(spark, d):
    return _chain().apply(_chain_input(spark, d), 1)


@query("""SELECT p_partkey, concat(p_name, '/', p_brand) AS joined, substring(p_name, 1, 3) AS sub, replace(p_name, 'a', 'b') AS rep, upper(p_name) AS up,
  lower(p_type) AS low, string_split(p_brand, '#')[1] AS part1 FROM part""")
def scalar_catalog_string(spark, d):
    o = X.OPERATIONS["String"]
    c = F.col
    return t(spark, d, "part").select("p_partkey", o["concat"](c("p_name"), F.lit("/"), c("p_brand")).alias("joined"), o["substring"](c("p_name"), 1, 3).alias("sub"), o["replace"](c("p_name"), "a", "b").alias("rep"), o["upper"](c("p_name")).alias("up"), o["lower"](c("p_type")).alias("low"), o["split"](c("p_brand"), "#")[0].alias("part1"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days, strftime(o_orderdate, '%Y/%m/%d') AS text, year(o_orderdate) AS y,
  month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders""")
def scalar_catalog_timestamp(spark, d):
    o, c = X.OPERATIONS["Timestamp"], F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", o["date_diff"](F.lit("2000-01-01").cast("date"), c).alias("days"), o["format"](c, "yyyy/MM/dd").alias("text"), o["extract_year"](c).alias("y"), o["extract_month"](c).alias("m"), o["extract_day"](c).alias("dd"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_partkey * 2 AS m, round(l_partkey / nullif(l_linenumber - 1, 0), 6) AS q,
  l_partkey % nullif(l_linenumber - 1, 0) AS r FROM lineitem""")
def scalar_catalog_integer(spark, d):
    o, a, b = X.OPERATIONS["Integer"], F.col("l_partkey"), F.col("l_suppkey")
    z = (F.col("l_linenumber") - 1).cast("bigint")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", o["add"](a, b).alias("a"), o["subtract"](a, b).alias("s"), o["multiply"](a, F.lit(2).cast("bigint")).alias("m"), F.round(o["divide"](a, z), 6).alias("q"), o["modulo"](a, z).alias("r"))


@query("""SELECT c_custkey, round(c_acctbal, 0) AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal / nullif(c_nationkey, 0))::BIGINT AS q,
  (c_acctbal > 0) AND (c_nationkey > 10) AS b1, NOT (c_acctbal > 0) AS b2, (c_acctbal > 0) OR (c_nationkey > 10) AS b3 FROM customer""")
def scalar_catalog_double_boolean(spark, d):
    o, b, c = X.OPERATIONS["Double"], X.OPERATIONS["Boolean"], F.col("c_acctbal")
    p, q = c > 0, F.col("c_nationkey") > 10
    return t(spark, d, "customer").select("c_custkey", o["round"](c, 0).alias("r"), o["floor"](c).alias("f"), o["ceil"](c).alias("c"), F.floor(o["divide"](c, F.col("c_nationkey").cast("double"))).alias("q"), b["and"](p, q).alias("b1"), b["not"](p).alias("b2"), b["or"](p, q).alias("b3"))


_PHONE = "CASE WHEN c_custkey % 3 = 0 THEN '12-34' ELSE '+1 (' || (200 + c_custkey % 700)::VARCHAR || ') 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END"


@query(f"SELECT c_custkey, length(regexp_replace({_PHONE}, '[+\\- ()]', '', 'g')) >= 7 AS ok, regexp_replace({_PHONE}, '[^0-9+]', '', 'g') AS digits, CASE WHEN c_custkey % 3 <> 0 THEN (200 + c_custkey % 700)::VARCHAR END AS area FROM customer")
def scalar_catalog_phone(spark, d):
    o, k = X.OPERATIONS["PhoneNumber"], F.col("c_custkey")
    phone = F.when(k % 3 == 0, "12-34").otherwise(F.concat(F.lit("+1 ("), (200 + k % 700).cast("string"), F.lit(") 555-"), F.lpad((k % 10000).cast("string"), 4, "0")))
    return t(spark, d, "customer").select("c_custkey", o["validate"](phone).alias("ok"), o["format"](phone).alias("digits"), o["area_code_extract"](phone).alias("area"))


@query("""SELECT s_suppkey, s_suppkey * (s_nationkey + 1.0) AS area, sqrt(s_suppkey * s_suppkey + (s_nationkey + 1.0) * (s_nationkey + 1.0)) AS dist, s_suppkey > 50 AS holds FROM supplier""")
def scalar_catalog_geometry(spark, d):
    w, h = F.col("s_suppkey").cast("double").cast("string"), (F.col("s_nationkey") + 1.0).cast("string")
    box = F.concat(F.lit("POLYGON ((0 0, "), w, F.lit(" 0, "), w, F.lit(" "), h, F.lit(", 0 "), h, F.lit(", 0 0))"))
    corner = F.concat(F.lit("POINT ("), w, F.lit(" "), h, F.lit(")"))
    return t(spark, d, "supplier").select("s_suppkey", X.wkt_area(box).alias("area"), X.wkt_distance(F.lit("POINT (0 0)"), corner).alias("dist"), X.wkt_contains(box, F.lit("LINESTRING (1 0.5, 50.5 0.7)")).alias("holds"))


# -- filters -------------------------------------------------------------------------------------------------------

def _nulled(spark, d) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), "o_totalprice", "o_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) WHERE s = 'F'")
def filter_eq(spark, d):
    return R.filter_rows(_nulled(spark, d), "s == 'F'").select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) WHERE s IS DISTINCT FROM 'F'")
def filter_ne_nulls(spark, d):
    return R.filter_rows(_nulled(spark, d), "s != 'F'").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1996-01-01'")
def filter_expr(spark, d):
    return R.filter_rows(t(spark, d, "lineitem"), "l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_shipdate < timestamp_ntz'1996-01-01'").select("l_orderkey", "l_linenumber")


@query("SELECT n_name, 'eq' AS c FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'bad' FROM nation")
def filter_nonstring_literal(spark, d):
    n = t(spark, d, "nation")
    return R.filter_rows(n, "n_regionkey == '1'").select("n_name", F.lit("eq").alias("c")).unionByName(R.filter_rows(n, "n_regionkey != 'x'").select("n_name", F.lit("bad").alias("c")))


# -- joins ---------------------------------------------------------------------------------------------------------

_MAP = {"1-URGENT": "ECONOMY", "2-HIGH": "SMALL", "3-MEDIUM": "NOSUCH"}


@query("""SELECT o_orderkey, matched_category, coalesce(n, 0)::INTEGER AS n_matches FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'ECONOMY' WHEN '2-HIGH' THEN 'SMALL' WHEN '3-MEDIUM' THEN 'NOSUCH' END AS matched_category FROM orders)
LEFT JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ON matched_category = p_type""")
def join_mapping_one_to_many(spark, d):
    parts = t(spark, d, "part").select(F.col("p_type").alias("category"), "p_partkey")
    out = R.join_frames(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), parts, [JoinKey("o_orderpriority", "category", _MAP)], shape="nested", left_name="case", right_name="articles")
    return out.select("case.o_orderkey", "matched_category", F.size("articles").alias("n_matches"))


@query("SELECT c_custkey, count(o_orderkey)::INTEGER AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_direct_one_to_many(spark, d):
    out = R.join_frames(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select("o_custkey", "o_totalprice"), [JoinKey("c_custkey", "o_custkey")], shape="nested")
    return out.select("record.c_custkey", F.size("matched").alias("n_orders"), F.round(F.aggregate("matched", F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2).alias("total"))


@query("SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_first_match(spark, d):
    out = R.join_frames(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select("o_orderkey", "o_custkey"), [JoinKey("c_custkey", "o_custkey")], shape="nested", one_to_many=False, order_by="o_orderkey")
    return out.select("record.c_custkey", F.col("matched.o_orderkey").alias("first_order"))


def _nullable_pair(spark, d):
    a = t(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    b = t(spark, d, "nation").select("n_name", F.nullif("n_nationkey", F.lit(3)).alias("nk"))
    return a, b


_PAIR = "(SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) a {how} JOIN (SELECT n_name, nullif(n_nationkey, 3) AS nk FROM nation) b ON {on}"


@query("SELECT s_suppkey, n_name FROM " + _PAIR.format(how="LEFT", on="k IS NOT DISTINCT FROM nk"))
def join_null_safe(spark, d):
    a, b = _nullable_pair(spark, d)
    return R.join_frames(a, b, [JoinKey("k", "nk")], null_safe=True).select("s_suppkey", "n_name")


@query("SELECT s_suppkey, n_name FROM " + _PAIR.format(how="LEFT", on="k = nk"))
def join_sql_null(spark, d):
    a, b = _nullable_pair(spark, d)
    return R.join_frames(a, b, [JoinKey("k", "nk")]).select("s_suppkey", "n_name")


def _typed_join(how: str):
    """All suppliers and all nations; the nulled keys leave rows without a match on both sides."""

    def run(spark, d):
        a, b = _nullable_pair(spark, d)
        return R.join_frames(a, b, [JoinKey("k", "nk")], how).select("s_suppkey", "n_name")

    run.__name__ = f"join_{how}"
    return query("SELECT s_suppkey, n_name FROM " + _PAIR.format(how=how.upper(), on="k = nk"))(run)


for _how in ("inner", "left", "right", "full"):
    _typed_join(_how)


@query("SELECT count(*) AS n, sum(a.l_quantity)::DOUBLE AS q FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(spark, d):
    li = t(spark, d, "lineitem")
    b = li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    out = R.join_frames(li.select("l_partkey", "l_suppkey", "l_quantity"), b, [JoinKey("l_partkey", "l_partkey"), JoinKey("l_suppkey", "l_suppkey")], "inner")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_chain(spark, d):
    out = t(spark, d, "lineitem")
    for name, left, right in (("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")):
        out = R.join_frames(out, t(spark, d, name), [JoinKey(left, right)], "inner")
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# -- aggregation ---------------------------------------------------------------------------------------------------

def _aggs(*made) -> list[Aggregation]:
    return [Aggregation(*m) for m in made]


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(l_tax) AS n, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2")
def agg_basic(spark, d):
    out = R.aggregate_rows(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _aggs(("sum", "l_quantity", "sum_qty"), ("count", "l_tax", "n"), ("avg", "l_discount", "avg_disc"), ("min", "l_shipdate", "first_ship"), ("max", "l_extendedprice", "top")))
    return out.withColumn("avg_disc", F.round("avg_disc", 6))


@query("""SELECT s, coalesce(sum(v), 0) AS total, count(v) AS n, round(coalesce(avg(v), 0), 4) AS mean, min(v) AS low, max(v) AS high FROM
(SELECT nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS v FROM orders) GROUP BY s""")
def agg_null_rules(spark, d):
    base = t(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("v"))
    out = R.aggregate_rows(base, ["s"], _aggs(("sum", "v", "total"), ("count", "v", "n"), ("avg", "v", "mean"), ("min", "v", "low"), ("max", "v", "high")))
    return out.withColumn("mean", F.round("mean", 4))


@query("SELECT nullif(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY 1")
def agg_null_group(spark, d):
    return R.aggregate_rows(t(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k")), ["k"], _aggs(("count", "*", "n")))


@query("SELECT 0::BIGINT AS n, 0::DOUBLE AS s FROM orders WHERE 1 = 0")
def agg_empty(spark, d):
    return R.aggregate_rows(t(spark, d, "orders").filter("1 = 0"), [], _aggs(("count", "*", "n"), ("sum", "o_totalprice", "s")))


# -- windows, sorting, limits --------------------------------------------------------------------------------------

@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS rn FROM orders")
def window_row_number(spark, d):
    return R.window_column(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "row_number", "rn", ["o_custkey"], ["o_orderdate"], tie="o_orderkey").select("o_orderkey", "rn")


@query("SELECT n_name, rank() OVER (ORDER BY k NULLS FIRST) AS r, dense_rank() OVER (ORDER BY k NULLS FIRST) AS dr FROM (SELECT n_name, nullif(n_regionkey, 2) AS k FROM nation)")
def window_rank(spark, d):
    n = t(spark, d, "nation").select("n_name", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    return R.window_column(R.window_column(n, "rank", "r", [], ["k"]), "dense_rank", "dr", [], ["k"]).drop("k")


@query("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after2 FROM orders")
def window_lag_lead(spark, d):
    o = R.window_column(t(spark, d, "orders"), "lag", "before", ["o_custkey"], ["o_orderdate"], "o_totalprice", tie="o_orderkey")
    return R.window_column(o, "lead", "after2", ["o_custkey"], ["o_orderdate"], "o_orderkey", offset=2, tie="o_orderkey").select("o_orderkey", "before", "after2")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near FROM orders")
def window_frames(spark, d):
    o = R.window_column(t(spark, d, "orders"), "sum", "running", ["o_custkey"], ["o_orderdate"], "o_totalprice", tie="o_orderkey")
    o = R.window_column(o, "sum", "near", ["o_custkey"], ["o_orderdate"], "o_totalprice", frame=(-1, 1), tie="o_orderkey")
    return o.select("o_orderkey", F.round("running", 2).alias("running"), F.round("near", 2).alias("near"))


@query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
def window_ntile(spark, d):
    return R.window_column(t(spark, d, "orders"), "ntile", "q", ["o_orderpriority"], ["o_totalprice"], offset=4, tie="o_orderkey").select("o_orderkey", "q")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, d):
    return R.top_per_group(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


# -- unions, duplicates --------------------------------------------------------------------------------------------

def _parties(spark, d) -> dict[str, DataFrame]:
    return {
        "customer": t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        "supplier": t(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
    }


@query("SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS src FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def union_all(spark, d):
    return R.union_frames(_parties(spark, d), "src")


@query("SELECT 'customer' AS source, count(*) AS n_rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def union_source_counts(spark, d):
    return R.source_counts(_parties(spark, d))


@query("SELECT text, lang, min(doc_id) AS record_index, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_rows FROM documents GROUP BY text, lang HAVING count(*) > 1")
def union_duplicates(spark, d):
    out = R.duplicate_flags(t(spark, d, "documents").select("doc_id", "text", "lang", "source"), "source", "doc_id")
    return out.withColumn("sources", F.array_join("sources", ","))


# -- quality, contracts --------------------------------------------------------------------------------------------

@query(" UNION ALL ".join(f"SELECT '{c}' AS field_name, count(*) - count({c}) AS null_count, count(*) AS total_count, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM joined_case_output" for c in ("case_id", "subject", "ticket_type", "matched_category", "matched_article_count", "source_system")))
def dq_null_rates(spark, d):
    return Q.null_rates(t(spark, d, "joined_case_output").select(*support.OUTPUT)).withColumn("null_rate", F.round("null_rate", 6))


@query("SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_rate FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
def dq_duplicates(spark, d):
    return Q.duplicate_rate(t(spark, d, "documents"), ["text", "lang"]).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query("SELECT ticket_type AS value, count(*) AS n FROM joined_case_output GROUP BY 1")
def dq_frequency(spark, d):
    return Q.value_frequencies(t(spark, d, "joined_case_output"), "ticket_type", None)


@query("SELECT ticket_type AS value, count(*) AS n FROM joined_case_output GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 30")
def dq_most_common(spark, d):
    return Q.value_frequencies(t(spark, d, "joined_case_output"), "ticket_type")


@query("SELECT case_id AS key_value, count(*) AS n FROM joined_case_output GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, d):
    return Q.repeated_keys(t(spark, d, "joined_case_output"), "case_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field_name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL OR {c} = '') / count(*), 6) AS empty_pct FROM documents" for c in ("text", "lang", "source", "account_id")))
def empty_pct(spark, d):
    return Q.empty_percentages(t(spark, d, "documents").select("text", "lang", "source", "account_id")).withColumn("empty_pct", F.round("empty_pct", 6))


@query("SELECT * FROM (VALUES ('rogue_field', 'extra_field', NULL, 'Integer'), ('source_system', 'missing_field', 'String', NULL), ('matched_article_count', 'type_mismatch', 'Integer', 'String')) v(field_name, kind, expected, actual)")
def dq_drift(spark, d):
    df = t(spark, d, "joined_case_output").select("case_id", "subject", "ticket_type", "matched_category", F.col("matched_article_count").cast("string").alias("matched_article_count"), F.lit(1).alias("rogue_field"))
    return Q.drift_frame(spark, Q.schema_drift(df, SCHEMAS["JoinedCaseOutput"]))


@query("SELECT * FROM (VALUES ('o_orderkey', 'Integer'), ('o_totalprice', 'Double'), ('o_orderdate', 'Timestamp'), ('o_orderstatus', 'String')) v(field_name, type_name)")
def dq_dominant_types(spark, d):
    return Q.dominant_types(t(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")]))


_CONTRACT = Schema("OrderOutput", (Field("id", "String", False, True), Field("status", "String", False, True), Field("priority", "String")), "id")


def _contract_rows(spark, d) -> DataFrame:
    return t(spark, d, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % 1000 % 2).cast("string").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))


_CONTRACT_SQL = "(SELECT (o_orderkey - o_orderkey % 1000 % 2)::VARCHAR AS id, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)"


@query(f"""SELECT k AS kind, 'status' AS field_name, count(*) AS n_rows FROM {_CONTRACT_SQL}, (VALUES ('missing_required'), ('null_violation')) v(k) WHERE status IS NULL GROUP BY 1 HAVING count(*) > 0
UNION ALL SELECT 'duplicate_key', 'id', count(*) FROM (SELECT id FROM {_CONTRACT_SQL} GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0""")
def contract_violations(spark, d):
    return Q.contract_violations(_contract_rows(spark, d), _CONTRACT)


@query(f"SELECT 'id' AS field_name, count(*) = count(id) AS satisfied FROM {_CONTRACT_SQL} UNION ALL SELECT 'status', count(*) = count(status) FROM {_CONTRACT_SQL}")
def required_status(spark, d):
    return Q.required_status(_contract_rows(spark, d), _CONTRACT)


@query("""SELECT record_index, CASE WHEN e = '' THEN 'ok' ELSE e END AS errors FROM (SELECT record_index, concat_ws('; ',
 CASE WHEN case_id IS NULL THEN 'case_id: missing_required' END, CASE WHEN case_id IS NULL THEN 'case_id: null_violation' END,
 CASE WHEN subject IS NULL THEN 'subject: missing_required' END, CASE WHEN subject IS NULL THEN 'subject: null_violation' END,
 CASE WHEN matched_article_count IS NULL THEN 'matched_article_count: missing_required' END, CASE WHEN matched_article_count IS NULL THEN 'matched_article_count: null_violation' END,
 CASE WHEN source_system IS NULL THEN 'source_system: missing_required' END, CASE WHEN source_system IS NULL THEN 'source_system: null_violation' END) AS e FROM joined_case_output)""")
def quarantine_split(spark, d):
    good, bad = Q.split_valid(t(spark, d, "joined_case_output"), SCHEMAS["JoinedCaseOutput"])
    return good.select("record_index", F.lit("ok").alias("errors")).unionByName(bad.select("record_index", F.array_join("errors", "; ").alias("errors")))


# -- incremental ---------------------------------------------------------------------------------------------------

@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p > 4999")
def cdc_by_index(spark, d):
    store = N.MarkStore()
    store.update("events", 0, last_seen_index=4999)
    return N.read_by_index(C.with_position(t(spark, d, "events").select("event_id"), "_ord", "event_id"), store, "events")[0].select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def cdc_by_timestamp(spark, d):
    e = t(spark, d, "events")
    store = N.MarkStore()
    store.update("events", 0, last_seen_timestamp=str(e.agg(F.min("ts") + F.expr("INTERVAL 3 DAY")).first()[0]))
    return N.read_by_timestamp(e, store, "events", "ts")[0].select("event_id")


@query("SELECT event_id FROM events WHERE event_id > 7000")
def cdc_by_id(spark, d):
    store = N.MarkStore()
    store.update("events", 0, last_seen_id="7000")
    return N.read_by_id(t(spark, d, "events"), store, "events", "event_id")[0].select("event_id")


def _work(spark: SparkSession, name: str) -> str:
    from millrace.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/millrace-{name}"


@query("SELECT event_id, event_type FROM events")
def cdc_stream_available_now(spark, d):
    import uuid

    at = _work(spark, f"stream-{uuid.uuid4().hex}")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    for _ in range(2):  # the second run finds nothing new
        ST.ingest_available(spark, d, schema, f"{at}/out", f"{at}/marks", pattern="events.parquet")
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    return ST.windowed_counts(t(spark, d, "events"), "ts", "event_type")


# -- inference -----------------------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES ('flag', 'Boolean'), ('whole', 'Integer'), ('broken', 'Double'), ('at', 'Timestamp'), ('word', 'String'), ('none', 'String')) v(field_name, type_name)")
def infer_types(spark, d):
    o = t(spark, d, "orders")
    return I.infer_types(o.select((F.col("o_orderkey") % 2).cast("string").alias("flag"), F.col("o_custkey").cast("string").alias("whole"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("broken"), F.col("o_orderdate").cast("string").alias("at"), F.col("o_orderpriority").alias("word"), F.lit("").alias("none")))


@query("SELECT 'l_partkey' AS field_name, count(*) AS n_values, count(DISTINCT l_partkey) AS n_distinct, round(count(DISTINCT l_partkey) / count(*), 6) AS ratio FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), count(DISTINCT l_returnflag), round(count(DISTINCT l_returnflag) / count(*), 6) FROM lineitem")
def join_uniqueness(spark, d):
    return I.uniqueness(t(spark, d, "lineitem"), ["l_partkey", "l_returnflag"]).withColumn("ratio", F.round("ratio", 6))


@query("SELECT count(*) AS n_left, count(*) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)) AS n_found, round(count(*) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)) / count(*), 6) AS ratio FROM lineitem")
def join_overlap(spark, d):
    return I.overlap(t(spark, d, "lineitem"), "l_partkey", t(spark, d, "part").filter("p_size > 20"), "p_partkey").withColumn("ratio", F.round("ratio", 6))


@query("""SELECT 'l_partkey' AS l, 'p_partkey' AS r, round(0.2 + 0.3 * o + 0.35 * 1.0, 3) AS confidence, true AS is_unique_key FROM (SELECT count(*) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part)) / count(*) AS o FROM lineitem)
UNION ALL SELECT 'l_partkey', 'p_size', round(0.2 + 0.3 * o + 0.35 * u, 3), u >= 0.95 FROM (SELECT (SELECT count(*) FILTER (WHERE l_partkey IN (SELECT p_size FROM part)) / count(*) FROM lineitem) AS o, (SELECT count(DISTINCT p_size) / count(*) FROM part) AS u)""")
def join_scores(spark, d):
    found = I.infer_joins(t(spark, d, "lineitem"), ["l_partkey"], t(spark, d, "part"), ["p_partkey", "p_size"])
    return spark.createDataFrame([(f["left"], f["right"], f["confidence"], f["is_unique_key"]) for f in found], "l string, r string, confidence double, is_unique_key boolean")


_LOOKS = "(SELECT CASE WHEN bool_or(({0} LIKE '%-%' AND {0} LIKE '%:%') OR regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) THEN 'Timestamp' ELSE 'String' END FROM joined_case_output)"


@query(f"""SELECT * FROM (VALUES ('case_id', 'case_id', {_LOOKS.format("case_id")}, 1.0::DOUBLE, 'auto'), ('title_subject', 'subject', {_LOOKS.format("subject")}, 0.932, 'auto'),
 ('article count', 'matched_article_count', 'Integer', 0.932, 'auto')) v(source_field, target_field, source_type, confidence, route)""")
def mapping_scores(spark, d):
    df = t(spark, d, "joined_case_output").select("case_id", F.col("subject").alias("title_subject"), F.col("matched_article_count").alias("article count"))
    found = I.infer_mappings(df, SCHEMAS["JoinedCaseOutput"])
    return spark.createDataFrame([(f["source_field"], f["target_field"], f["source_type"], f["confidence"], f["route"]) for f in found], "source_field string, target_field string, source_type string, confidence double, route string")


@query("SELECT * FROM (VALUES ('support_tickets', 0.457), ('support_activity_api', 0.12)) v(source, confidence)")
def source_scores(spark, d):
    found = I.identify_sources("refund tickets from support_tickets", support.CATALOG)
    return spark.createDataFrame([(f["source"], f["confidence"]) for f in found], "source string, confidence double")


@query("""SELECT * FROM (VALUES ('actor', 'Map', 'trim_whitespace', 1.0::DOUBLE, 'auto'), ('received', 'Map', 'trim_whitespace', 0.94, 'auto'), ('received', 'Map', 'parse_timestamp', 0.94, 'auto'))
 v(field, op, transform, confidence, route)""")
def transform_suggestions(spark, d):
    df = t(spark, d, "security_audit_log").select("actor", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"))
    found = I.infer_transforms("please clean the actor column", df)
    return spark.createDataFrame([(f["field"], f["op"], f.get("transform"), f["confidence"], f["route"]) for f in found], "field string, op string, transform string, confidence double, route string")


# -- monitoring, security, ontology, plans -------------------------------------------------------------------------

def _runs(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("pipeline"), F.when(F.col("event_type") == "error", "validation_failed").otherwise("success").alias("status"), F.col("ts").alias("at"), "event_id", F.col("value").alias("seconds"), F.col("event_id").alias("rows"))


_RUNS = "(SELECT user_id::VARCHAR AS pipeline, CASE WHEN event_type = 'error' THEN 'validation_failed' ELSE 'success' END AS status, ts AS \"at\", event_id, value AS seconds, event_id AS \"rows\" FROM events)"


@query(f"""SELECT pipeline, count(*) AS total_runs, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status <> 'success') AS failures,
 round(count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate, round(avg(seconds), 4) AS avg_seconds, round(avg("rows") FILTER (WHERE status = 'success'), 4) AS avg_rows,
 arg_max(status, ("at", status, "rows")) AS latest_status, arg_max("rows", ("at", status, "rows")) AS latest_rows FROM {_RUNS} GROUP BY 1""")
def run_health_trend(spark, d):
    return Q.run_trends(_runs(spark, d)).withColumns({"success_rate": F.round("success_rate", 6), "avg_seconds": F.round("avg_seconds", 4), "avg_rows": F.round("avg_rows", 4)})


@query(f"""SELECT event_id AS run_id, pipeline, CASE WHEN status <> 'success' THEN 'run_failure' ELSE 'sla_breach' END AS kind, CASE WHEN status <> 'success' THEN 'critical' ELSE 'warning' END AS severity
FROM {_RUNS} WHERE (status <> 'success' OR (seconds > 50 AND pipeline::BIGINT % 2 = 0)) AND NOT (status <> 'success' AND event_id % 10 = 0)""")
def sla_alerts(spark, d):
    runs = _runs(spark, d).withColumnRenamed("event_id", "run_id")
    limits = runs.select("pipeline").distinct().filter("cast(pipeline AS bigint) % 2 = 0").withColumn("limit_s", F.lit(50.0))
    seen = runs.filter("run_id % 10 = 0").select("run_id", F.lit("run_failure").alias("kind"))
    return Q.run_alerts(runs, limits, seen)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id % 1000) + 0.25 END AS seconds FROM events")
def run_durations(spark, d):
    k = F.col("event_id")
    end = F.when(k % 5 == 0, "soon").otherwise((F.col("ts") + F.make_dt_interval(secs=(k % 1000).cast("decimal(18,6)") + F.lit(0.25).cast("decimal(18,6)"))).cast("string"))
    return t(spark, d, "events").select("event_id", Q.duration_seconds(F.col("ts").cast("string"), end).alias("seconds"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS "at", o_orderkey AS records, 'out/' || o_orderkey || '.json' AS path, o_orderkey % 2 = 0 AS approved,
 CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_orderkey END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'user' || o_custkey END AS deployed_by FROM orders WHERE o_orderkey % 7 <> 0""")
def deploy_log_parse(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | Deployed "), k, F.lit(" records to out/"), k, F.lit(".json | approved="), F.when(k % 2 == 0, "True").otherwise("False"), F.when(k % 3 == 0, F.concat(F.lit(" | version=v"), k, F.lit(" | deployed_by=user"), "o_custkey")).otherwise(""))
    return Q.parse_deploy_log(t(spark, d, "orders").select(F.when(k % 7 == 0, "noise").otherwise(line).alias("value")))


@query("SELECT action, count(*) AS n_events, count(*) FILTER (WHERE NOT success) AS n_failed, count(DISTINCT actor) AS n_actors FROM security_audit_log GROUP BY 1")
def audit_by_action(spark, d):
    return S.audit_summary(t(spark, d, "security_audit_log"))


@query("SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer")
def mask_nullify(spark, d):
    columns = S.ColumnSecurity(S.AccessControl("root"), {"Customer": {"c_acctbal"}})
    return columns.view(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "guest", "Customer")


@query("SELECT c_custkey, c_name FROM customer")
def mask_remove(spark, d):
    columns = S.ColumnSecurity(S.AccessControl("root"), {"Customer": {"c_acctbal"}})
    return columns.view(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "guest", "Customer", remove=True)


_CASE_TYPE = O.ObjectType("SupportCase", SCHEMAS["SupportCase"], "case_id")


@query("SELECT 'SupportCase' AS object_type, case_id AS identity, subject FROM (SELECT CASE WHEN record_index % 9 <> 0 THEN case_id END AS case_id, subject FROM joined_case_output) WHERE case_id IS NOT NULL")
def ontology_instances(spark, d):
    rows = t(spark, d, "joined_case_output").select(F.when(F.col("record_index") % 9 != 0, F.col("case_id")).alias("case_id"), "subject")
    return O.instances(rows, _CASE_TYPE).select("object_type", "identity", "record.subject")


@query("SELECT 'SupportCase' AS object_type, count(*) FILTER (WHERE record_index % 9 <> 0) AS mapped_count, count(*) FILTER (WHERE record_index % 9 = 0) AS unmapped_count FROM joined_case_output")
def ontology_counts(spark, d):
    rows = t(spark, d, "joined_case_output").select(F.when(F.col("record_index") % 9 != 0, F.col("case_id")).alias("case_id"))
    return O.instance_counts(rows, _CASE_TYPE)


def _two_plans() -> tuple[Pipeline, Pipeline]:
    old = Pipeline("p", [Source("a", "parquet", "a"), Source("b", "parquet", "b")], [Union("u", ["a", "b"]), Join("j", "a", "b", [JoinKey("k", "k", {"x": "ORDER"})])])
    new = old.copy()
    new.steps = [Filter("f", "a", "k == 'x'"), Join("j", "a", "b", [JoinKey("k", "k", {"x": "PRODUCT"})])]
    return old, new


@query("SELECT * FROM (VALUES ('added', 'f', 'Filter', ''), ('removed', 'u', 'Union', ''), ('modified', 'j', 'Join', 'on, on[0].mapping[x]')) v(kind, output, op, details)")
def ir_diff(spark, d):
    return diff_frame(spark, *_two_plans())


@query("""SELECT * FROM (VALUES ('n', 'Aggregate', 'n', 'joined', ''), ('n', 'Aggregate', 'r_name', 'joined', 'r_name'), ('joined', 'Join', 'n_name', 'nation', 'n_name'),
 ('joined', 'Join', 'n_regionkey', 'nation', 'n_regionkey'), ('joined', 'Join', 'n_nationkey', 'nation', 'n_nationkey'), ('joined', 'Join', 'r_regionkey', 'region', 'r_regionkey'), ('joined', 'Join', 'r_name', 'region', 'r_name'))
 v(output, op, output_field, input, input_fields)""")
def lineage_edges(spark, d):
    plan = Pipeline("x", [Source("nation", "parquet", f"{d}/nation.parquet"), Source("region", "parquet", f"{d}/region.parquet")], [
        Join("joined", "nation", "region", [JoinKey("n_regionkey", "r_regionkey")], shape="flat"), Aggregate("n", "joined", ["r_name"], [Aggregation("count", "*", "n")])])
    store = LineageStore()
    Compiler(spark).compile(plan, lineage=store)
    return store.frame(spark).select("output", "op", "output_field", "input", F.array_join("input_fields", ",").alias("input_fields"))


@query("SELECT * FROM (VALUES (0, 'unknown type ''Money'''), (1, 'unknown function ''median'''), (2, 'no dataset ''ghost'' before it')) v(step, error)")
def plan_check(spark, d):
    plan = Pipeline("bad", [Source("orders", "parquet", "x")], [Cast("c", "orders", "o_orderkey", "Money"), Aggregate("a", "orders", [], [Aggregation("median", "o_orderkey", "m")]), WindowStep("w", "ghost")])
    found = PlanChecker({"orders": t(spark, d, "orders").schema}).check(plan)
    return spark.createDataFrame([(int(e.split()[1]), e.split(": ", 1)[1]) for e in found.errors], "step int, error string")


# -- sources and sinks ---------------------------------------------------------------------------------------------

@query("SELECT p_partkey::VARCHAR AS id, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS text FROM part")
def csv_round_trip(spark, d):
    """Commas, quotes and line breaks inside fields survive; all columns come back as text."""
    import uuid

    at = _work(spark, f"csv-{uuid.uuid4().hex}")
    t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("text")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(at)
    return C.CONNECTORS.read(spark, Source("parts", "csv", at if "://" in at or at.startswith("file:") else at))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_round_trip(spark, d):
    """The array is written by the driver, to the shared folder, and read by the executors."""
    import uuid

    n = t(spark, d, "nation")
    at = _work(spark, f"json-{uuid.uuid4().hex}").removeprefix("file:")
    C.write_json_array(n, f"{at}/nation.json")
    return C.read_json_array(spark, f"{at}/nation.json", n.schema).select(*n.columns)


@query("SELECT * FROM (VALUES ('good', true, (SELECT count(*) FROM nation)), ('bad', false, 0), ('late', true, (SELECT count(*) FROM region))) v(name, success, n)")
def ingest_isolation(spark, d):
    def fail():
        raise ConnectionError("no route")

    run = C.ingest_all({"good": lambda: t(spark, d, "nation"), "bad": fail, "late": lambda: t(spark, d, "region")})
    return spark.createDataFrame([(r.name, r.success, r.count) for r in run.results], "name string, success boolean, n bigint")
