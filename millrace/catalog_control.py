"""Queries of the control plane and of further relational operators, each with SQL to hold it against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog_core import _CONTRACT, _CONTRACT_SQL, _RUNS, _chain, _chain_input, _contract_rows, _runs, _work, t
from millrace.control import ontology as O
from millrace.control import operations as OP
from millrace.control import security as S
from millrace.control.lineage import LineageStore
from millrace.control.review import suggest
from millrace.control.versioning import PlanRepository, diff_frame
from millrace.functions import transforms as X
from millrace.functions.types import SCHEMAS
from millrace.operators import infer as I
from millrace.operators import quality as Q
from millrace.operators import relational as R
from millrace.operators.temporal import asof_join, range_join
from millrace.pipelines import support
from millrace.plans.compile import Compiler
from millrace.plans.ir import Aggregate, Aggregation, Cast, Filter, Join, JoinKey, Map, Pipeline, SetStep, Source, Union, WindowStep
from millrace.service import Service
from millrace.sources import connectors as C
from millrace.sources import incremental as N
from millrace.streaming import incremental as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _plan(d: str, names: str, *steps) -> Pipeline:
    return Pipeline("p", [Source(n, "parquet", f"{d}/{n}.parquet") for n in names.split()], list(steps))


# -- mappers and chains --------------------------------------------------------------------------------------------

@query("""SELECT 'ticket_' || o_orderkey AS case_id, nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END, '') AS subject, o_orderpriority AS ticket_type,
 date_trunc('second', o_orderdate) AS created_at, 'support_tickets' AS source_system, NULL::VARCHAR AS resolution FROM orders""")
def map_ticket_cases(spark, d):
    k, empty = F.col("o_orderkey"), F.lit("")
    raw = t(spark, d, "orders").select(
        k.cast("string").alias("Ticket ID"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("Ticket Subject"), F.lit("d").alias("Ticket Description"), F.lit("Open").alias("Ticket Status"),
        F.lit("Low").alias("Ticket Priority"), F.lit("Email").alias("Ticket Channel"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("First Response Time"), empty.alias("Resolution"), F.col("o_orderpriority").alias("Ticket Type"),
    )
    return support.map_tickets(raw).select("case_id", "subject", "ticket_type", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "source_system", "resolution")


@query("""SELECT 'kb_' || (row_number() OVER (ORDER BY article_id) - 1) AS article_id, nullif(category, '') AS category, nullif(intent, '') AS intent, question, answer, 'kb_articles' AS source_system
 FROM knowledge_articles""")
def map_kb_articles(spark, d):
    raw = t(spark, d, "knowledge_articles").select("article_id", "category", F.coalesce("intent", F.lit("")).alias("intent"), F.col("question").alias("instruction"), F.col("answer").alias("response"))
    return support.map_articles(C.with_position(raw, "_ord", "article_id"))


@query("""SELECT i AS step, p_partkey, CASE WHEN i >= 0 THEN p_name END AS name, CASE WHEN i >= 1 AND p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS brand,
 CASE WHEN i >= 2 THEN 'part_' || p_partkey ELSE p_partkey::VARCHAR END AS id FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5), (VALUES (0), (1), (2)) v(i)""")
def chain_preview_all(spark, d):
    """The first five parts after each step."""
    rows = _chain_input(spark, d).withColumn("p_partkey", F.col("id").cast("bigint")).orderBy("p_partkey")
    out = None
    for i, (_, df) in enumerate(_chain().preview_all(rows, 5)):
        one = df.select(F.lit(i).alias("step"), "p_partkey", "name", "brand", "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'part_' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def chain_as_plan(spark, d):
    """The chain turned into plan steps, sent through JSON and compiled."""
    plan = Pipeline("chain", [Source("parts", "given", "")], _chain().plan_steps("parts", "clean"))
    return Compiler(spark).run(Pipeline.from_json(plan.to_json()), {"parts": _chain_input(spark, d)})


@query("SELECT event_id, upper(event_type) || '!' AS v FROM events")
def transform_registered(spark, d):
    registry = X.TransformRegistry()
    registry.register("shout", lambda c, mark="!": F.concat(F.upper(c), F.lit(mark)))
    plan = Pipeline("p", [Source("events", "given", "")], [Map("out", "events", transform="shout", field="v", params={"mark": "!"})])
    return Compiler(spark, transforms=registry).run(plan, {"events": t(spark, d, "events").select("event_id", F.col("event_type").alias("v"))})


@query(r"SELECT p_partkey, regexp_replace(lower(p_type || ' - ' || p_brand || '_x'), '[\s_\-]+', '', 'g') AS v FROM part")
def name_normalized(spark, d):
    return t(spark, d, "part").select("p_partkey", X.normalize_name(F.concat("p_type", F.lit(" - "), "p_brand", F.lit("_x"))).alias("v"))


@query("SELECT ticket_type, CASE ticket_type WHEN 'Refund request' THEN 'REFUND' WHEN 'Cancellation request' THEN 'CANCEL' WHEN 'Billing inquiry' THEN 'PAYMENT' WHEN 'Product inquiry' THEN 'ORDER' WHEN 'Technical issue' THEN 'CONTACT' END AS category FROM ticket_type_map")
def mapping_table(spark, d):
    return t(spark, d, "ticket_type_map").select("ticket_type", X.lookup(F.col("ticket_type"), support.TICKET_CATEGORY).alias("category"))


@query("SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS v FROM orders")
def rows_as_json(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus"), {"ignoreNullFields": "false"}).alias("v"))


# -- plan steps ----------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer")
def plan_first_match(spark, d):
    plan = _plan(d, "customer orders", Join("j", "customer", "orders", [JoinKey("c_custkey", "o_custkey")], one_to_many=False, order_by="o_orderkey"))
    return Compiler(spark).run(plan).select("record.c_custkey", F.col("matched.o_orderkey").alias("first_order"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS n FROM orders")
def plan_window_tie(spark, d):
    return Compiler(spark).run(_plan(d, "orders", WindowStep("w", "orders", ["o_orderstatus"], ["o_orderdate"], alias="n", tie="o_orderkey"))).select("o_orderkey", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def plan_semi_join(spark, d):
    return Compiler(spark).run(_plan(d, "customer orders", Join("j", "customer", "orders", [JoinKey("c_custkey", "o_custkey")], "semi", shape="flat"))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def plan_anti_join(spark, d):
    return Compiler(spark).run(_plan(d, "customer orders", Join("j", "customer", "orders", [JoinKey("c_custkey", "o_custkey")], "anti", shape="flat"))).select("c_custkey")


def _keys(spark, d) -> dict[str, DataFrame]:
    li = t(spark, d, "lineitem")
    return {"a": li.select(F.col("l_partkey").alias("k"), F.nullif("l_returnflag", F.lit("N")).alias("f")), "b": li.filter("l_quantity > 30").select(F.nullif("l_returnflag", F.lit("N")).alias("f"), F.col("l_partkey").alias("k"))}


_AB = "(SELECT l_partkey AS k, nullif(l_returnflag, 'N') AS f FROM lineitem) {op} (SELECT l_partkey, nullif(l_returnflag, 'N') FROM lineitem WHERE l_quantity > 30)"


def _set_query(kind: str, every: bool):
    def run(spark, d):
        plan = Pipeline("p", [Source("a", "given", ""), Source("b", "given", "")], [SetStep("s", ["a", "b"], kind, every)])
        return Compiler(spark).run(Pipeline.from_json(plan.to_json()), _keys(spark, d))

    run.__name__ = f"set_{kind}{'_all' * every}"
    return query(_AB.format(op=kind.upper() + " ALL" * every))(run)


for _kind in ("intersect", "except"):
    for _every in (False, True):
        _set_query(_kind, _every)


@query("SELECT DISTINCT l_partkey AS k, nullif(l_returnflag, 'N') AS f FROM lineitem")
def set_distinct(spark, d):
    return Compiler(spark).run(Pipeline("p", [Source("a", "given", "")], [SetStep("s", ["a"])]), {"a": _keys(spark, d)["a"]})


def _grouped(spark, d, grouping) -> DataFrame:
    plan = _plan(d, "lineitem", Aggregate("g", "lineitem", ["l_returnflag", "l_linestatus"], [Aggregation("sum", "l_quantity", "q"), Aggregation("count", "*", "n")], grouping))
    return Compiler(spark).run(Pipeline.from_json(plan.to_json())).withColumn("grouping_id", F.col("grouping_id").cast("bigint"))


_GROUPED = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS grouping_id FROM lineitem GROUP BY "


@query(_GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return _grouped(spark, d, "rollup")


@query(_GROUPED + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return _grouped(spark, d, "cube")


@query(_GROUPED + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))")
def agg_grouping_sets(spark, d):
    return _grouped(spark, d, [["l_returnflag", "l_linestatus"], ["l_linestatus"]])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, true AS near FROM lineitem GROUP BY 1")
def agg_distinct(spark, d):
    """Exact distinct counts, and whether the sketch is within 15 % of them (its error is 5 % by one standard deviation)."""
    plan = _plan(d, "lineitem", Aggregate("g", "lineitem", ["l_returnflag"], [Aggregation("count_distinct", "l_partkey", "parts"), Aggregation("count_distinct", "l_suppkey", "suppliers"), Aggregation("approx_distinct", "l_partkey", "a")]))
    return Compiler(spark).run(plan).select("l_returnflag", "parts", "suppliers", (F.abs(F.col("a") - F.col("parts")) <= 0.15 * F.col("parts")).alias("near"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
def window_range_frame(spark, d):
    plan = _plan(d, "orders", WindowStep("w", "orders", ["o_custkey"], ["o_orderkey"], "sum", "s", "o_totalprice", frame=[-1000, 0], frame_kind="range"))
    return Compiler(spark).run(Pipeline.from_json(plan.to_json())).select("o_orderkey", F.round("s", 2).alias("s"))


@query("""SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price, round(percent_rank() OVER v, 6) AS p, round(cume_dist() OVER v, 6) AS c FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)""")
def window_first_last_shares(spark, d):
    o = t(spark, d, "orders")
    for name, alias in (("first", "first_price"), ("last", "last_price")):
        o = R.window_column(o, name, alias, ["o_custkey"], ["o_orderkey"], "o_totalprice", descending=True)
    for name, alias in (("percent_rank", "p"), ("cume_dist", "c")):
        o = R.window_column(o, name, alias, ["o_orderpriority"], ["o_totalprice"], descending=True)
    return o.select("o_orderkey", "first_price", "last_price", F.round("p", 6).alias("p"), F.round("c", 6).alias("c"))


# -- joins by time -------------------------------------------------------------------------------------------------

@query("""SELECT p.event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def join_asof(spark, d):
    """Each purchase with the user's latest error at or before it."""
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = asof_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), [("user_id", "user_id")], "ts", "ts", tie="event_id")
    return out.select("event_id", F.col("matched.event_id").alias("error_id"))


@query("""SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(e.ts) <= 3600000000 THEN e.event_id END AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def join_asof_tolerance(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = asof_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), [("user_id", "user_id")], "ts", "ts", chunk=21_600_000_000, tolerance=3_600_000_000, tie="event_id")
    return out.select("event_id", F.col("matched.event_id").alias("error_id"))


_SEASONS = "(SELECT n_nationkey, TIMESTAMP '1992-01-01' + n_nationkey * INTERVAL 90 DAY AS s, TIMESTAMP '1992-01-01' + n_nationkey * INTERVAL 90 DAY + (n_nationkey % 5) * INTERVAL 40 DAY AS e FROM nation)"


def _seasons(spark, d) -> DataFrame:
    day = lambda n: F.make_dt_interval(days=n.cast("int"))
    start = F.lit("1992-01-01").cast("timestamp_ntz") + day(F.col("n_nationkey") * 90)
    return t(spark, d, "nation").select("n_nationkey", start.alias("s"), (start + day(F.col("n_nationkey") % 5 * 40)).alias("e"))


@query(f"SELECT o_orderkey, n_nationkey FROM orders JOIN {_SEASONS} ON o_orderdate BETWEEN s AND e")
def join_range(spark, d):
    return range_join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), _seasons(spark, d), "o_orderdate", "s", "e", 86_400_000_000).select("o_orderkey", "n_nationkey")


@query(f"SELECT o_orderkey, n_nationkey FROM orders LEFT JOIN {_SEASONS} ON o_orderdate BETWEEN s AND e")
def join_range_left(spark, d):
    return range_join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), _seasons(spark, d), "o_orderdate", "s", "e", 86_400_000_000, "left").select("o_orderkey", "n_nationkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey < r_regionkey")
def join_theta(spark, d):
    """A condition without an equality, by SQL text over a plan's datasets (25 x 5 rows)."""
    s = Service(spark, _plan(d, "nation region", Filter("output_rows", "nation", "n_nationkey >= 0")))
    s.run_pipeline()
    return s.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")


# -- quality, contracts, marks -------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES ('supplier against customer: missing [''c_name''], extra [''phone'']')) v(error)")
def union_check(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return spark.createDataFrame([(e,) for e in R.check_union({"customer": c, "supplier": c.withColumnRenamed("c_name", "phone")})], "error string")


@query("SELECT 'breaking change: required column ''priority'' was dropped' AS warning")
def dropped_required(spark, d):
    from millrace.functions.types import Field, Schema

    before = Schema("OrderOutput", (*_CONTRACT.fields[:2], Field("priority", "String", True, True)), "id")
    after = Schema("OrderOutput", _CONTRACT.fields[:2], "id")
    return spark.createDataFrame([(w,) for w in Q.check_contract(_contract_rows(spark, d), after, previous=before).warnings], "warning string")


@query(f"""SELECT 'missing_required status: ' || count(*) AS reason FROM {_CONTRACT_SQL} WHERE status IS NULL UNION ALL SELECT 'null_violation status: ' || count(*) FROM {_CONTRACT_SQL} WHERE status IS NULL
 UNION ALL SELECT 'duplicate_key id: ' || count(*) FROM (SELECT id FROM {_CONTRACT_SQL} GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT '3 rows failed to build'""")
def safe_to_deploy(spark, d):
    safe, reasons = Q.safe_to_deploy(3, Q.check_contract(_contract_rows(spark, d), _CONTRACT))
    return spark.createDataFrame([(r,) for r in reasons if not safe], "reason string")


@query("SELECT 'events' AS source_name, max(event_id)::VARCHAR AS last_seen_id, count(*) AS total_processed FROM events")
def mark_store(spark, d):
    """Two loads by id: everything up to 7000, then the rest; the mark moves after each write only."""
    e, store = t(spark, d, "events").select("event_id"), N.MarkStore()
    at = _work(spark, f"marks-{uuid.uuid4().hex}")
    for part in (e.filter("event_id <= 7000"), e):
        mark = N.load_new(N.read_by_id, part, store, "events", "event_id", lambda df: df.write.mode("append").parquet(at))
    assert spark.read.parquet(at).count() == mark.total_processed
    return spark.createDataFrame([(m["source_name"], m["last_seen_id"], m["total_processed"]) for m in store.summary().values()], "source_name string, last_seen_id string, total_processed bigint")


@query("SELECT least(200, count(*)) AS written, least(200, count(*)) AS read_back FROM orders")
def sample_to_file(spark, d):
    path = _work(spark, f"sample-{uuid.uuid4().hex}").removeprefix("file:") + "/sample.json"
    n = C.sample_to_file(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    return C.read_json_array(spark, path).agg(F.lit(n).cast("bigint").alias("written"), F.count(F.lit(1)).alias("read_back"))


@query(f"SELECT pipeline, string_agg(event_id || ':' || \"rows\", ',' ORDER BY \"at\", event_id) AS record_counts, count(*)::INTEGER AS n FROM {_RUNS} GROUP BY 1")
def run_histories(spark, d):
    h = Q.run_histories(_runs(spark, d), run_id="event_id")
    text = F.transform("record_count_history", lambda x: F.concat(x["run_id"].cast("string"), F.lit(":"), x["record_count"].cast("string")))
    return h.select("pipeline", F.array_join(text, ",").alias("record_counts"), F.size("duration_history").alias("n"))


@query("SELECT 'run_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS run_id, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)")
def run_numbers(spark, d):
    return Q.numbered_runs(t(spark, d, "events").select("event_id"), "event_id")


@query("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_matches(spark, d):
    return t(spark, d, "events").filter(OP.Cron("*/15 9-17 * * 1-5").column(F.col("ts"))).select("event_id")


@query("SELECT event_type AS \"key\", time_bucket(INTERVAL 1 HOUR, ts - k * INTERVAL 30 MINUTE, TIMESTAMP '2000-01-01 00:30:00' - (1 - k) * INTERVAL 30 MINUTE) AS window_start, 0 AS x FROM events, (VALUES (0)) v(k) WHERE 1 = 0")
def window_sliding_empty(spark, d):
    """Sliding windows over no events."""
    out = ST.windowed_counts(t(spark, d, "events").filter("1 = 0"), "ts", "event_type", "1 hour", "30 minutes")
    return out.select(F.col("event_type").alias("key"), "window_start", F.lit(0).alias("x"))


@query("""SELECT event_type, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n_events FROM (
 SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2""")
def window_sliding(spark, d):
    return ST.windowed_counts(t(spark, d, "events"), "ts", "event_type", "1 hour", "30 minutes")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
 SELECT user_id, min(ts) AS started_at, count(*) AS n_events FROM g GROUP BY user_id, s""")
def session_windows(spark, d):
    return ST.session_counts(t(spark, d, "events"), "ts", "user_id")


# -- inference and review ------------------------------------------------------------------------------------------

@query("""SELECT 'o_orderstatus' AS source_field, 'status' AS target_field, round(0.45 * 0.85 + 0.3 + 0.25 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) / count(*), 3) AS confidence FROM orders""")
def mapping_domains(spark, d):
    """A mapping scored by how many of the values lie in the target's domain."""
    from millrace.functions.types import Field, Schema

    found = I.infer_mappings(t(spark, d, "orders").select("o_orderstatus"), Schema("S", (Field("status", "String"),)), {"status": ["F", "O"]})
    return spark.createDataFrame([(f["source_field"], f["target_field"], f["confidence"]) for f in found], "source_field string, target_field string, confidence double")


@query("SELECT * FROM (VALUES ('Case-ID', 'case_id', 1.0), ('title_subject', 'subject', 0.85), ('first name', 'name last', 0.333333), ('', '', 1.0), ('abcd', 'bcda', 0.75)) v(a, b, s)")
def name_scores(spark, d):
    pairs = [("Case-ID", "case_id"), ("title_subject", "subject"), ("first name", "name last"), ("", ""), ("abcd", "bcda")]
    return spark.createDataFrame([(a, b, round(I.name_similarity(a, b), 6)) for a, b in pairs], "a string, b string, s double")


@query("SELECT * FROM (VALUES ('source', 0.1, 'auto'), ('join', 0.99, 'review'), ('mapping', 0.85, 'auto'), ('mapping', 0.84, 'review'), ('transform', 0.9, 'auto')) v(kind, confidence, route)")
def proposal_routes(spark, d):
    return spark.createDataFrame([(k, c, I.route(k, c)) for k, c in (("source", 0.1), ("join", 0.99), ("mapping", 0.85), ("mapping", 0.84), ("transform", 0.9))], "kind string, confidence double, route string")


def _suggested(spark, d):
    frames = {"lineitem": t(spark, d, "lineitem").select("l_partkey"), "part": t(spark, d, "part").select("p_partkey")}
    return suggest("join support_tickets", support.CATALOG, frames, joins=[("lineitem", ["l_partkey"], "part", ["p_partkey"])])


@query("""SELECT 'source' AS kind, 'approved' AS status, NULL::DOUBLE AS confidence UNION ALL SELECT 'source', 'approved', NULL
 UNION ALL SELECT 'join', 'pending', round(0.2 + 0.35 + 0.3 * count(*) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part)) / count(*), 3) FROM lineitem""")
def orchestrated(spark, d):
    """What a request yields: sources go ahead, the join waits, with its confidence."""
    gate = _suggested(spark, d)
    return spark.createDataFrame([(s.kind, s.status, s.confidence if s.kind == "join" else None) for s in gate.items], "kind string, status string, confidence double")


@query("SELECT * FROM (VALUES (1, 'approved', 'bob', 'approved'), (0, 'no open', NULL, NULL)) v(n, status, reviewer, step)")
def review_gate(spark, d):
    gate = _suggested(spark, d)
    (index, _), = gate.pending()
    s = gate.approve(index, "bob")
    rows = [(len(gate.approved_steps()), s.status, s.reviewer, s.step.review_status), (len(gate.pending()), "no open", None, None)]
    return spark.createDataFrame(rows, "n int, status string, reviewer string, step string")


@query("SELECT * FROM (VALUES ('l_orderkey and o_orderkey have different types', 1), ('the join hasn''t been reviewed', 1)) v(warning, n)")
def check_join(spark, d):
    from millrace.plans.check import PlanChecker

    o = t(spark, d, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    plan = Pipeline("p", [Source("lineitem", "given", ""), Source("orders", "given", "")], [Join("j", "lineitem", "orders", [JoinKey("l_orderkey", "o_orderkey")], review_status="unreviewed")])
    found = PlanChecker({"lineitem": t(spark, d, "lineitem").schema, "orders": o.schema}).check(plan)
    return spark.createDataFrame([(w.split(": ")[1], 1) for w in found.warnings], "warning string, n int")


# -- lineage, ontology, versions -----------------------------------------------------------------------------------

def _traced(spark, d) -> LineageStore:
    plan = _plan(d, "nation region", Cast("n", "nation", "n_regionkey", "String"), Union("u", ["n", "n"]), Join("j", "u", "region", [JoinKey("n_regionkey", "r_regionkey")], shape="flat", confidence=0.7, review_status="approved"))
    store = LineageStore()
    Compiler(spark).compile(plan, lineage=store)
    return store


@query("SELECT * FROM (VALUES (0, 'j.n_regionkey <- Join(u: n_regionkey) on n_regionkey = r_regionkey'), (1, 'u.n_regionkey <- Union(n: n_regionkey)'), (2, 'u.n_regionkey <- Union(n: n_regionkey)'), (3, 'n.n_regionkey <- Cast(nation: n_regionkey)')) v(i, line)")
def lineage_explain(spark, d):
    return spark.createDataFrame(list(enumerate(_traced(spark, d).explain("j", "n_regionkey"))), "i int, line string")


@query("SELECT * FROM (VALUES ('j', 'n_name', 'nation', 'n_name', true, 0.7), ('j', 'r_name', 'region', 'r_name', true, 0.7), ('n', 'n_name', 'nation', 'n_name', false, NULL)) v(dataset, field, source, source_field, inferred, confidence)")
def lineage_sources(spark, d):
    store = _traced(spark, d)
    rows = [(o, f, *x, store.inferred(o, f), store.confidence(o, f)) for o, f in (("j", "n_name"), ("j", "r_name"), ("n", "n_name")) for x in store.source_fields(o, f)]
    return spark.createDataFrame(rows, "dataset string, field string, source string, source_field string, inferred boolean, confidence double")


@query("SELECT * FROM (VALUES ('Cast', 3), ('Union', 6), ('Join', 5)) v(op, n)")
def lineage_summary(spark, d):
    """Edges by operator: the nation's three columns of the cast, twice as many of the union of two, and with the region's two the join's."""
    return spark.createDataFrame(list(_traced(spark, d).summary()["by_operator"].items()), "op string, n bigint")


@query("SELECT * FROM (VALUES ('by_dataset', 5, 'lineage_0009'), ('by_field', 1, 'lineage_0009'), ('by_operator', 6, 'lineage_0003')) v(question, n, first_id)")
def lineage_store(spark, d):
    s = _traced(spark, d)
    found = {"by_dataset": s.by_dataset("j"), "by_field": s.by_field("j", s.by_dataset("j")[0].output_field), "by_operator": s.by_operator("Union")}
    return spark.createDataFrame([(k, len(v), v[0].record_id) for k, v in found.items()], "question string, n int, first_id string")


@query("SELECT * FROM (VALUES ('SupportCase', 'KnowledgeArticle', 'ticket_type', 'category', 'one_to_many')) v(left_type, right_type, left_key, right_key, kind)")
def ontology_relationships(spark, d):
    plan = support.support_plan()
    found = O.relationships(plan, {s.name: s.schema_name for s in plan.sources})
    return spark.createDataFrame([(r["from"], r["to"], r["left_key"], r["right_key"], r["kind"]) for r in found], "left_type string, right_type string, left_key string, right_key string, kind string")


@query("SELECT * FROM (VALUES ('Customer', 'customer_id'), ('KnowledgeArticle', 'article_id'), ('Product', 'product_variation_id'), ('SupportCase', 'case_id'), ('Transaction', 'transaction_id')) v(name, identity)")
def ontology_types(spark, d):
    types = O.ObjectTypes()
    return spark.createDataFrame([(n, types.get(n).identity) for n in types.names()], "name string, identity string")


@query("SELECT * FROM (VALUES ('modified', 'orders', 'Source', 'location'), ('added', 'part', 'Source', ''), ('modified', 'f', 'Filter', 'condition')) v(kind, output, op, details)")
def plan_source_diff(spark, d):
    """A branch that reads elsewhere shows it."""
    old = Pipeline("p", [Source("orders", "parquet", "a")], [Filter("f", "orders", "x == '1'")])
    new = Pipeline("p", [Source("orders", "parquet", "b"), Source("part", "parquet", "c")], [Filter("f", "orders", "x == '2'")])
    return diff_frame(spark, old, new)


@query("SELECT * FROM (VALUES (1, 'first version', 'P'), (2, 'merge of proposal_0001', 'F'), (3, 'rollback to 1', 'P')) v(version, note, wanted)")
def plan_versions(spark, d):
    """A branch, its proposal reviewed and merged, and a rollback: which orders Main asks for in each version."""
    repo = PlanRepository(_plan(d, "orders", Filter("f", "orders", "o_orderstatus == 'P'")))
    plan = repo.create_branch("b", "ann").plan
    plan.steps[0].condition = "o_orderstatus == 'F'"
    repo.update_branch("b", plan)
    p = repo.propose("b", "finished ones", "ann")
    repo.review(p.id, "bob", True)
    repo.merge(p.id, "bob")
    repo.rollback(1, "bob")
    return spark.createDataFrame([(v.version, v.note, v.plan.steps[0].condition[-2]) for v in repo.versions], "version int, note string, wanted string")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS branch_rows, count(*) FILTER (WHERE o_orderstatus = 'P') AS main_rows, 'modified' AS change FROM orders")
def plan_branch(spark, d):
    """Main and a branch run side by side."""
    repo = PlanRepository(_plan(d, "orders", Filter("f", "orders", "o_orderstatus == 'P'")))
    plan = repo.create_branch("b", "ann").plan
    plan.steps[0].condition = "o_orderstatus == 'F'"
    repo.update_branch("b", plan)
    run = lambda p: Compiler(spark).run(p)
    return run(repo.branch("b").plan).agg(F.count(F.lit(1)).alias("branch_rows")).crossJoin(run(repo.main).agg(F.count(F.lit(1)).alias("main_rows"))).withColumn("change", F.lit(repo.diff("b")[0].kind))


@query("SELECT * FROM (VALUES (0, 'PIPELINE p'), (1, '  nation := READ parquet nation'), (2, '  f := FILTER nation WHERE n_regionkey == ''1'''), (3, '  g := AGGREGATE f BY nothing: count(*) AS n')) v(i, line)")
def plan_pseudocode(spark, d):
    plan = Pipeline("p", [Source("nation", "parquet", "nation")], [Filter("f", "nation", "n_regionkey == '1'"), Aggregate("g", "f", [], [Aggregation("count", "*", "n")])])
    return spark.createDataFrame(list(enumerate(Pipeline.from_json(plan.to_json()).pseudocode().split("\n"))), "i int, line string")


# -- service, security, operations ---------------------------------------------------------------------------------

def _service(spark, d) -> Service:
    """The support pipeline over the test tables: orders as tickets, api_sample, and the knowledge articles."""
    k = F.col("o_orderkey").cast("string")
    tickets = t(spark, d, "orders").select(
        k.alias("Ticket ID"), F.col("o_orderstatus").alias("Ticket Subject"), k.alias("Ticket Description"), k.alias("Ticket Status"), k.alias("Ticket Priority"), k.alias("Ticket Channel"),
        F.lit("").alias("First Response Time"), k.alias("Resolution"), F.when(F.col("o_orderpriority") == "1-URGENT", "Refund request").when(F.col("o_orderpriority") == "2-HIGH", "Billing inquiry").otherwise("Other").alias("Ticket Type"),
    )
    activity = t(spark, d, "api_sample").filter("title IS NOT NULL").select(F.col("userid").alias("userId"), "id", "title", "completed")
    articles = t(spark, d, "knowledge_articles").select("category", "intent", F.col("question").alias("instruction"), F.col("answer").alias("response"))
    return Service(spark, frames={"support_tickets": tickets, "support_activity_api": activity, "kb_articles": articles})


_SERVICE = """(SELECT case_id, subject, ticket_type, matched_category, coalesce(n, 0) AS matched_article_count, source_system FROM (
 SELECT 'ticket_' || o_orderkey AS case_id, o_orderstatus AS subject, CASE o_orderpriority WHEN '1-URGENT' THEN 'Refund request' WHEN '2-HIGH' THEN 'Billing inquiry' ELSE 'Other' END AS ticket_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'REFUND' WHEN '2-HIGH' THEN 'PAYMENT' END AS matched_category, 'support_tickets' AS source_system FROM orders
 UNION ALL SELECT 'api_' || id, title, NULL, NULL, 'support_activity_api' FROM api_sample WHERE title IS NOT NULL)
 LEFT JOIN (SELECT category, count(*) AS n FROM knowledge_articles GROUP BY 1) ON matched_category = category)"""


@query(f"SELECT * FROM {_SERVICE}")
def service_deploy(spark, d):
    """Run, validated, approved and deployed through the service; what was written is read back."""
    s = _service(spark, d)
    ran = s.run_pipeline()
    assert s.validate_pipeline()["is_safe"]
    at = _work(spark, f"deploy-{uuid.uuid4().hex}")
    assert s.deploy(at, True, "admin", fmt="parquet")["records"] == ran["records"]
    return spark.read.parquet(at)


@query(f"SELECT source_system, count(*) AS n, sum(matched_article_count)::BIGINT AS articles FROM {_SERVICE} GROUP BY 1")
def service_sql(spark, d):
    """SQL text over the output of a run."""
    s = _service(spark, d)
    s.run_pipeline()
    return s.sql("SELECT source_system, count(*) AS n, sum(matched_article_count) AS articles FROM output GROUP BY source_system")


@query("SELECT * FROM (VALUES ('support_tickets', 'csv'), ('support_activity_api', 'api'), ('kb_articles', 'csv')) v(name, format)")
def service_sources(spark, d):
    return spark.createDataFrame([(x["name"], x["format"]) for x in _service(spark, d).list_sources()], "name string, format string")


@query("SELECT 'success' AS status, 'manual' AS trigger_type, (SELECT count(*) FROM orders) AS record_count UNION ALL SELECT 'validation_failed', 'event', (SELECT count(*) FROM nation) UNION ALL SELECT 'build_failed', 'schedule', 0")
def scheduler_builds(spark, d):
    import datetime as dt

    from millrace.operators.quality import ContractResult

    def broken():
        raise ConnectionError("no route")

    s = OP.Scheduler()
    s.run_now("p", lambda: (t(spark, d, "orders"), 0, ContractResult(True)))
    s.add_trigger("t", "arrived", "p", lambda: (t(spark, d, "nation"), 2, ContractResult(True)))
    s.fire("arrived")
    s.add_schedule("n", "* * * * *", "p", broken)
    s.check(dt.datetime(2024, 1, 1, 1, 1))
    s.check(dt.datetime(2024, 1, 1, 1, 1, 30))  # the same minute: nothing
    return spark.createDataFrame([(r.status, r.trigger_type, r.record_count) for r in s.results], "status string, trigger_type string, record_count bigint")


@query("SELECT * FROM (VALUES ('run_failure', 'critical', 'p', 'alice'), ('sla_breach', 'warning', 'q', 'alice')) v(kind, severity, pipeline, owner)")
def alert_channel(spark, d):
    a = OP.Alerts()
    a.set_limit("p", 10, "alice")
    a.set_limit("q", 10, "alice")
    runs = [OP.BuildResult("m", "x", "p", "2024-01-01T00:00:00", "2024-01-01T00:00:01", "build_failed"), OP.BuildResult("m", "x", "q", "2024-01-01T00:00:00", "2024-01-01T00:05:00")]
    a.evaluate(runs)
    a.evaluate(runs)  # raises nothing again
    return spark.createDataFrame([(x.kind, x.severity, x.pipeline, x.owner) for x in a.find()], "kind string, severity string, pipeline string, owner string")


@query("SELECT * FROM (VALUES ('admin', 'manage_users', true), ('dan', 'deploy', true), ('dan', 'approve', false), ('eve', 'view', true), ('eve', 'edit', false)) v(username, permission, allowed)")
def role_permissions(spark, d):
    access = S.AccessControl("admin")
    access.assign("admin", "dan", "deployer")
    asked = (("admin", "manage_users"), ("dan", "deploy"), ("dan", "approve"), ("eve", "view"), ("eve", "edit"))
    return spark.createDataFrame([(u, p, access.can(u, p)) for u, p in asked], "username string, permission string, allowed boolean")


@query("SELECT * FROM (VALUES ('c_custkey', true), ('c_name', true), ('c_acctbal', false)) v(field, visible)")
def field_visibility(spark, d):
    columns = S.ColumnSecurity(S.AccessControl("root"), {"Customer": {"c_acctbal"}})
    return spark.createDataFrame(list(columns.visibility("guest", "Customer", ["c_custkey", "c_name", "c_acctbal"]).items()), "field string, visible boolean")


@query("SELECT 'audit' AS log, 'r_' || r_regionkey AS resource FROM region UNION ALL SELECT 'deploy', r_name FROM region")
def append_only_logs(spark, d):
    """Audit events as JSON lines and deployments as text lines, appended and read back by Spark."""
    folder = _work(spark, f"logs-{uuid.uuid4().hex}").removeprefix("file:")
    regions = [(r.r_regionkey, r.r_name) for r in t(spark, d, "region").collect()]
    audit = S.AuditLog(f"{folder}/audit.jsonl")
    gate = OP.DeployGate(f"{folder}/deploy.log")
    df = t(spark, d, "region").select(F.col("r_name").alias("case_id"), F.lit("s").alias("subject"), F.lit(None).cast("string").alias("ticket_type"), F.lit(None).cast("string").alias("matched_category"), F.lit(0).cast("bigint").alias("matched_article_count"), F.lit("x").alias("source_system"))
    gate.validate("r", df, SCHEMAS["JoinedCaseOutput"])
    for k, name in regions:
        audit.log("ann", "editor", "edit", f"r_{k}")
        gate.deploy("r", df, f"{folder}/{name}.json", True)
    back = [("audit", e.resource) for e in S.AuditLog(f"{folder}/audit.jsonl").events]
    with open(f"{folder}/deploy.log", encoding="utf-8") as f:
        lines = [(x,) for x in f.read().splitlines()]
    found = Q.parse_deploy_log(spark.createDataFrame(lines, "value string")).select(F.lit("deploy").alias("log"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("resource"))
    return spark.createDataFrame(back, "log string, resource string").unionByName(found)


@query("SELECT action, count(*) AS n FROM security_audit_log WHERE success = false AND action IS NOT NULL GROUP BY 1")
def audit_filtered(spark, d):
    """Filters on the collection of audit events, as a table."""
    return R.aggregate_rows(R.filter_rows(R.filter_rows(t(spark, d, "security_audit_log"), "success == 'false'"), "action IS NOT NULL"), ["action"], [Aggregation("count", "*", "n")])


@query("SELECT s_suppkey, 'POINT (' || ((s_suppkey + 1) / 2.0)::VARCHAR || ' 0.5)' AS centre, s_suppkey >= 4 AS meets FROM supplier")
def geometry_centroid_intersects(spark, d):
    s = t(spark, d, "supplier")
    w = (F.col("s_suppkey") + 1).cast("double").cast("string")
    box = F.concat(F.lit("POLYGON ((0 0, "), w, F.lit(" 0, "), w, F.lit(" 1, 0 1, 0 0))"))
    return s.select("s_suppkey", X.wkt_centroid(box).alias("centre"), X.wkt_intersects(box, F.lit("POINT (5 1)")).alias("meets"))


@query("SELECT n_nationkey, n_name FROM nation")
def orc_round_trip(spark, d):
    at = _work(spark, f"orc-{uuid.uuid4().hex}")
    t(spark, d, "nation").select("n_nationkey", "n_name").write.orc(at)
    return C.CONNECTORS.read(spark, Source("n", "orc", at))


@query("SELECT v AS field_name FROM (VALUES ('case_id'), ('subject'), ('ticket_type'), ('matched_category'), ('matched_article_count'), ('source_system')) t(v)")
def schema_fields(spark, d):
    return spark.createDataFrame([(f["name"],) for f in Service(spark).get_schema("JoinedCaseOutput")], "field_name string")


