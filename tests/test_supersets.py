"""Joins by time, set steps, grouping sets, streams, marks kept after the write, and one evaluation per run."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.control import operations as OP
from millrace.control.versioning import diff_plans
from millrace.operators import infer as I
from millrace.operators import relational as R
from millrace.operators.temporal import asof_join, range_join
from millrace.plans.compile import Compiler, PlanError
from millrace.plans.ir import Aggregate, Aggregation, Filter, Join, JoinKey, Pipeline, SetStep, Source, WindowStep
from millrace.service import Service
from millrace.sources import connectors as C
from millrace.sources import incremental as N
from millrace.streaming import incremental as ST


@pytest.mark.parametrize("chunk, tolerance", [(10, None), (1000, None), (7, 25)])
def test_asof_join(spark, chunk, tolerance):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(-50, 300)])) for i in range(300)]
    right = [(i, key(), rng.choice([None, *range(-50, 300, 3)])) for i in range(120)]
    a, b = spark.createDataFrame(left, "id int, k string, at bigint"), spark.createDataFrame(right, "id int, k string, at bigint")
    got = {r.id: r.matched and r.matched.id for r in asof_join(a, b, [("k", "k")], "at", "at", chunk, tolerance, tie="id").collect()}
    for i, k, at in left:
        fits = [(t, j) for j, x, t in right if k is not None and x == k and at is not None and t is not None and t <= at and (tolerance is None or t >= at - tolerance)]
        best = max(fits, default=(None, None))
        if tolerance is not None:  # the latest row is the match, or none is
            every = [(t, j) for j, x, t in right if k is not None and x == k and at is not None and t is not None and t <= at]
            best = max(every, default=(None, None))
            best = best if best[0] is not None and best[0] >= at - tolerance else (None, None)
        assert got[i] == best[1]
    assert len(got) == 300 and asof_join(a.limit(0), b, [("k", "k")], "at", "at").count() == 0
    assert asof_join(a, b.limit(0), [("k", "k")], "at", "at").filter("matched IS NOT NULL").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, how):
    rng = random.Random(4)
    points = [(i, rng.choice([None, *range(-100, 5000)])) for i in range(200)] + [(200, 7), (201, 7)]
    spans = [(i, *rng.choice([(None, 5), (9, 3), (lo := rng.randrange(-100, 4000), lo + rng.choice([0, 3, 50, 3000]))])) for i in range(60)]
    p, s = spark.createDataFrame(points, "p int, at bigint"), spark.createDataFrame(spans, "s int, lo bigint, hi bigint")
    got = sorted((r.p, -1 if r.s is None else r.s) for r in range_join(p, s, "at", "lo", "hi", 4, how).select("p", "s").collect())
    want = [(i, j) for i, t in points for j, a, b in spans if None not in (t, a, b) and a <= t <= b]
    want += [(i, -1) for i, _ in points if how == "left" and i not in {x for x, _ in want}]
    assert got == sorted(want)
    assert range_join(p, s.limit(0), "at", "lo", "hi", 4).count() == 0


def test_steps_are_checked(spark):
    frames = {"a": spark.createDataFrame([(1, "x")], "n int, s string"), "b": spark.createDataFrame([(1, "x")], "n int, t string")}
    run = lambda step: Compiler(spark).run(Pipeline("p", [Source("a", "given", ""), Source("b", "given", "")], [step]), frames)
    for bad in (
        SetStep("s", ["a"], "except"), SetStep("s", ["a", "b"], "intersect"), SetStep("s", ["a"], "shuffle"), Aggregate("g", "a", ["n"], [], "pile"), Aggregate("g", "a", ["n"], [], [["s"]]),
        Join("j", "a", "b", [JoinKey("n", "n")], "semi"), Join("j", "a", "b", [JoinKey("n", "n")], order_by="zzz"), WindowStep("w", "a", order_by=["n", "s"], frame_kind="range", function="sum", field="n"),
        WindowStep("w", "a", order_by=["n"], tie="zzz"),
    ):
        with pytest.raises(PlanError):
            run(bad)
    assert run(Join("j", "a", "b", [JoinKey("n", "n")], "anti", shape="flat")).count() == 0
    with pytest.raises(R.SchemaMismatchError):
        R.set_rows([frames["a"], frames["b"]], "except")


def test_grouping_of_no_rows_and_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    made = [Aggregation("sum", "v", "s"), Aggregation("count_distinct", "v", "d")]
    rows = {(r.k, r.grouping_id): (r.s, r.d) for r in R.aggregate_rows(df, ["k"], made, "rollup").collect()}
    assert rows == {(None, 0): (1, 1), ("x", 0): (2, 1), (None, 1): (3, 2)}
    assert R.aggregate_rows(df.limit(0), ["k"], made).count() == 0


def test_all_overlaps_by_one_job(spark):
    left = spark.createDataFrame([("1", "x", None), ("2", "x", None), ("2", "", None)], "a string, b string, c string")
    right = spark.createDataFrame([("2", "x"), ("3", None)], "a string, z string")
    got = {(r.left, r.right): (r.n_left, r.n_found) for r in I.overlaps(left, ["a", "b", "c"], right, ["a", "z"]).collect()}
    assert got == {("a", "a"): (3, 2), ("a", "z"): (3, 0), ("b", "a"): (2, 0), ("b", "z"): (2, 2)}
    for (x, y), (n, m) in got.items():
        one = I.overlap(left, x, right, y).first()
        assert (one.n_left, one.n_found) == (n, m)


def test_duplicate_flags_keep_one_entry_a_source(spark):
    df = spark.createDataFrame([(i, "same", "s1" if i % 4 else "s2") for i in range(400)] + [(400, "same", None), (401, "lone", "s1")], "i int, v string, source_system string")
    (r,) = R.duplicate_flags(df, order="i", counts=True).collect()
    assert r.n_rows == 401 and r.source_counts == {"s1": 300, "s2": 100} and r.sources == ["s1"] * 300 + ["s2"] * 100 and r.record_index == 0


def test_a_mark_moves_only_after_the_write(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    store = N.MarkStore()

    def fail(df):
        raise OSError("disk full")

    with pytest.raises(OSError):
        N.load_new(N.read_by_id, rows, store, "s", "id", fail)
    assert store.get("s").last_seen_id is None and store.get("s").total_processed == 0
    got = []
    N.load_new(N.read_by_id, rows, store, "s", "id", lambda df: got.extend(r.id for r in df.collect()))
    assert sorted(got) == [0, 1, 2, 3, 4] and store.get("s").last_seen_id == "4"


def test_rows_that_arrive_while_reading_come_with_the_next_load(spark, tmp_path):
    path, store = str(tmp_path / "t"), N.MarkStore()
    spark.range(3).write.parquet(path)
    source = lambda: spark.read.schema("id bigint").parquet(path)
    new, mark = N.read_by_id(source(), store, "s", "id", commit=False)
    spark.range(3, 5).write.mode("append").parquet(path)
    assert mark.last_seen_id == "2" and new.count() == 3 and source().count() == 5
    store.commit(mark)
    assert sorted(r.id for r in N.read_by_id(source(), store, "s", "id")[0].collect()) == [3, 4]


def test_what_is_deployed_is_what_was_validated(spark, tmp_path):
    """The source changes between the run, the verdict and the deployment; the rows of the run are written."""
    path = str(tmp_path / "cases.json")

    def put(*ids):
        rows = ",".join(f'{{"case_id":"{i}","subject":"s","ticket_type":null,"matched_category":null,"matched_article_count":0,"source_system":"x"}}' for i in ids)
        (tmp_path / "cases.json").write_text(f"[{rows}]")

    put("1", "2")
    plan = Pipeline("p", [Source("cases", "json", path, "JoinedCaseOutput")], [Filter("out", "cases", "case_id != 'z'")], "JoinedCaseOutput")
    s = Service(spark, plan, state_dir=str(tmp_path / "state"))
    assert s.run_pipeline()["records"] == 2
    put("7", "7", "7")
    spark.catalog.clearCache()
    assert s.validate_pipeline()["is_safe"] and [r["case_id"] for r in s.preview_output()] == ["1", "2"]
    assert s.deploy(str(tmp_path / "out"), True, "admin", fmt="parquet")["records"] == 2
    assert sorted(r.case_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
    assert s.sql("SELECT count(*) AS n FROM output").first().n == 2


def test_an_answer_is_asked_for_once_a_run(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(1)
            body = json.dumps([{"userId": 1, "id": len(asked), "title": "t", "completed": True}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        s = Service(spark, Pipeline("p", [Source("api", "http", f"http://127.0.0.1:{server.server_port}/")], [Filter("out", "api", "id != '0'")]))
        s.run_pipeline()
        assert s.output.count() == 1 and s.output.first().id == 1 and len(asked) == 1
    finally:
        server.shutdown()
        server.server_close()


def test_state_outlives_the_service(spark, tmp_path):
    plan = Pipeline("p", [Source("x", "parquet", str(tmp_path / "none"))], [Filter("f", "x", "a == '1'"), Join("j", "f", "x", [JoinKey("a", "a", {"1": "2"})])])
    make = lambda: Service(spark, plan, state_dir=str(tmp_path / "state"))
    s = make()
    s.security_assign_role("ann", "editor", "admin")
    s.security_mark_field_sensitive("JoinedCaseOutput", "subject", "admin")
    s.versioning_create_branch("b", "ann")
    other = s.repository.branch("b").plan
    other.steps[0].condition = "a == '2'"
    s.repository.update_branch("b", other)
    pid = s.versioning_create_proposal("b", "t", "ann")["id"]
    s.scheduler_add_schedule("nightly", "0 1 * * *")
    s.scheduler_disable_schedule("nightly")
    s.scheduler_add_event_trigger("t", "arrived")
    left = spark.createDataFrame([("1",)], "id string")
    s.agent_orchestrate("join the tickets", {"l": left, "r": left}, joins=[("l", ["id"], "r", ["id"])])
    again = make()
    assert again.access.role("ann") == "editor" and again.columns.summary() == {"JoinedCaseOutput": ["subject"]}
    assert again.scheduler_list_schedules() == [{"name": "nightly", "cron": "0 1 * * *", "enabled": False}] and again.scheduler_list_event_triggers() == s.scheduler_list_event_triggers()
    assert again.agent_get_pending_reviews() == s.agent_get_pending_reviews() and again.agent_get_review_summary() == s.agent_get_review_summary()
    again.versioning_review_proposal(pid, "admin", True)
    again.versioning_merge_proposal(pid, "admin")
    third = make()
    assert third.repository.main.steps[0].condition == "a == '2'" and len(third.versioning_list_versions()) == 2 and third.repository.branch("b").merged
    third.versioning_rollback(1, "admin")
    assert make().repository.main.to_json() == plan.to_json()
    assert third.scheduler_trigger_event("arrived")[0]["status"] == "build_failed"


def test_roles_that_may_see_are_a_parameter(spark):
    from millrace.control.security import AccessControl, ColumnSecurity

    access = AccessControl("root")
    access.assign("root", "ed", "editor")
    columns = ColumnSecurity(access, {"S": {"x"}}, roles={"editor"})
    assert columns.hidden("ed", "S") == [] and columns.hidden("root", "S") == ["x"]


def test_sources_show_in_differences():
    a = Pipeline("p", [Source("x", "csv", "1"), Source("y", "csv", "2")])
    b = Pipeline("p", [Source("x", "parquet", "1"), Source("z", "csv", "2")])
    assert [(c.kind, c.output, sorted(c.details)) for c in diff_plans(a, b)] == [("modified", "x", ["format"]), ("removed", "y", []), ("added", "z", [])]


def test_cron_of_a_column_is_cron_of_each_time(spark):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=97 * i) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(None, None)], "i int, at timestamp_ntz")
    for text in ("*/15 * * * *", "7 9-17 * * 1-5", "* * 1,15 * 0", "30 4 * 2 *"):
        cron = OP.Cron(text)
        got = {r.i: r.m for r in df.select("i", cron.column(F.col("at")).alias("m")).collect()}
        assert got.pop(None) is None and got == {i: cron.matches(t) for i, t in enumerate(times)}


def test_streams_of_windows_and_sessions(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=m)) for k in ("a", "b") for m in (0, 5, 20, 70, 71, 200)]
    schema = "k string, at timestamp"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    spark.createDataFrame([("a", start + dt.timedelta(days=2))], schema).write.mode("append").parquet(path)  # moves the watermark
    spark.createDataFrame([("a", start)], schema).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    for name, made in (("w", ST.windowed_counts(stream, "at", "k", "1 hour", "30 minutes", late="10 minutes")), ("s", ST.session_counts(stream, "at", "k", "30 minutes", late="10 minutes"))):
        q = made.writeStream.format("memory").queryName(f"millrace_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    windows = spark.table("millrace_w").filter("k = 'b'")
    batch = ST.windowed_counts(spark.read.parquet(path), "at", "k", "1 hour", "30 minutes").filter("k = 'b'")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, batch.collect()))
    sessions = spark.table("millrace_s").filter("k = 'b'").collect()
    assert sorted((r.started_at, r.n_events) for r in sessions) == [(start, 3), (start + dt.timedelta(minutes=70), 2), (start + dt.timedelta(minutes=200), 1)]


def test_sources_as_streams(spark, tmp_path):
    rows = "case_id string, subject string, ticket_type string, matched_category string, matched_article_count bigint, source_system string"
    path = str(tmp_path / "in")
    spark.createDataFrame([("1", "s", None, None, 0, "x")], rows).write.parquet(path)
    source = Source("cases", "parquet", path, "JoinedCaseOutput")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for n in (1, 2):
        C.CONNECTORS.stream(spark, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == n
        spark.createDataFrame([("2", "s", None, None, 0, "x")], rows).write.mode("append").parquet(path)
    assert C.CONNECTORS.stream(spark, Source("r", "rate", "", options={"rowsPerSecond": 5})).isStreaming
    with pytest.raises(ValueError):
        C.CONNECTORS.stream(spark, Source("h", "http", "http://x"))


def test_a_bad_condition_names_its_step(spark):
    with pytest.raises(PlanError, match=r"step 1 \(Filter\)"):
        Compiler(spark).compile(Pipeline("p", [Source("a", "given", "")], [Filter("f", "a", "n > 0"), Filter("g", "f", "zzz > 0")]), {"a": spark.createDataFrame([(1,)], "n int")})


def test_positions_without_an_order(spark, tmp_path):
    df = spark.range(0, 500, 1, 6)
    assert sorted((r.id, r._ord) for r in C.with_position(df).collect()) == [(i, i) for i in range(500)]
    n = C.write_json_array(df.repartition(7), str(tmp_path / "x.json"))
    assert n == 500 and C.read_json_array(spark, str(tmp_path / "x.json")).count() == 500
    assert C.write_json_array(df.limit(0), str(tmp_path / "y.json")) == 0 and C.sample_to_file(df, str(tmp_path / "z.json"), 9) == 9
