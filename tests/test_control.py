"""Sources, marks, the gate, schedules, alerts, versions, access, review and the service as a whole."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.control import operations as OP
from millrace.control.review import suggest
from millrace.control.security import AccessControl, AccessDenied, AuditLog, ColumnSecurity
from millrace.control.versioning import PlanRepository
from millrace.functions.types import SCHEMAS
from millrace.operators.quality import ContractResult
from millrace.pipelines import support
from millrace.plans.ir import Filter, Pipeline, Source
from millrace.service import Service
from millrace.sources import connectors as C
from millrace.sources import incremental as N


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a, ""b""\nc"\n2,\n', encoding="utf-8")
    got = [tuple(r) for r in C.CONNECTORS.read(spark, Source("t", "csv", str(tmp_path / "t.csv"))).collect()]
    assert got[0] == ("1", 'a, "b"\nc') and got[1][0] == "2"
    with pytest.raises(FileNotFoundError):
        C.CONNECTORS.read(spark, Source("t", "csv", str(tmp_path / "none.csv")))


def test_http_and_fallback(spark, tmp_path):
    rows = [{"userId": 1, "id": 5, "title": "Sample", "completed": True}]

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps(rows if self.path == "/list" else {"no": "list"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    read = lambda url, **o: C.CONNECTORS.read(spark, Source("x", "http", url, options=o)).collect()
    try:
        assert read(f"{base}/list")[0].title == "Sample"
        with pytest.raises(Exception, match="doesn't give a list"):
            read(f"{base}/other", fallback="unused")
    finally:
        server.shutdown()
        server.server_close()
    (tmp_path / "f.json").write_text(json.dumps(rows))
    assert read(f"{base}/list", fallback=str(tmp_path / "f.json"))[0].id == 5
    with pytest.raises(Exception, match="ConnectionError"):
        read(f"{base}/list")


def test_isolation(spark):
    run = C.ingest_all({"a": lambda: spark.range(3), "b": lambda: (_ for _ in ()).throw(ConnectionError("down")), "c": lambda: spark.range(2)})
    assert not run.all_succeeded and run.failed == ["b"] and run.summary()["rows"] == 5
    assert not C.ingest_all({}).all_succeeded


def test_positions_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    got = sorted((r.k, r._ord) for r in C.with_position(df, "_ord", "k").collect())
    assert got == [(i, i) for i in range(1000)]
    assert sorted(r._ord for r in C.with_position(df).collect()) == list(range(1000))


def test_marks(spark, tmp_path):
    store = N.MarkStore(str(tmp_path / "marks.json"))
    rows = spark.createDataFrame([(i, str(i), f"2024-01-0{i + 1}") for i in range(5)], "_ord bigint, id string, at string")
    assert N.read_by_index(rows, store, "s")[0].count() == 5 and store.get("s").last_seen_index == 4
    assert N.read_by_index(rows, store, "s")[0].count() == 0 and store.get("s").last_seen_index == 4
    assert N.read_by_index(rows.limit(0), store, "fresh")[1].last_seen_index is None
    store.update("t", last_seen_timestamp="2024-01-03")
    new, mark = N.read_by_timestamp(rows.union(spark.createDataFrame([(9, "9", None)], rows.schema)), store, "t", "at")
    assert new.count() == 2 and mark.last_seen_timestamp == "2024-01-05"
    assert N.MarkStore(str(tmp_path / "marks.json")).get("s").total_processed == 5
    (tmp_path / "marks.json").write_text("broken")
    assert N.MarkStore(str(tmp_path / "marks.json")).summary() == {}


@pytest.mark.parametrize("text, at, want", [
    ("30 * * * *", "2024-01-15 10:30", True), ("0,30 * * * *", "2024-01-15 10:31", False), ("* * * * 1", "2024-01-15 10:31", True), ("30 9 * * 1-5", "2024-01-14 09:30", False), ("*/15 * * * *", "2024-01-15 10:45", True),
])
def test_cron(text, at, want):
    assert OP.Cron(text).matches(dt.datetime.fromisoformat(at)) is want


@pytest.mark.parametrize("text", ["* * *", "60 * * * *", "a * * * *", "5-1 * * * *"])
def test_bad_cron(text):
    with pytest.raises(ValueError):
        OP.Cron(text)


def test_scheduler_never_writes(spark, tmp_path):
    s = OP.Scheduler()
    good = lambda: (spark.range(3), 0, ContractResult(True))
    s.add_schedule("n", "* * * * *", "p", good)
    at = dt.datetime(2024, 1, 1, 1, 1, 5)
    assert len(s.check(at)) == 1 and len(s.check(at.replace(second=50))) == 0
    s.add_trigger("t", "arrived", "p", lambda: (spark.range(1), 2, ContractResult(True)))
    assert s.fire("arrived")[0].status == "validation_failed"
    assert s.run_now("p", lambda: 1 / 0).status == "build_failed"
    assert s.summary()["by_status"] == {"success": 1, "validation_failed": 1, "build_failed": 1}
    assert not list(tmp_path.iterdir())
    alerts = OP.Alerts()
    assert {a.kind for a in alerts.evaluate(s.results)} == {"run_failure"} and alerts.evaluate(s.results) == []


def test_sla():
    r = OP.BuildResult("m", "x", "p", "2024-01-01T00:00:00", "2024-01-01T00:05:00")
    a = OP.Alerts()
    a.set_limit("p", 300, "alice")
    assert a.evaluate([r]) == []
    a.set_limit("p", 120, "alice")
    assert a.evaluate([r])[0].severity == "warning"


def test_gate(spark, tmp_path):
    df = spark.createDataFrame([("1", "s", None, None, 0, "x")], "case_id string, subject string, ticket_type string, matched_category string, matched_article_count bigint, source_system string")
    gate = OP.DeployGate(str(tmp_path / "log.txt"))
    out = str(tmp_path / "o" / "out.json")
    with pytest.raises(OP.DeployBlocked):
        gate.deploy("r1", df, out, True)
    gate.validate("r1", df, SCHEMAS["JoinedCaseOutput"])
    with pytest.raises(OP.DeployBlocked):
        gate.deploy("r1", df, out, False)
    gate.validate("r2", df.limit(0), SCHEMAS["JoinedCaseOutput"])
    for run in ("r1", "r2"):  # a stale verdict and an unsafe one
        with pytest.raises(OP.DeployBlocked):
            gate.deploy(run, df, out, True)
    assert not (tmp_path / "o").exists()
    gate.validate("r3", df, SCHEMAS["JoinedCaseOutput"])
    assert gate.deploy("r3", df, out, True, by="alice") == 1 and json.loads((tmp_path / "o" / "out.json").read_text())[0]["case_id"] == "1"
    assert "deployed_by=alice" in (tmp_path / "log.txt").read_text()


def test_versions():
    repo = PlanRepository(Pipeline("p", [Source("a", "csv", "x")], [Filter("f", "a", "s == '1'")]))
    repo.create_branch("b", "ann")
    with pytest.raises(ValueError):
        repo.create_branch("Main", "ann")
    plan = repo.branch("b").plan
    plan.steps[0].condition = "s == '2'"
    repo.update_branch("b", plan)
    p = repo.propose("b", "t", "ann")
    q = repo.propose("b", "t2", "ann")
    assert p.status == "superseded"
    for bad in (lambda: repo.review(q.id, "ann", True), lambda: repo.review(q.id, "bob", False), lambda: repo.merge(q.id, "bob")):
        with pytest.raises(ValueError):
            bad()
    assert len(repo.versions) == 1
    repo.review(q.id, "bob", True)
    repo.merge(q.id, "bob")
    assert repo.main.steps[0].condition == "s == '2'" and len(repo.versions) == 2
    with pytest.raises(ValueError):
        repo.update_branch("b", plan)
    with pytest.raises(ValueError):
        repo.rollback(2, "bob")
    assert repo.rollback(1, "bob").version == 3 and repo.main.steps[0].condition == "s == '1'"


def test_access(spark, tmp_path):
    access = AccessControl("root", AuditLog(str(tmp_path / "a.jsonl")))
    with pytest.raises(AccessDenied):
        access.assign("eve", "eve", "admin")
    access.assign("root", "dan", "deployer")
    assert access.can("dan", "deploy") and not access.can("dan", "approve") and not access.can("eve", "edit")
    assert AuditLog(str(tmp_path / "a.jsonl")).summary()["failed"] == 1
    columns = ColumnSecurity(access, {"S": {"x"}})
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    assert columns.view(df, "eve", "S").first().x is None and columns.view(df, "root", "S").first().x == 1
    assert columns.view(df, "eve", "S", remove=True).columns == ["y"]


def test_review(spark):
    left = spark.createDataFrame([("1",)], "id string")
    gate = suggest("join the tickets", support.CATALOG, {"l": left, "r": left}, joins=[("l", ["id"], "r", ["id"])])
    (index, found), = [x for x in gate.pending() if x[1].kind == "join"]
    assert found.step.review_status == "unreviewed"
    with pytest.raises(ValueError):
        gate.reject(index, "bob", "")
    assert gate.approve(index, "bob").step.review_status == "approved" and found.step in gate.approved_steps()
    with pytest.raises(ValueError):
        gate.approve(index, "bob")


def test_service(spark, tmp_path):
    tickets = spark.createDataFrame([("1", "S", "d", "Open", "Low", "Email", "2023-01-01 10:00:00", "", "Refund request"), ("2", "", "d", "Open", "Low", "Email", "x", "", None)],
                                    ["Ticket ID", "Ticket Subject", "Ticket Description", "Ticket Status", "Ticket Priority", "Ticket Channel", "First Response Time", "Resolution", "Ticket Type"])
    activity = spark.createDataFrame([(1, 5, "Sample task", True)], "userId bigint, id bigint, title string, completed boolean")
    articles = spark.createDataFrame([("F", "q", "REFUND", "get", "a"), ("F", "q2", "REFUND", None, "b")], "flags string, instruction string, category string, intent string, response string")
    s = Service(spark, state_dir=str(tmp_path), frames={"support_tickets": tickets, "support_activity_api": activity, "kb_articles": articles})
    ran = s.run_pipeline()
    assert (ran["records"], ran["errors"]) == (2, 1)
    rows = {r["case_id"]: r for r in s.preview_output()}
    assert rows["ticket_1"]["matched_article_count"] == 2 and rows["api_5"]["matched_category"] is None
    assert not s.validate_pipeline()["is_safe"]  # a row failed to build
    with pytest.raises(AccessDenied):
        s.deploy(str(tmp_path / "out.json"), True, "guest")
    with pytest.raises(OP.DeployBlocked):
        s.deploy(str(tmp_path / "out.json"), True, "admin")
    s.frames["support_tickets"] = tickets.filter("`Ticket ID` = '1'")
    s.run_pipeline()
    with pytest.raises(OP.DeployBlocked):  # the verdict was on the run before
        s.deploy(str(tmp_path / "out.json"), True, "admin")
    assert s.validate_pipeline()["is_safe"]
    assert s.deploy(str(tmp_path / "out.json"), True, "admin")["records"] == 2
    assert s.monitoring_get_deploy_history()[0]["records"] == 2
    assert s.get_join_provenance() and s.get_lineage("joined", "matched_articles")
    assert s.scheduler_trigger_manual()["status"] == "success" and s.monitoring_get_run_health()[0]["success_rate"] == 1.0
    assert s.monitoring_get_dq_metrics()["duplicates"]["duplicate_rows"] == 0
    assert s.union_check_schemas(["SupportCase", "KnowledgeArticle"])["compatible"] is False
    assert s.ontology_map_records("SupportCase", "cases")["unmapped_count"] == 0
    s.security_mark_field_sensitive("JoinedCaseOutput", "subject", "admin")
    assert s.security_filter_output("guest")[0]["subject"] is None
