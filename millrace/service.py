"""One object with every call a user of the engine makes; it holds the state that used to be spread over tools."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.control import ontology as O
from millrace.control.lineage import LineageStore
from millrace.control.operations import Alerts, DeployBlocked, DeployGate, Scheduler
from millrace.control.review import ReviewGate, suggest
from millrace.control.security import AccessControl, AuditLog, ColumnSecurity
from millrace.control.versioning import PlanRepository
from millrace.functions.transforms import ChainStep, TransformChain
from millrace.functions.types import SCHEMAS, Schema, get_schema
from millrace.operators import quality as Q
from millrace.operators.relational import check_union, duplicate_flags
from millrace.pipelines import support
from millrace.plans.compile import Compiler
from millrace.plans.ir import Pipeline
from millrace.session import cut
from millrace.sources.connectors import IngestRun, ingest_all, read_json_array
from millrace.sources.incremental import MarkStore


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Service:
    """State of one installation. What runs is the plan in Main, compiled; there's no second path.

    With `state_dir` plans, roles, sensitive fields, schedules, reviews, marks, alerts and logs outlive the process.
    """

    def __init__(self, spark: SparkSession, plan: Pipeline | None = None, admin: str = "admin", state_dir: str | None = None, frames: dict[str, DataFrame] | None = None):
        at = (lambda name: f"{state_dir}/{name}") if state_dir else (lambda name: None)
        self.spark, self.frames = spark, frames or {}
        self.compiler = Compiler(spark)
        for name, mapper in support.MAPPERS.items():
            self.compiler.register_mapper(name, mapper)
        self.audit = AuditLog(at("audit.jsonl"))
        self.access = AccessControl(admin, self.audit, at("roles.json"))
        self.columns = ColumnSecurity(self.access, path=at("sensitive.json"))
        self.repository = PlanRepository(plan or support.support_plan(), path=at("plans.json"))
        self.review = ReviewGate(at("review.json"))
        self.lineage = LineageStore()
        self.scheduler = Scheduler(path=at("schedules.json"), build=self._scheduled)
        self.alerts = Alerts(at("alerts.json"))
        self.gate = DeployGate(at("deploy.log"))
        self.marks = MarkStore(at("marks.json"))
        self.types = O.ObjectTypes()
        self.ingested = IngestRun()
        self.run_id: str | None = None
        self.datasets: dict[str, DataFrame] = {}
        self.output: DataFrame | None = None
        self.rejected: DataFrame | None = None

    # pipeline
    def list_sources(self) -> list[dict]:
        return [{"name": s.name, "format": s.format, "location": s.location} for s in self.repository.main.sources]

    def get_schema(self, name: str) -> list[dict]:
        return [asdict(f) for f in get_schema(name).fields]

    def _build(self) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
        plan = self.repository.main
        # an answer may be another one next time, so it's asked for once
        fetched = lambda s: cut(self.compiler.connectors.read(self.spark, s)) if s.format in ("http", "api") else self.compiler.connectors.read(self.spark, s)
        readers = {s.name: (lambda s=s: self.frames[s.name] if s.name in self.frames else fetched(s)) for s in plan.sources}
        self.ingested = ingest_all(readers)
        missing = [n for n in self.ingested.failed]
        if missing:
            raise RuntimeError(f"sources failed: {self.ingested.summary()['errors']}")
        self.lineage = LineageStore()
        datasets = self.compiler.compile(plan, self.ingested.frames, self.lineage, counted=(plan.output,))
        out = datasets[plan.output]
        if {"case", "matched_articles"} <= set(out.columns):
            out = support.joined_output(out)
        elif set(support.OUTPUT) <= set(out.columns) and plan.contract == "JoinedCaseOutput":
            out = out.select(*support.OUTPUT)
        # evaluated once and kept: what is counted, validated, shown and written are the same rows
        if not plan.contract:
            kept = cut(out)
            return kept, kept.limit(0), datasets
        marked = cut(Q.quarantine(out, get_schema(plan.contract)))
        return marked.filter("size(errors) = 0").drop("errors"), marked.filter("size(errors) > 0"), datasets

    def run_pipeline(self) -> dict:
        self.output, self.rejected, self.datasets = self._build()
        self.run_id = uuid.uuid4().hex[:12]
        return {"run_id": self.run_id, "records": self.output.count(), "errors": self.rejected.count(), "ingestion": self.ingested.summary()}

    def _ran(self) -> DataFrame:
        if self.output is None:
            raise RuntimeError("run the pipeline first")
        return self.output

    def _contract(self) -> Schema:
        return get_schema(self.repository.main.contract or "JoinedCaseOutput")

    def validate_pipeline(self) -> dict:
        safe, reasons = self.gate.validate(self.run_id, self._ran(), self._contract(), self.rejected.count())
        return {"run_id": self.run_id, "is_safe": safe, "reasons": reasons}

    def preview_output(self, limit: int = 10) -> list[dict]:
        return _rows(self._ran().orderBy(self._contract().key).limit(limit))

    def sql(self, text: str) -> DataFrame:
        """A query over the datasets of the last run, each a view of its name; the output is the view `output`."""
        for name, df in {**self.datasets, "output": self._ran()}.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def deploy(self, path: str, approved: bool, by: str, version: str | None = None, fmt: str = "json_array") -> dict:
        """Write the validated rows; `fmt` is json_array (one file, written by the driver) or any format Spark writes."""
        self.access.require(by, "deploy", path)
        try:
            n = self.gate.deploy(self.run_id or "", self._ran(), path, approved, fmt, version, by)
        except DeployBlocked as blocked:
            self.audit.log(by, self.access.role(by), "deploy", path, False, str(blocked))
            raise
        self.audit.log(by, self.access.role(by), "deploy", path, record_count=n, approved=approved)
        return {"records": n, "path": path}

    # agent
    def agent_orchestrate(self, request: str, frames: dict[str, DataFrame] | None = None, schema: str | None = None, joins=None) -> dict:
        suggest(request, support.CATALOG, frames or {}, get_schema(schema) if schema else None, joins, self.review)
        return self.review.summary()

    def agent_get_pending_reviews(self) -> list[dict]:
        return [self.review.describe(i) for i, _ in self.review.pending()]

    def agent_review_proposal(self, index: int, action: str, reviewer: str, reason: str = "") -> dict:
        self.access.require(reviewer, "approve", f"suggestion:{index}")
        if action not in ("approve", "reject"):
            raise ValueError("action is approve or reject")
        self.review.approve(index, reviewer) if action == "approve" else self.review.reject(index, reviewer, reason)
        return self.review.describe(index)

    def agent_get_audit_trail(self) -> list[dict]:
        return list(self.review.trail)

    def agent_get_review_summary(self) -> dict:
        return self.review.summary()

    # lineage
    def get_lineage(self, dataset: str, name: str | None = None) -> list[dict]:
        return [asdict(e) for e in (self.lineage.trace(dataset, name) if name else self.lineage.by_dataset(dataset))]

    def get_join_provenance(self) -> list[dict]:
        return self.lineage.joins()

    def get_lineage_summary(self) -> dict:
        return self.lineage.summary()

    # ontology
    def ontology_list_object_types(self) -> list[dict]:
        return [{"name": n, "identity": self.types.get(n).identity, "fields": self.types.get(n).schema.names} for n in self.types.names()]

    def ontology_map_records(self, type_name: str, dataset: str) -> dict:
        return O.instance_counts(self.datasets[dataset], self.types.get(type_name)).first().asDict()

    def ontology_get_relationships(self) -> list[dict]:
        return O.relationships(self.repository.main, {s.name: s.schema_name for s in self.repository.main.sources})

    # versioning
    def versioning_list_branches(self) -> list[dict]:
        return [{"name": b.name, "author": b.author, "merged": b.merged} for b in self.repository.branches.values()]

    def versioning_get_main(self) -> dict:
        return {"version": len(self.repository.versions), "plan": json.loads(self.repository.main.to_json())}

    def versioning_create_branch(self, name: str, by: str) -> dict:
        self.access.require(by, "edit", f"branch:{name}")
        return {"name": self.repository.create_branch(name, by).name}

    def versioning_get_branch(self, name: str) -> dict:
        b = self.repository.branch(name)
        return {"name": b.name, "author": b.author, "created_at": b.created_at, "merged": b.merged, "steps": len(b.plan.steps)}

    def versioning_get_branch_ir(self, name: str) -> str:
        return self.repository.branch(name).plan.to_json()

    def versioning_update_branch_ir(self, name: str, plan_json: str, by: str) -> dict:
        self.access.require(by, "edit", f"branch:{name}")
        self.repository.update_branch(name, Pipeline.from_json(plan_json))
        self.audit.log(by, self.access.role(by), "edit", f"branch:{name}")
        return self.versioning_get_branch(name)

    def versioning_diff_branch(self, name: str) -> list[dict]:
        return [asdict(c) for c in self.repository.diff(name)]

    def versioning_create_proposal(self, branch: str, title: str, by: str) -> dict:
        self.access.require(by, "edit", f"branch:{branch}")
        p = self.repository.propose(branch, title, by)
        return {"id": p.id, "status": p.status, "changes": [asdict(c) for c in p.changes]}

    def versioning_list_proposals(self, status: str | None = None) -> list[dict]:
        return [{"id": p.id, "branch": p.branch, "status": p.status, "author": p.author} for p in self.repository.list_proposals(status)]

    def versioning_review_proposal(self, pid: str, reviewer: str, approve: bool, reason: str | None = None) -> dict:
        self.access.require(reviewer, "approve", pid)
        p = self.repository.review(pid, reviewer, approve, reason)
        self.audit.log(reviewer, self.access.role(reviewer), "approve", pid, decision=p.status)
        return {"id": p.id, "status": p.status}

    def versioning_merge_proposal(self, pid: str, by: str) -> dict:
        self.access.require(by, "approve", pid)
        return {"version": self.repository.merge(pid, by).version, "deployed": False}

    def versioning_list_versions(self) -> list[dict]:
        return [{"version": v.version, "by": v.by, "note": v.note, "at": v.at} for v in self.repository.versions]

    def versioning_rollback(self, version: int, by: str) -> dict:
        self.access.require(by, "deploy", f"version:{version}")
        return {"version": self.repository.rollback(version, by).version}

    # scheduler
    def _scheduled(self):
        valid, bad, _ = self._build()
        return valid, bad.count(), Q.check_contract(valid, self._contract())

    def scheduler_add_schedule(self, name: str, cron: str) -> dict:
        self.scheduler.add_schedule(name, cron, self.repository.main.name, self._scheduled)
        return {"name": name, "cron": cron}

    def scheduler_add_event_trigger(self, name: str, event: str) -> dict:
        self.scheduler.add_trigger(name, event, self.repository.main.name, self._scheduled)
        return {"name": name, "event": event}

    def scheduler_check_schedules(self, at=None) -> list[dict]:
        return [asdict(r) for r in self.scheduler.check(at)]

    def scheduler_trigger_event(self, event: str) -> list[dict]:
        return [asdict(r) for r in self.scheduler.fire(event)]

    def scheduler_trigger_manual(self, by: str = "manual") -> dict:
        return asdict(self.scheduler.run_now(self.repository.main.name, self._scheduled, by))

    def scheduler_get_build_results(self) -> list[dict]:
        return [asdict(r) for r in self.scheduler.results]

    def scheduler_get_latest_build(self) -> dict | None:
        latest = self.scheduler.latest()
        return asdict(latest) if latest else None

    def scheduler_list_schedules(self) -> list[dict]:
        return [{"name": n, "cron": s["cron"].text, "enabled": s["enabled"]} for n, s in self.scheduler.schedules.items()]

    def scheduler_list_event_triggers(self) -> list[dict]:
        return [{"name": n, "event": t["event"], "enabled": t["enabled"]} for n, t in self.scheduler.triggers.items()]

    def scheduler_enable_schedule(self, name: str) -> dict:
        self.scheduler.enable(name)
        return {"name": name, "enabled": True}

    def scheduler_disable_schedule(self, name: str) -> dict:
        self.scheduler.enable(name, False)
        return {"name": name, "enabled": False}

    def scheduler_summary(self) -> dict:
        return self.scheduler.summary()

    # monitoring
    def monitoring_get_run_health(self) -> list[dict]:
        runs = self.scheduler.frame(self.spark)
        return _rows(Q.run_trends(runs).join(Q.run_histories(runs), "pipeline"))

    def monitoring_get_run_history(self, pipeline: str | None = None) -> list[dict]:
        return [r for r in self.scheduler_get_build_results() if pipeline in (None, r["pipeline"])]

    def monitoring_get_pipeline_trend(self, pipeline: str) -> dict | None:
        return next((r for r in self.monitoring_get_run_health() if r["pipeline"] == pipeline), None)

    def monitoring_get_deploy_history(self) -> list[dict]:
        if not self.gate.log or not self.gate.log.exists():
            return []
        return _rows(Q.parse_deploy_log(self.spark.read.text(str(self.gate.log))))

    def _measures(self, df: DataFrame, schema: Schema) -> dict:
        rates = _rows(Q.null_rates(df))
        observed = {r["field_name"]: r["type_name"] for r in _rows(Q.dominant_types(df))}
        return {
            "null_rates": rates, "overall_null_rate": sum(r["null_rate"] for r in rates) / len(rates) if rates else 0.0, "duplicates": _rows(Q.duplicate_rate(df))[0],
            "drift": [asdict(x) for x in Q.schema_drift(df, schema)], "observed_types": observed,
        }

    def monitoring_get_dq_metrics(self, schema: str = "JoinedCaseOutput") -> dict:
        return self._measures(self._ran(), get_schema(schema))

    def monitoring_get_dq_metrics_from_file(self, path: str, schema: str = "JoinedCaseOutput") -> dict:
        return self._measures(read_json_array(self.spark, path), get_schema(schema))

    def monitoring_add_sla(self, pipeline: str, seconds: float, owner: str) -> dict:
        self.alerts.set_limit(pipeline, seconds, owner)
        return {"pipeline": pipeline, "seconds": seconds, "owner": owner}

    def monitoring_evaluate_alerts(self) -> list[dict]:
        return [asdict(a) for a in self.alerts.evaluate(self.scheduler.results)]

    def monitoring_list_alerts(self, severity: str | None = None) -> list[dict]:
        return [asdict(a) for a in self.alerts.find(severity)]

    def monitoring_get_alert_summary(self) -> dict:
        return self.alerts.summary()

    # security
    def security_assign_role(self, user: str, role: str, by: str) -> dict:
        self.access.assign(by, user, role)
        return {"user": user, "role": role}

    def security_get_rbac_summary(self) -> dict:
        return self.access.summary()

    def security_get_audit_log(self, action: str | None = None) -> dict:
        return {"events": [asdict(e) for e in self.audit.find(action=action)], "summary": self.audit.summary()}

    def security_mark_field_sensitive(self, schema: str, name: str, by: str) -> dict:
        get_schema(schema).get(name)
        self.columns.mark(by, schema, name)
        return self.columns.summary()

    def security_unmark_field_sensitive(self, schema: str, name: str, by: str) -> dict:
        self.columns.mark(by, schema, name, False)
        return self.columns.summary()

    def security_get_field_visibility(self, schema: str, user: str) -> dict[str, bool]:
        return self.columns.visibility(user, schema, get_schema(schema).names)

    def security_filter_output(self, user: str, schema: str = "JoinedCaseOutput", limit: int = 10, remove: bool = False) -> list[dict]:
        return _rows(self.columns.view(self._ran().orderBy(self._contract().key).limit(limit), user, schema, remove))

    def security_get_column_security_summary(self) -> dict:
        return self.columns.summary()

    # ingestion, normalization, union
    def ingestion_get_cdc_summary(self) -> dict:
        return self.marks.summary()

    def ingestion_reset_cdc(self, source: str | None = None) -> dict:
        self.marks.reset(source)
        return self.marks.summary()

    def ingestion_get_failure_summary(self) -> dict:
        return self.ingested.summary()

    def normalization_preview_transform_chain(self, df: DataFrame, steps: list[dict[str, Any]], upto: int | None = None, limit: int = 5) -> list[dict]:
        chain = TransformChain([ChainStep(s["field"], s["transform"], s.get("params", {})) for s in steps])
        picked = range(len(chain.steps)) if upto is None else [upto]
        return [{"step": i, "field": chain.steps[i].field, "transform": chain.steps[i].transform, "rows": _rows(chain.preview(df, i, limit))} for i in picked]

    def union_check_schemas(self, names: list[str]) -> dict:
        errors = check_union({n: self.spark.createDataFrame([], get_schema(n).struct()) for n in names})
        return {"compatible": not errors, "errors": errors, "known": sorted(SCHEMAS)}

    def union_detect_duplicates(self, df: DataFrame, source: str = "source_system") -> list[dict]:
        return _rows(duplicate_flags(df, source))
