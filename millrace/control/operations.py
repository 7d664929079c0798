"""Schedules and builds, run history and alerts, and the gate before deployment."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality import ContractResult, check_contract, safe_to_deploy
from millrace.sources.connectors import write_json_array

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def _cron_field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"bad step in {text!r}")
        if body == "*":
            a, b = low, high
        elif "-" in body:
            a, b = map(int, body.split("-"))
        else:
            a = int(body)
            b = high if step else a
        if not (low <= a <= high and low <= b <= high and a <= b):
            raise ValueError(f"{text!r} isn't between {low} and {high}")
        out |= set(range(a, b + 1, every))
    return out


class Cron:
    """Five fields with `*`, lists, ranges and steps. All fields must hold, day of month and day of week too."""

    def __init__(self, text: str):
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"{text!r} hasn't five fields")
        self.text, self.fields = text, [_cron_field(p, *r) for p, r in zip(parts, _RANGES)]

    def matches(self, at: dt.datetime) -> bool:
        now = (at.minute, at.hour, at.day, at.month, (at.weekday() + 1) % 7)
        return all(n in f for n, f in zip(now, self.fields))

    def column(self, at: Column) -> Column:
        """Whether each of a column's times matches; null for a null time."""
        now = (F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1)
        out = at.isNotNull() | F.lit(None).cast("boolean")
        for n, allowed in zip(now, self.fields):
            out = out & n.isin(sorted(allowed))
        return out


@dataclass
class BuildResult:
    trigger_type: str
    trigger_name: str
    pipeline: str
    started_at: str
    completed_at: str = ""
    status: str = "success"  # success, validation_failed, build_failed
    record_count: int = 0
    error_count: int = 0
    is_safe: bool = False
    safety_reasons: list[str] = field(default_factory=list)
    error_message: str | None = None

    @property
    def seconds(self) -> float:
        try:
            return (dt.datetime.fromisoformat(self.completed_at) - dt.datetime.fromisoformat(self.started_at)).total_seconds()
        except ValueError:
            return 0.0


#: A build gives its valid rows, the number of rejected rows and the contract's verdict. It writes nothing.
Build = Callable[[], tuple[DataFrame, int, ContractResult]]


class Scheduler:
    """Runs builds when they're due, on an event or by hand. It never deploys: it has no gate and no writer."""

    def __init__(self, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc), path: str | None = None, build: Build | None = None):
        """With `path` schedules and triggers are kept in that file; those found there run `build`."""
        self.clock, self.path = clock, Path(path) if path else None
        self.schedules: dict[str, dict] = {}
        self.triggers: dict[str, dict] = {}
        self.results: list[BuildResult] = []
        if self.path and self.path.exists():
            kept = json.loads(self.path.read_text(encoding="utf-8"))
            self.schedules = {n: {"cron": Cron(s["cron"]), "pipeline": s["pipeline"], "build": build, "enabled": s["enabled"], "last": None} for n, s in kept["schedules"].items()}
            self.triggers = {n: {**t, "build": build} for n, t in kept["triggers"].items()}

    def _save(self) -> None:
        if self.path:
            kept = {
                "schedules": {n: {"cron": s["cron"].text, "pipeline": s["pipeline"], "enabled": s["enabled"]} for n, s in self.schedules.items()},
                "triggers": {n: {k: t[k] for k in ("event", "pipeline", "enabled")} for n, t in self.triggers.items()},
            }
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(kept, indent=1), encoding="utf-8")

    def add_schedule(self, name: str, cron: str, pipeline: str, build: Build) -> None:
        if name in self.schedules:
            raise ValueError(f"schedule {name!r} exists already")
        self.schedules[name] = {"cron": Cron(cron), "pipeline": pipeline, "build": build, "enabled": True, "last": None}
        self._save()

    def add_trigger(self, name: str, event: str, pipeline: str, build: Build) -> None:
        self.triggers[name] = {"event": event, "pipeline": pipeline, "build": build, "enabled": True}
        self._save()

    def _schedule(self, name: str) -> dict:
        if name not in self.schedules:
            raise ValueError(f"no schedule {name!r}")
        return self.schedules[name]

    def enable(self, name: str, on: bool = True) -> None:
        self._schedule(name)["enabled"] = on
        self._save()

    def remove(self, name: str) -> None:
        self._schedule(name)
        del self.schedules[name]
        self._save()

    def check(self, at: dt.datetime | None = None) -> list[BuildResult]:
        """Run what is due, each schedule at most once a minute."""
        at = at or self.clock()
        minute = at.replace(second=0, microsecond=0)
        out = []
        for name, s in self.schedules.items():
            if s["enabled"] and s["cron"].matches(at) and s["last"] != minute:
                s["last"] = minute
                out.append(self._run("schedule", name, s["pipeline"], s["build"]))
        return out

    def fire(self, event: str) -> list[BuildResult]:
        return [self._run("event", n, t["pipeline"], t["build"]) for n, t in self.triggers.items() if t["event"] == event and t["enabled"]]

    def run_now(self, pipeline: str, build: Build, by: str = "manual") -> BuildResult:
        return self._run("manual", by, pipeline, build)

    def _run(self, kind: str, name: str, pipeline: str, build: Build) -> BuildResult:
        r = BuildResult(kind, name, pipeline, self.clock().isoformat())
        try:
            frame, r.error_count, contract = build()
            r.record_count = frame.count()
            r.is_safe, r.safety_reasons = safe_to_deploy(r.error_count, contract)
            r.status = "success" if r.is_safe else "validation_failed"
        except Exception as problem:  # noqa: BLE001
            r.status, r.error_message = "build_failed", f"{type(problem).__name__}: {problem}"[:500]
        r.completed_at = self.clock().isoformat()
        self.results.append(r)
        return r

    def latest(self, pipeline: str | None = None) -> BuildResult | None:
        return next((r for r in reversed(self.results) if pipeline in (None, r.pipeline)), None)

    def summary(self) -> dict:
        return {"schedules": len(self.schedules), "triggers": len(self.triggers), "builds": len(self.results), "by_status": dict(Counter(r.status for r in self.results))}

    def frame(self, spark) -> DataFrame:
        """The run history as a table for `run_trends` and `run_alerts`."""
        rows = [(f"run_{i:04d}", r.pipeline, r.status, r.started_at, r.seconds, r.record_count) for i, r in enumerate(self.results)]
        return spark.createDataFrame(rows, "run_id string, pipeline string, status string, at string, seconds double, rows bigint")


@dataclass
class Alert:
    alert_id: str
    kind: str
    severity: str
    pipeline: str
    run_id: str
    owner: str
    reason: str


class Alerts:
    """Alerts on a run history; each run raises each kind once, however often it's evaluated."""

    def __init__(self, path: str | None = None):
        self.limits: dict[str, tuple[float, str]] = {}
        self.raised: list[Alert] = []
        self.path = Path(path) if path else None

    def set_limit(self, pipeline: str, seconds: float, owner: str) -> None:
        if seconds <= 0:
            raise ValueError("a limit is more than 0 seconds")
        self.limits[pipeline] = (seconds, owner)

    def evaluate(self, results: list[BuildResult]) -> list[Alert]:
        seen = {(a.run_id, a.kind) for a in self.raised}
        new = []
        for i, r in enumerate(results):
            limit, owner = self.limits.get(r.pipeline, (None, ""))
            if r.status != "success":
                found = ("run_failure", "critical", r.error_message or "; ".join(r.safety_reasons) or r.status)
            elif limit is not None and r.seconds > limit:
                found = ("sla_breach", "warning", f"took {r.seconds:g} s, the limit is {limit:g} s")
            else:
                continue
            run = f"run_{i:04d}"
            if (run, found[0]) not in seen:
                new.append(Alert(f"alert_{len(self.raised) + len(new):04d}", found[0], found[1], r.pipeline, run, owner, found[2]))
        self.raised += new
        if self.path and new:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps([asdict(a) for a in self.raised], indent=2))
        return new

    def find(self, severity: str | None = None, pipeline: str | None = None) -> list[Alert]:
        return [a for a in self.raised if severity in (None, a.severity) and pipeline in (None, a.pipeline)]

    def summary(self) -> dict:
        return {"total": len(self.raised), "by_kind": dict(Counter(a.kind for a in self.raised)), "by_severity": dict(Counter(a.severity for a in self.raised))}


class DeployBlocked(RuntimeError):
    pass


class DeployGate:
    """Writes an output only if it was validated as the run it is, found safe, and approved."""

    def __init__(self, log: str | None = None):
        self.log = Path(log) if log else None
        self._verdicts: dict[str, tuple[bool, list[str]]] = {}

    def validate(self, run_id: str, df: DataFrame, schema, build_errors: int = 0, key: str | None = None) -> tuple[bool, list[str]]:
        verdict = safe_to_deploy(build_errors, check_contract(df, schema, key))
        self._verdicts = {run_id: verdict}  # a verdict on another run is worth nothing
        return verdict

    def deploy(self, run_id: str, df: DataFrame, path: str, approved: bool, fmt: str = "json_array", version: str | None = None, by: str | None = None) -> int:
        if run_id not in self._verdicts:
            raise DeployBlocked(f"run {run_id} hasn't been validated")
        safe, reasons = self._verdicts[run_id]
        if not safe:
            raise DeployBlocked("not safe: " + "; ".join(reasons))
        if approved is not True:
            raise DeployBlocked("not approved")
        if fmt == "json_array":
            n = write_json_array(df, path)
        else:
            df.write.mode("overwrite").format(fmt).save(path)
            n = df.sparkSession.read.format(fmt).load(path).count()
        if self.log:
            self.log.parent.mkdir(parents=True, exist_ok=True)
            more = (f" | version={version}" if version else "") + (f" | deployed_by={by}" if by else "")
            with self.log.open("a", encoding="utf-8") as f:
                f.write(f"{dt.datetime.now(dt.timezone.utc).isoformat()} | Deployed {n} records to {path} | approved=True{more}\n")
        return n
