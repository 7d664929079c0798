"""Branches of a plan, differences, reviewed proposals, snapshots and rollback."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from millrace.plans.ir import Pipeline

MAIN = "main"


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@dataclass
class Change:
    kind: str  # added, removed, modified
    output: str
    op: str
    details: dict[str, tuple] = field(default_factory=dict)


def diff_plans(old: Pipeline, new: Pipeline) -> list[Change]:
    """Sources matched by their names, steps by their outputs; for modified ones, each differing part with its old and new value."""
    out = []
    x, y = ({s.name: asdict(s) for s in p.sources} for p in (old, new))
    for name in sorted(x.keys() | y.keys()):
        if name not in x or name not in y:
            out.append(Change("added" if name in y else "removed", name, "Source"))
        elif x[name] != y[name]:
            out.append(Change("modified", name, "Source", {k: (x[name][k], y[name][k]) for k in x[name] if x[name][k] != y[name][k]}))
    a, b = ({s.output: s.to_dict() for s in p.steps} for p in (old, new))
    for name in sorted(a.keys() | b.keys()):
        if name not in a:
            out.append(Change("added", name, b[name]["op"]))
        elif name not in b:
            out.append(Change("removed", name, a[name]["op"]))
        elif a[name] != b[name]:
            keys = sorted(a[name].keys() | b[name].keys())
            details = {k: (a[name].get(k), b[name].get(k)) for k in keys if a[name].get(k) != b[name].get(k)}
            if "on" in details:
                details |= _mapping_changes(a[name]["on"], b[name]["on"])
            out.append(Change("modified", name, b[name]["op"], details))
    return out


def _mapping_changes(old: list[dict], new: list[dict]) -> dict[str, tuple]:
    out = {}
    for i, (x, y) in enumerate(zip(old, new)):
        p, q = x.get("mapping") or {}, y.get("mapping") or {}
        out |= {f"on[{i}].mapping[{k}]": (p.get(k), q.get(k)) for k in sorted(p.keys() | q.keys()) if p.get(k) != q.get(k)}
    return out


def diff_frame(spark, old: Pipeline, new: Pipeline):
    rows = [(c.kind, c.output, c.op, ", ".join(sorted(c.details))) for c in diff_plans(old, new)]
    return spark.createDataFrame(rows, "kind string, output string, op string, details string")


@dataclass
class Branch:
    name: str
    plan: Pipeline
    base: Pipeline
    author: str
    created_at: str = field(default_factory=_now)
    merged: bool = False


@dataclass
class Proposal:
    id: str
    branch: str
    title: str
    author: str
    changes: list[Change]
    plan: Pipeline
    status: str = "open"  # open, approved, rejected, superseded, merged
    reviewer: str | None = None
    reason: str | None = None


@dataclass
class Snapshot:
    version: int
    plan: Pipeline
    by: str
    note: str
    at: str = field(default_factory=_now)


class PlanRepository:
    """Main, its branches, proposals and versions. What runs is Main; merging changes Main and deploys nothing."""

    def __init__(self, main: Pipeline, by: str = "system", path: str | None = None):
        self._main = main.copy()
        self.branches: dict[str, Branch] = {}
        self.proposals: dict[str, Proposal] = {}
        self.versions = [Snapshot(1, main.copy(), by, "first version")]
        self.path = Path(path) if path else None
        if self.path and self.path.exists():
            self._load(json.loads(self.path.read_text(encoding="utf-8")))

    def _save(self) -> None:
        """Everything to the file, if there's one; a new repository on that file goes on where this one is."""
        if self.path:
            plain = lambda x: json.loads(x.to_json()) if isinstance(x, Pipeline) else x
            flat = lambda o: {f.name: plain(getattr(o, f.name)) for f in fields(o)}
            state = {
                "main": plain(self._main), "branches": [flat(b) for b in self.branches.values()], "versions": [flat(v) for v in self.versions],
                "proposals": [{**flat(p), "changes": [asdict(c) for c in p.changes]} for p in self.proposals.values()],
            }
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(state, indent=1), encoding="utf-8")

    def _load(self, state: dict) -> None:
        plan = lambda x: Pipeline.from_json(json.dumps(x))
        self._main = plan(state["main"])
        self.branches = {b["name"]: Branch(**{**b, "plan": plan(b["plan"]), "base": plan(b["base"])}) for b in state["branches"]}
        self.versions = [Snapshot(**{**v, "plan": plan(v["plan"])}) for v in state["versions"]]
        self.proposals = {p["id"]: Proposal(**{**p, "plan": plan(p["plan"]), "changes": [Change(**c) for c in p["changes"]]}) for p in state["proposals"]}

    @property
    def main(self) -> Pipeline:
        return self._main.copy()

    def create_branch(self, name: str, author: str) -> Branch:
        if name.lower() == MAIN or name in self.branches:
            raise ValueError(f"branch {name!r} can't be created")
        self.branches[name] = Branch(name, self.main, self.main, author)
        self._save()
        return self.branches[name]

    def branch(self, name: str) -> Branch:
        if name not in self.branches:
            raise ValueError(f"no branch {name!r}")
        return self.branches[name]

    def update_branch(self, name: str, plan: Pipeline) -> Branch:
        b = self.branch(name)
        if b.merged:
            raise ValueError(f"branch {name!r} is merged and can't change any more")
        b.plan = plan.copy()
        self._save()
        return b

    def diff(self, name: str) -> list[Change]:
        return diff_plans(self._main, self.branch(name).plan)

    def propose(self, name: str, title: str, author: str) -> Proposal:
        """A proposal of the branch as it is now; what it holds doesn't change with the branch. Open ones give way."""
        b = self.branch(name)
        if b.merged:
            raise ValueError(f"branch {name!r} is merged")
        for p in self.proposals.values():
            if p.branch == name and p.status == "open":
                p.status = "superseded"
        p = Proposal(f"proposal_{len(self.proposals) + 1:04d}", name, title, author, self.diff(name), b.plan.copy())
        self.proposals[p.id] = p
        self._save()
        return p

    def proposal(self, pid: str) -> Proposal:
        if pid not in self.proposals:
            raise ValueError(f"no proposal {pid!r}")
        return self.proposals[pid]

    def list_proposals(self, status: str | None = None) -> list[Proposal]:
        return [p for p in self.proposals.values() if status in (None, p.status)]

    def review(self, pid: str, reviewer: str, approve: bool, reason: str | None = None) -> Proposal:
        p = self.proposal(pid)
        if p.status != "open":
            raise ValueError(f"{pid} is {p.status}")
        if reviewer == p.author:
            raise ValueError("a proposal is reviewed by somebody else")
        if not approve and not reason:
            raise ValueError("a rejection needs a reason")
        p.status, p.reviewer, p.reason = ("approved" if approve else "rejected"), reviewer, reason
        self._save()
        return p

    def merge(self, pid: str, by: str) -> Snapshot:
        p = self.proposal(pid)
        if p.status != "approved":
            raise ValueError(f"{pid} is {p.status}, not approved")
        self._main = p.plan.copy()
        p.status, self.branch(p.branch).merged = "merged", True
        return self._snapshot(by, f"merge of {pid}")

    def _snapshot(self, by: str, note: str) -> Snapshot:
        self.versions.append(Snapshot(len(self.versions) + 1, self.main, by, note))
        self._save()
        return self.versions[-1]

    def rollback(self, version: int, by: str) -> Snapshot:
        """Main as it was in `version`, as a new version; going back to what it is already is an error."""
        if not 1 <= version <= len(self.versions):
            raise ValueError(f"no version {version}")
        plan = self.versions[version - 1].plan
        if plan.to_json() == self._main.to_json():
            raise ValueError(f"version {version} is what Main is now")
        self._main = plan.copy()
        return self._snapshot(by, f"rollback to {version}")
