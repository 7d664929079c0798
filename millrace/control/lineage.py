"""Where each field comes from: edges recorded by the compiler, and questions about them."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from dataclasses import asdict, dataclass, field

from millrace.plans.ir import Aggregate, Cast, Filter, Join, Map, SetStep, Step, Union, WindowStep


@dataclass
class Edge:
    """`output_field` of `output` derives from `input_fields` of `input`."""

    record_id: str
    step: int
    op: str
    output: str
    output_field: str
    input: str
    input_fields: list[str]
    params: dict[str, str] = field(default_factory=dict)
    join_rule: str | None = None
    confidence: float | None = None
    review_status: str | None = None
    at: str = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).isoformat())


class LineageStore:
    def __init__(self):
        self.edges: list[Edge] = []

    def _add(self, step: int, s: Step, out_field: str, source: str, fields: list[str], **more) -> None:
        self.edges.append(Edge(f"lineage_{len(self.edges):04d}", step, s.op, s.output, out_field, source, fields, **more))

    def record_step(self, i: int, s: Step, inputs: dict[str, list[str]], output: list[str]) -> None:
        """One edge per output field and input dataset it draws on; needs column names only."""
        if isinstance(s, Join):
            rule = " AND ".join(f"{k.left} = {k.right}" for k in s.on)
            extra = {"join_rule": rule, "confidence": s.confidence, "review_status": s.review_status}
            left, right = inputs[s.left], inputs[s.right]
            for f in output:
                if f in left:
                    self._add(i, s, f, s.left, [f], **extra)
                elif f == "matched_category":
                    self._add(i, s, f, s.left, [k.left for k in s.on if k.mapping is not None], **extra)
                elif f in right or f.removeprefix("right_") in right:
                    self._add(i, s, f, s.right, [f if f in right else f.removeprefix("right_")], **extra)
                elif f in ("record", "case"):
                    self._add(i, s, f, s.left, list(left), **extra)
                else:
                    self._add(i, s, f, s.right, list(right), **extra)
            return
        for f in output:
            if isinstance(s, (Union, SetStep)):
                for n in s.sources:
                    self._add(i, s, f, n, [f])
                continue
            source = s.inputs[0]
            fields, params = [f], {}
            if isinstance(s, Cast) and f == s.field:
                params = {"to": s.to}
            elif isinstance(s, Map) and s.mapper:
                fields, params = list(inputs[source]) if f not in inputs[source] else [f], {"mapper": s.mapper}
            elif isinstance(s, Map) and f == s.field:
                params = {"transform": s.transform or "", **{k: str(v) for k, v in s.params.items()}}
            elif isinstance(s, Filter):
                params = {"condition": s.condition}
            elif isinstance(s, Aggregate) and f not in s.group_by:
                a = next(a for a in s.aggregations if a.alias == f)
                fields, params = ([] if a.field == "*" else [a.field]), {"function": a.function}
            elif isinstance(s, WindowStep) and f == s.alias:
                fields, params = [*s.partition_by, *s.order_by, *([s.field] if s.field else [])], {"function": s.function}
            self._add(i, s, f, source, fields, params=params)

    def by_dataset(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.output == name]

    def by_field(self, dataset: str, name: str) -> list[Edge]:
        return [e for e in self.edges if e.output == dataset and e.output_field == name]

    def by_operator(self, op: str) -> list[Edge]:
        return [e for e in self.edges if e.op == op]

    def joins(self, dataset: str | None = None) -> list[dict]:
        """Each join once: its rule, sides, confidence and review."""
        out: dict[tuple, dict] = {}
        for e in self.edges:
            if e.join_rule and dataset in (None, e.output):
                found = out.setdefault((e.output, e.join_rule), {"output": e.output, "rule": e.join_rule, "sides": [], "confidence": e.confidence, "review_status": e.review_status})
                if e.input not in found["sides"]:
                    found["sides"].append(e.input)
        return list(out.values())

    def trace(self, dataset: str, name: str) -> list[Edge]:
        """All edges behind one field, field by field, through joins and unions alike; nearest first."""
        out, seen, todo = [], set(), [(dataset, name)]
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            for e in self.by_field(*at):
                out.append(e)
                todo += [(e.input, f) for f in e.input_fields]
        return out

    def source_fields(self, dataset: str, name: str) -> list[tuple[str, str]]:
        """The (dataset, field) pairs a field goes back to that nothing derives."""
        made = {(e.output, e.output_field) for e in self.edges}
        ends = {(e.input, f) for e in self.trace(dataset, name) for f in e.input_fields}
        return sorted(ends - made)

    def explain(self, dataset: str, name: str) -> list[str]:
        return [f"{e.output}.{e.output_field} <- {e.op}({e.input}: {', '.join(e.input_fields)})" + (f" on {e.join_rule}" if e.join_rule else "") for e in self.trace(dataset, name)]

    def inferred(self, dataset: str, name: str) -> bool:
        return any(e.confidence is not None for e in self.trace(dataset, name))

    def confidence(self, dataset: str, name: str) -> float | None:
        """The least confidence on the way; None if nothing was inferred."""
        return min((e.confidence for e in self.trace(dataset, name) if e.confidence is not None), default=None)

    def summary(self) -> dict:
        return {"edges": len(self.edges), "by_operator": dict(Counter(e.op for e in self.edges)), "datasets": sorted({e.output for e in self.edges})}

    def frame(self, spark):
        rows = [tuple(asdict(e)[k] for k in ("record_id", "step", "op", "output", "output_field", "input", "input_fields", "join_rule", "review_status")) for e in self.edges]
        ddl = "record_id string, step int, op string, output string, output_field string, input string, input_fields array<string>, join_rule string, review_status string"
        return spark.createDataFrame(rows, ddl)
