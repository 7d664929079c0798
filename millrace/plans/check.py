"""Static check of a plan: what can be known before any data is read."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import types as T

from millrace.functions.transforms import TRANSFORMS, TransformRegistry
from millrace.functions.types import SCHEMAS, TYPES, type_name
from millrace.plans.ir import Aggregate, Cast, Filter, Join, Map, Pipeline, SetStep, Step, Union, WindowStep

JOIN_TYPES = ("inner", "left", "right", "full", "semi", "anti")
AGGREGATES = ("sum", "count", "avg", "min", "max", "count_distinct", "approx_distinct")
WINDOWED = ("sum", "count", "avg", "min", "max")
SET_KINDS = {"distinct": 1, "intersect": 2, "except": 2}
RANKINGS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
SHIFTS = ("lag", "lead", "first", "last")
_SIMPLE = re.compile(r"^\s*`?([A-Za-z_][\w .]*?)`?\s*(==|!=)\s*(.*?)\s*$", re.S)


def parse_condition(text: str) -> tuple[str, str, str] | None:
    """(field, operator, literal) of `field == 'value'` or `field != 'value'`; None if it's another expression."""
    m = _SIMPLE.match(text)
    if not m:
        return None
    value = m[3]
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"" and value[0] not in value[1:-1]:
        return m[1].strip(), m[2], value[1:-1]
    return (m[1].strip(), m[2], value) if re.fullmatch(r"[\w.\-]+", value) else None


@dataclass
class CheckResult:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    steps: dict[str, list[str]] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors


class PlanChecker:
    """Knows the datasets' schemas as far as they're declared, and follows them through the steps."""

    def __init__(self, schemas: dict[str, T.StructType] | None = None, transforms: TransformRegistry = TRANSFORMS):
        self.given, self.transforms = schemas or {}, transforms

    def check(self, plan: Pipeline, mappers: Collection[str] = ()) -> CheckResult:
        out = CheckResult()
        known: dict[str, T.StructType | None] = {}
        for s in plan.sources:
            known[s.name] = self.given.get(s.name) or (SCHEMAS[s.schema_name].struct() if s.schema_name in SCHEMAS else None)
        for i, step in enumerate(plan.steps):
            errors = [f"step {i} ({step.op}): no dataset {x!r} before it" for x in step.inputs if x not in known]
            if step.output in known:
                errors.append(f"step {i} ({step.op}): {step.output!r} is defined already")
            if not errors:
                errors += [f"step {i} ({step.op}): {e}" for e in self._step(step, known, mappers, out.warnings)]
            out.errors += errors
            out.steps[step.output] = errors
            known[step.output] = self._schema(step, known)
        if plan.contract and plan.contract not in SCHEMAS:
            out.errors.append(f"unknown contract {plan.contract!r}")
        return out

    def _schema(self, step: Step, known: dict) -> T.StructType | None:
        if isinstance(step, (Filter, Union, SetStep)):
            return known.get(step.inputs[0]) if step.inputs else None
        if isinstance(step, Map) and step.transform:
            return None if step.field is None else known.get(step.input)
        if isinstance(step, Cast) and known.get(step.input) and step.to in TYPES:
            return T.StructType([T.StructField(f.name, TYPES.get(step.to).spark if f.name == step.field else f.dataType) for f in known[step.input].fields])
        return None

    def _missing(self, schema: T.StructType | None, names) -> list[str]:
        return [] if schema is None else [f"no field {n!r}" for n in names if n not in schema.names]

    def _step(self, step: Step, known: dict, mappers, warnings: list[str]) -> list[str]:
        errors: list[str] = []
        if isinstance(step, Cast):
            errors += [f"unknown type {step.to!r}"] if step.to not in TYPES else []
            errors += self._missing(known[step.input], [step.field])
        elif isinstance(step, Map):
            if bool(step.mapper) == bool(step.transform):
                errors.append("one of mapper and transform is needed")
            elif step.mapper and step.mapper not in mappers:
                errors.append(f"unknown mapper {step.mapper!r}")
            elif step.transform and step.transform not in self.transforms:
                errors.append(f"unknown transform {step.transform!r}")
            elif step.transform and not step.field:
                errors.append("a transform needs a field")
        elif isinstance(step, Filter):
            simple = parse_condition(step.condition)
            if not step.condition.strip():
                errors.append("no condition")
            elif simple:
                errors += self._missing(known[step.input], [simple[0]])
        elif isinstance(step, Join):
            errors += [f"join type {step.type!r} is none of {JOIN_TYPES}"] if step.type not in JOIN_TYPES else []
            errors += [] if step.on else ["no keys"]
            errors += [f"shape {step.shape!r} is neither nested nor flat"] if step.shape not in ("nested", "flat") else []
            errors += [f"a {step.type} join has no matches to nest"] if step.type in ("semi", "anti") and step.shape == "nested" else []
            errors += self._missing(known[step.right], [step.order_by] if step.order_by else [])
            for k in step.on:
                errors += self._missing(known[step.left], [k.left]) + self._missing(known[step.right], [k.right])
                a, b = known[step.left], known[step.right]
                if a and b and k.left in a.names and k.right in b.names and not k.mapping and type_name(a[k.left].dataType) != type_name(b[k.right].dataType):
                    warnings.append(f"{step.output}: {k.left} and {k.right} have different types")
            if step.review_status == "unreviewed":
                warnings.append(f"{step.output}: the join hasn't been reviewed")
        elif isinstance(step, Aggregate):
            errors += [f"unknown function {a.function!r}" for a in step.aggregations if a.function not in AGGREGATES]
            sets = step.grouping if isinstance(step.grouping, list) else []
            errors += [f"grouping {step.grouping!r} is none of plain, rollup, cube"] if not isinstance(step.grouping, list) and step.grouping not in ("plain", "rollup", "cube") else []
            errors += [f"grouping set {x} holds no key {k!r}" for x in sets for k in x if k not in step.group_by]
            errors += self._missing(known[step.input], [*step.group_by, *[a.field for a in step.aggregations if a.field != "*"]])
        elif isinstance(step, WindowStep):
            if step.function not in (*RANKINGS, *SHIFTS, *WINDOWED):
                errors.append(f"unknown function {step.function!r}")
            if step.function in (*RANKINGS, *SHIFTS) and not step.order_by:
                errors.append(f"{step.function} needs an order")
            errors += [f"frame kind {step.frame_kind!r} is neither rows nor range"] if step.frame_kind not in ("rows", "range") else []
            errors += ["a range frame needs one ordering column"] if step.frame_kind == "range" and (len(step.order_by) != 1 or step.tie) else []
            errors += self._missing(known[step.input], [*step.partition_by, *step.order_by, *[c for c in (step.field, step.tie) if c]])
        elif isinstance(step, SetStep) and SET_KINDS.get(step.kind) != len(step.sources):
            errors.append(f"{step.kind!r} of {len(step.sources)} datasets; known are distinct of one, intersect and except of two")
        elif isinstance(step, (Union, SetStep)):
            schemas = [(n, known[n]) for n in step.sources if known[n] is not None]
            for n, s in schemas[1:]:
                if set(s.names) != set(schemas[0][1].names):
                    errors.append(f"{n!r} and {schemas[0][0]!r} differ in {sorted(set(s.names) ^ set(schemas[0][1].names))}")
            errors += [] if step.sources else ["nothing to unite"]
        return errors
