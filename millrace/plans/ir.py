"""The plan: eight kinds of steps over named datasets, as plain data that goes to JSON and back."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, fields
from dataclasses import field as made
from typing import Any, ClassVar


@dataclass
class Step:
    """One step; `output` names what it makes."""

    output: str
    op: ClassVar[str] = ""

    @property
    def inputs(self) -> list[str]:
        return [self.input]  # type: ignore[attr-defined]

    def to_dict(self) -> dict[str, Any]:
        return {"op": self.op, **asdict(self)}

    def summary(self) -> str:
        raise NotImplementedError


@dataclass
class Cast(Step):
    input: str = ""
    field: str = ""
    to: str = "String"
    op: ClassVar[str] = "Cast"

    def summary(self) -> str:
        return f"{self.output} := CAST {self.input}.{self.field} AS {self.to}"


@dataclass
class Map(Step):
    """A whole-record mapper (`mapper`), or a transform of one field (`transform`, `field`, `params`)."""

    input: str = ""
    mapper: str | None = None
    transform: str | None = None
    field: str | None = None
    params: dict[str, Any] = made(default_factory=dict)
    op: ClassVar[str] = "Map"

    def summary(self) -> str:
        return f"{self.output} := MAP {self.input} BY {self.mapper or f'{self.transform}({self.field})'}"


@dataclass
class Filter(Step):
    input: str = ""
    condition: str = ""
    op: ClassVar[str] = "Filter"

    def summary(self) -> str:
        return f"{self.output} := FILTER {self.input} WHERE {self.condition}"


@dataclass
class JoinKey:
    left: str
    right: str
    mapping: dict[str, str] | None = None


@dataclass
class Join(Step):
    """All key pairs must meet. A pair with a mapping compares mapping[left] with right and never meets on null."""

    left: str = ""
    right: str = ""
    on: list[JoinKey] = made(default_factory=list)
    type: str = "left"
    one_to_many: bool = True
    shape: str = "nested"
    null_safe: bool = False
    review_status: str = "approved"
    confidence: float | None = None
    #: Column of the right side that says which match is the first one, where only that is wanted.
    order_by: str | None = None
    op: ClassVar[str] = "Join"

    @property
    def inputs(self) -> list[str]:
        return [self.left, self.right]

    def summary(self) -> str:
        keys = " AND ".join(f"{'map(' * bool(k.mapping)}{k.left}{')' * bool(k.mapping)} = {k.right}" for k in self.on)
        many = "" if self.one_to_many else " FIRST MATCH"
        return f"{self.output} := {self.type.upper()} JOIN {self.left} WITH {self.right} ON {keys}{many}"


@dataclass
class Aggregation:
    function: str
    field: str
    alias: str


@dataclass
class Aggregate(Step):
    input: str = ""
    group_by: list[str] = made(default_factory=list)
    aggregations: list[Aggregation] = made(default_factory=list)
    #: plain, rollup, cube, or the grouping sets as lists of keys.
    grouping: str | list[list[str]] = "plain"
    op: ClassVar[str] = "Aggregate"

    def summary(self) -> str:
        made = ", ".join(f"{a.function}({a.field}) AS {a.alias}" for a in self.aggregations)
        return f"{self.output} := AGGREGATE {self.input} BY {', '.join(self.group_by) or 'nothing'}: {made}"


@dataclass
class WindowStep(Step):
    input: str = ""
    partition_by: list[str] = made(default_factory=list)
    order_by: list[str] = made(default_factory=list)
    function: str = "row_number"
    alias: str = "row_number"
    field: str | None = None
    descending: bool = False
    offset: int = 1
    frame: list[int | None] | None = None
    #: rows, or range (the frame's ends are then differences of the ordering column).
    frame_kind: str = "rows"
    #: Column that decides between rows of equal order.
    tie: str | None = None
    op: ClassVar[str] = "Window"

    def summary(self) -> str:
        return f"{self.output} := WINDOW {self.input} {self.function}({self.field or ''}) OVER ({', '.join(self.partition_by)}; {', '.join(self.order_by)}) AS {self.alias}"


@dataclass
class Union(Step):
    sources: list[str] = made(default_factory=list)
    op: ClassVar[str] = "Union"

    @property
    def inputs(self) -> list[str]:
        return list(self.sources)

    def summary(self) -> str:
        return f"{self.output} := UNION {', '.join(self.sources)}"


@dataclass
class SetStep(Step):
    """distinct (of one dataset), intersect or except (of two), of whole rows; nulls equal nulls."""

    sources: list[str] = made(default_factory=list)
    kind: str = "distinct"
    all: bool = False
    op: ClassVar[str] = "Set"

    @property
    def inputs(self) -> list[str]:
        return list(self.sources)

    def summary(self) -> str:
        return f"{self.output} := {self.kind.upper()}{' ALL' * self.all} {', '.join(self.sources)}"


KINDS: dict[str, type[Step]] = {c.op: c for c in (Cast, Map, Filter, Join, Aggregate, WindowStep, Union, SetStep)}


def step_from_dict(data: dict[str, Any]) -> Step:
    data = dict(data)
    op = data.pop("op", None)
    if op not in KINDS:
        raise ValueError(f"unknown operator {op!r}; known are {sorted(KINDS)}")
    kind = KINDS[op]
    unknown = set(data) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{op} has no {sorted(unknown)}")
    if kind is Join:
        data["on"] = [k if isinstance(k, JoinKey) else JoinKey(**k) for k in data.get("on", [])]
    if kind is Aggregate:
        data["aggregations"] = [a if isinstance(a, Aggregation) else Aggregation(**a) for a in data.get("aggregations", [])]
    return kind(**data)


@dataclass
class Source:
    name: str
    format: str
    location: str
    schema_name: str | None = None
    options: dict[str, Any] = made(default_factory=dict)


@dataclass
class Pipeline:
    name: str
    sources: list[Source] = made(default_factory=list)
    steps: list[Step] = made(default_factory=list)
    contract: str | None = None

    @property
    def output(self) -> str | None:
        return self.steps[-1].output if self.steps else None

    def add(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def copy(self) -> Pipeline:
        return copy.deepcopy(self)

    def to_json(self) -> str:
        data = {"name": self.name, "sources": [asdict(s) for s in self.sources], "steps": [s.to_dict() for s in self.steps], "contract": self.contract}
        return json.dumps(data, indent=2, sort_keys=False)

    @staticmethod
    def from_json(text: str) -> Pipeline:
        data = json.loads(text)
        return Pipeline(data["name"], [Source(**s) for s in data.get("sources", [])], [step_from_dict(s) for s in data.get("steps", [])], data.get("contract"))

    def pseudocode(self) -> str:
        """One line for each source and step."""
        lines = [f"PIPELINE {self.name}"] + [f"  {s.name} := READ {s.format} {s.location}" for s in self.sources] + [f"  {s.summary()}" for s in self.steps]
        return "\n".join(lines + ([f"  OUTPUT {self.output} AS {self.contract}"] if self.contract else []))
