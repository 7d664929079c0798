"""From a plan to lazy DataFrames: one path, checked first, lineage recorded on the way."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.control.lineage import LineageStore
from millrace.functions.transforms import TRANSFORMS, TransformRegistry
from millrace.operators import relational as R
from millrace.plans.check import PlanChecker
from millrace.plans.ir import Aggregate, Cast, Filter, Join, Map, Pipeline, SetStep, Step, Union, WindowStep
from millrace.sources.connectors import CONNECTORS, ConnectorRegistry

Mapper = Callable[[DataFrame], DataFrame]


class PlanError(ValueError):
    pass


def ordered_steps(plan: Pipeline) -> list[Step]:
    """The steps with every step after those it reads; a circle or an unknown name is an error."""
    made = {s.name for s in plan.sources}
    left, out = list(plan.steps), []
    while left:
        ready = [s for s in left if all(i in made for i in s.inputs)]
        if not ready:
            raise PlanError("; ".join(f"{s.output} needs {[i for i in s.inputs if i not in made]}" for s in left))
        out += ready
        made |= {s.output for s in ready}
        left = [s for s in left if s not in ready]
    return out


class Compiler:
    """Compiles plans; mappers turn a whole frame into another one."""

    def __init__(self, spark: SparkSession, connectors: ConnectorRegistry = CONNECTORS, transforms: TransformRegistry = TRANSFORMS):
        self.spark, self.connectors, self.transforms = spark, connectors, transforms
        self.mappers: dict[str, Mapper] = {}

    def register_mapper(self, name: str, mapper: Mapper) -> None:
        self.mappers[name] = mapper

    def compile(self, plan: Pipeline, frames: dict[str, DataFrame] | None = None, lineage: LineageStore | None = None, counted: Collection[str] = ()) -> dict[str, DataFrame]:
        """Every named dataset of the plan, lazily. `frames` stands in for sources of the same names.

        `counted` names nested mapped joins of whose lists only the number is wanted: they give the left columns,
        matched_category and matched_article_count, and no list is built. Their lineage is that of the nested join.
        """
        given = dict(frames or {})
        out = {s.name: given[s.name] if s.name in given else self.connectors.read(self.spark, s) for s in plan.sources}
        arranged = Pipeline(plan.name, plan.sources, ordered_steps(plan), plan.contract)
        checked = PlanChecker({n: d.schema for n, d in out.items()}, self.transforms).check(arranged, self.mappers)
        if not checked.ok:
            raise PlanError("; ".join(checked.errors))
        for i, step in enumerate(arranged.steps):
            if step.output in counted and isinstance(step, Join) and step.shape == "nested" and step.type == "left" and len(step.on) == 1 and step.on[0].mapping is not None:
                out[step.output] = R.mapping_join_count(out[step.left], out[step.right], step.on[0].left, step.on[0].mapping, step.on[0].right)
                names = ["case", "matched_category", "matched_articles"]
            else:
                try:
                    out[step.output] = self._step(step, out)
                except AnalysisException as problem:  # a condition or a type that only the analyzer can judge
                    raise PlanError(f"step {i} ({step.op}): {problem}") from problem
                names = out[step.output].columns
            if lineage is not None:
                lineage.record_step(i, step, {n: out[n].columns for n in step.inputs}, names)
        return out

    def run(self, plan: Pipeline, frames: dict[str, DataFrame] | None = None, lineage: LineageStore | None = None) -> DataFrame:
        if plan.output is None:
            raise PlanError("the plan has no steps")
        return self.compile(plan, frames, lineage)[plan.output]

    def _step(self, s: Step, d: dict[str, DataFrame]) -> DataFrame:
        if isinstance(s, Cast):
            return R.cast_column(d[s.input], s.field, s.to)
        if isinstance(s, Map):
            if s.mapper:
                return self.mappers[s.mapper](d[s.input])
            df = d[s.input]
            value = F.col(f"`{s.field}`") if s.field in df.columns else F.lit(None).cast("string")
            return df.withColumn(s.field, self.transforms.apply(s.transform, value, **s.params))
        if isinstance(s, Filter):
            return R.filter_rows(d[s.input], s.condition)
        if isinstance(s, Join):
            mapped = any(k.mapping is not None for k in s.on)
            names = ("case", "matched_articles") if mapped else ("record", "matched")
            return R.join_frames(d[s.left], d[s.right], s.on, s.type, s.shape, s.one_to_many or mapped, s.null_safe, s.order_by, *names)
        if isinstance(s, Aggregate):
            return R.aggregate_rows(d[s.input], s.group_by, s.aggregations, s.grouping)
        if isinstance(s, WindowStep):
            return R.window_column(d[s.input], s.function, s.alias, s.partition_by, s.order_by, s.field, s.descending, s.offset, s.frame, s.tie, s.frame_kind)
        if isinstance(s, Union):
            return R.union_frames({n: d[n] for n in s.sources})
        if isinstance(s, SetStep):
            return R.set_rows([d[n] for n in s.sources], s.kind, s.all)
        raise PlanError(f"no such step: {s.op}")
