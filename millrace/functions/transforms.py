"""Named column transforms, the operations the canonical types declare, and chains of transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of the text and the format it's parsed with, tried in this order.
TIMESTAMP_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
)


def empty_to_none(value: Column) -> Column:
    """null for the empty string; white space is kept."""
    return F.nullif(value.cast("string"), F.lit(""))


def trim_whitespace(value: Column) -> Column:
    """Without white space of any kind at both ends; null and "" give null, white space alone gives ""."""
    return F.regexp_replace(empty_to_none(value), r"(?U)^\s+|\s+$", "")


def parse_timestamp(value: Column) -> Column:
    """timestamp_ntz of a text in one of four forms; null for all else, never an error."""
    text = value.cast("string")
    tries = [F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form))) for pattern, form in TIMESTAMP_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def prefix_id(value: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def flag_status(value: Column, yes: str = "Closed", no: str = "Open") -> Column:
    """`yes` for true, `no` for false and null."""
    return F.when(value.cast("boolean"), F.lit(yes)).otherwise(F.lit(no))


def lookup(value: Column, mapping: dict[str, Any]) -> Column:
    """The mapping's entry for a value; null for null and for values it lacks."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[value]


def normalize_name(value: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(value), r"[\s_\-]+", "")


Transform = Callable[..., Column]


class TransformRegistry:
    """Transforms by name: functions from a column (and keyword parameters) to a column."""

    def __init__(self):
        self._known: dict[str, Transform] = {
            "trim_whitespace": trim_whitespace, "empty_to_none": empty_to_none, "parse_timestamp": parse_timestamp, "prefix_id": prefix_id,
            "flag_status": flag_status, "lookup": lookup, "normalize_name": normalize_name,
        }

    def register(self, name: str, transform: Transform) -> None:
        self._known[name] = transform

    def get(self, name: str) -> Transform:
        if name not in self._known:
            raise ValueError(f"unknown transform {name!r}; known are {self.names()}")
        return self._known[name]

    def apply(self, name: str, value: Column, **params) -> Column:
        """`field` only says which column is meant; it's never passed on."""
        params.pop("field", None)
        return self.get(name)(value, **params)

    def names(self) -> list[str]:
        return sorted(self._known)

    def __contains__(self, name: str) -> bool:
        return name in self._known


TRANSFORMS = TransformRegistry()


@dataclass(frozen=True)
class ChainStep:
    field: str
    transform: str
    params: dict[str, Any] = field(default_factory=dict)


class TransformChain:
    """Ordered steps of one field each. Catalyst merges them into one projection."""

    def __init__(self, steps: list[ChainStep] | None = None, registry: TransformRegistry = TRANSFORMS):
        self.steps, self.registry = list(steps or []), registry

    def add(self, field: str, transform: str, **params) -> TransformChain:
        self.registry.get(transform)
        self.steps.append(ChainStep(field, transform, params))
        return self

    def _one(self, df: DataFrame, step: ChainStep) -> DataFrame:
        value = F.col(f"`{step.field}`") if step.field in df.columns else F.lit(None).cast("string")
        return df.withColumn(step.field, self.registry.apply(step.transform, value, **step.params))

    def apply(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """All steps, or those from 0 to `upto`; a field that's absent counts as null and is added."""
        if upto is not None and not 0 <= upto < len(self.steps):
            raise IndexError(f"no step {upto}; there are {len(self.steps)}")
        for step in self.steps if upto is None else self.steps[: upto + 1]:
            df = self._one(df, step)
        return df

    def preview(self, df: DataFrame, upto: int, rows: int = 5) -> DataFrame:
        return self.apply(df, upto).limit(rows)

    def preview_all(self, df: DataFrame, rows: int = 5) -> list[tuple[ChainStep, DataFrame]]:
        return [(s, self.preview(df, i, rows)) for i, s in enumerate(self.steps)]

    def plan_steps(self, source: str, output: str) -> list:
        """The chain as plan steps named `{source}_step_{i}`, the last one `output`."""
        from millrace.plans.ir import Map

        names = [f"{source}_step_{i}" for i in range(len(self.steps) - 1)] + [output]
        return [
            Map(input=source if i == 0 else names[i - 1], output=names[i], transform=s.transform, field=s.field, params=dict(s.params))
            for i, s in enumerate(self.steps)
        ]


def _point(text: Column, k: int) -> Column:
    return F.regexp_extract(text, r"(?i)^\s*POINT\s*\(\s*(-?[\d.eE+\-]+)\s+(-?[\d.eE+\-]+)\s*\)", k).try_cast("double")


def wkt_points(text: Column) -> Column:
    """The (x, y) of a WKT point, line or one-ring polygon, in their order."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?[\d.]+(?:[eE][+\-]?\d+)?\s+-?[\d.]+(?:[eE][+\-]?\d+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).cast("double").alias("x"), F.regexp_extract(p, r"(\S+)$", 1).cast("double").alias("y")))


def _ring_sum(points: Column, term: Callable[[Column, Column], Column]) -> Column:
    following = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    both = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), following, term)
    return F.aggregate(both, F.lit(0.0), lambda a, x: a + x)


def wkt_area(text: Column) -> Column:
    """Area of a one-ring polygon by the shoelace formula; 0 for points and lines."""
    return F.abs(_ring_sum(wkt_points(text), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def wkt_centroid(text: Column) -> Column:
    """Mean of the points (a closing point that repeats the first one is left out), as WKT."""
    points = wkt_points(text)
    n = F.size(points)
    open_ring = F.when((n > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, F.lit(1), n - 1)).otherwise(points)
    mean = lambda k: F.aggregate(open_ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(open_ring)
    return F.concat(F.lit("POINT ("), mean("x").cast("string"), F.lit(" "), mean("y").cast("string"), F.lit(")"))


def wkt_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(F.pow(_point(a, 1) - _point(b, 1), F.lit(2)) + F.pow(_point(a, 2) - _point(b, 2), F.lit(2)))


def _box(text: Column) -> tuple[Column, Column, Column, Column]:
    p = wkt_points(text)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def wkt_contains(outer: Column, inner: Column) -> Column:
    """Whether the bounding box of `outer` holds that of `inner`."""
    (a, b, c, d), (e, f, g, h) = _box(outer), _box(inner)
    return (a <= e) & (b <= f) & (c >= g) & (d >= h)


def wkt_intersects(left: Column, right: Column) -> Column:
    """Whether the bounding boxes meet."""
    (a, b, c, d), (e, f, g, h) = _box(left), _box(right)
    return (a <= g) & (e <= c) & (b <= h) & (f <= d)


#: Type -> operation -> function of columns and parameters.
OPERATIONS: dict[str, dict[str, Callable[..., Column]]] = {
    "String": {
        "trim": trim_whitespace, "concat": lambda *c: F.concat(*c), "substring": lambda c, start, length: F.substring(c, start, length),
        "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)), "upper": F.upper, "lower": F.lower, "split": lambda c, by: F.split(c, by),
    },
    "Timestamp": {
        "date_diff": lambda a, b: F.datediff(a, b), "parse": parse_timestamp, "format": lambda c, form: F.date_format(c, form),
        "extract_year": F.year, "extract_month": F.month, "extract_day": F.dayofmonth,
    },
    "Integer": {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide, "modulo": F.try_mod},
    "Double": {
        "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide,
        "round": lambda c, places=0: F.round(c, places), "floor": F.floor, "ceil": F.ceil,
    },
    "Boolean": {"not": lambda c: ~c, "and": lambda a, b: a & b, "or": lambda a, b: a | b},
    "PhoneNumber": {
        "area_code_extract": lambda c: F.nullif(F.regexp_extract(c, r"^\+?\d{0,3}[\s\-]*\(?(\d{3})\)?", 1), F.lit("")),
        "format": lambda c: F.regexp_replace(c, r"[^0-9+]", ""),
        "validate": lambda c: F.length(F.regexp_replace(c, r"[+\- ()]", "")) >= 7,
    },
    "GeometryCol": {"area": wkt_area, "distance": wkt_distance, "centroid": wkt_centroid, "contains": wkt_contains, "intersects": wkt_intersects},
}
