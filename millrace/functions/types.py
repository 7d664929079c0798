"""Canonical types: a Spark type, a validity rule and the operations each declares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class CanonicalType:
    """A logical type. `rule` turns a column into a condition that holds for valid non-null values."""

    name: str
    spark: T.DataType
    operations: tuple[str, ...] = ()
    rule: Rule | None = None

    def valid(self, value: Column) -> Column:
        """True for null and for values that meet the rule."""
        return F.lit(True) if self.rule is None else value.isNull() | F.coalesce(self.rule(value), F.lit(False))


def phone_ok(value: Column) -> Column:
    """Seven characters or more once `+`, `-`, blanks and brackets are removed."""
    return F.length(F.regexp_replace(value.cast("string"), r"[+\- ()]", "")) >= 7


def enum_type(name: str, allowed: list[str]) -> CanonicalType:
    return CanonicalType(name, T.StringType(), ("validate",), lambda c: c.isin(*allowed) if allowed else F.lit(False))


def array_type(name: str, element: CanonicalType) -> CanonicalType:
    rule = None if element.rule is None else lambda c: F.forall(c, element.valid)
    return CanonicalType(name, T.ArrayType(element.spark), ("size", "contains"), rule)


_NUMBER = ("add", "subtract", "multiply", "divide")
BUILT_IN = (
    CanonicalType("String", T.StringType(), ("trim", "concat", "substring", "replace", "upper", "lower", "split")),
    CanonicalType("Timestamp", T.TimestampNTZType(), ("date_diff", "parse", "format", "extract_year", "extract_month", "extract_day")),
    CanonicalType("Integer", T.LongType(), (*_NUMBER, "modulo")),
    CanonicalType("Double", T.DoubleType(), (*_NUMBER, "round", "floor", "ceil")),
    CanonicalType("Boolean", T.BooleanType(), ("not", "and", "or")),
    CanonicalType("PhoneNumber", T.StringType(), ("area_code_extract", "format", "validate"), phone_ok),
    CanonicalType("GeometryCol", T.StringType(), ("area", "distance", "contains", "intersects", "centroid")),
)


class TypeRegistry:
    """Types by name, with a new version for each registration; earlier versions can be looked up."""

    def __init__(self, types: tuple[CanonicalType, ...] = BUILT_IN):
        self._versions: list[dict[str, CanonicalType]] = [{t.name: t for t in types}]

    @property
    def version(self) -> int:
        return len(self._versions)

    def register(self, kind: CanonicalType) -> int:
        if kind.name in self._versions[-1]:
            raise ValueError(f"type {kind.name!r} is registered already")
        self._versions.append({**self._versions[-1], kind.name: kind})
        return self.version

    def get(self, name: str, version: int | None = None) -> CanonicalType:
        known = self.snapshot(version)
        if name not in known:
            raise ValueError(f"unknown type {name!r}; known are {sorted(known)}")
        return known[name]

    def snapshot(self, version: int | None = None) -> dict[str, CanonicalType]:
        if version is not None and not 1 <= version <= self.version:
            raise ValueError(f"no version {version}; the latest is {self.version}")
        return dict(self._versions[(version or self.version) - 1])

    def __contains__(self, name: str) -> bool:
        return name in self._versions[-1]

    def has_operation(self, name: str, operation: str) -> bool:
        return name in self and operation in self.get(name).operations


TYPES = TypeRegistry()


def type_name(kind: T.DataType) -> str:
    """The canonical type that holds a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Double"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Timestamp"
    if isinstance(kind, (T.StringType, T.NullType)):
        return "String"
    return kind.simpleString()


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    required: bool = False
    sensitive: bool = False
    description: str = ""

    def marked(self, sensitive: bool) -> Field:
        return replace(self, sensitive=sensitive)

    def problems(self, value: Column | None = None) -> Column:
        """Texts of what is wrong with a row's value of this field; nulls where nothing is."""
        value = F.col(f"`{self.name}`") if value is None else value
        at = lambda reason: F.lit(f"{self.name}: {reason}")
        return F.array(
            F.when(value.isNull() & F.lit(self.required), at("missing_required")),
            F.when(value.isNull() & F.lit(not self.nullable), at("null_violation")),
            F.when(~TYPES.get(self.type).valid(value), at(f"not a valid {self.type}")),
        )


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    key: str | None = None
    description: str = ""
    index: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self.index.update({f.name: f for f in self.fields})

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def get(self, name: str) -> Field:
        if name not in self.index:
            raise ValueError(f"schema {self.name!r} has no field {name!r}")
        return self.index[name]

    def struct(self) -> T.StructType:
        """The Spark schema; what Spark has no place for is in the fields' metadata."""
        return T.StructType([
            T.StructField(f.name, TYPES.get(f.type).spark, f.nullable, {"canonical_type": f.type, "required": f.required, "sensitive": f.sensitive, "description": f.description})
            for f in self.fields
        ])

    @staticmethod
    def from_struct(name: str, struct: T.StructType, key: str | None = None) -> Schema:
        return Schema(name, tuple(
            Field(f.name, f.metadata.get("canonical_type", type_name(f.dataType)), f.nullable, f.metadata.get("required", False), f.metadata.get("sensitive", False), f.metadata.get("description", ""))
            for f in struct.fields
        ), key)


def _fields(text: str) -> tuple[Field, ...]:
    """`name:Type` with `!` for non-nullable and `*` for required, separated by blanks."""
    out = []
    for word in text.split():
        name, kind = word.split(":")
        out.append(Field(name, kind.rstrip("!*"), "!" not in kind, "*" in kind))
    return tuple(out)


#: The domain's schemas (fixed names and types).
SCHEMAS: dict[str, Schema] = {
    s.name: s
    for s in (
        Schema("SupportCase", _fields(
            "case_id:String!* subject:String* description:String status:String priority:String channel:String created_at:Timestamp"
            " resolution:String ticket_type:String source_system:String!*"), "case_id"),
        Schema("KnowledgeArticle", _fields(
            "article_id:String!* category:String intent:String question:String!* answer:String!* source_system:String!*"), "article_id"),
        Schema("JoinedCaseOutput", _fields(
            "case_id:String!* subject:String!* ticket_type:String matched_category:String matched_article_count:Integer!* source_system:String!*"), "case_id"),
        Schema("Customer", _fields("customer_id:String!* name:String address:String"), "customer_id"),
        Schema("Product", _fields("product_variation_id:String!* product_id:String product_name:String price:Double"), "product_variation_id"),
        Schema("Transaction", _fields(
            "transaction_id:String!* customer_id:String!* product_id:String!* units:Double transaction_date:Timestamp"), "transaction_id"),
    )
}


def get_schema(name: str) -> Schema:
    if name not in SCHEMAS:
        raise ValueError(f"unknown schema {name!r}; known are {sorted(SCHEMAS)}")
    return SCHEMAS[name]
