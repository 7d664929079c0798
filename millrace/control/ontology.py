"""Object types, rows as instances of them, and relationships that joins declare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import SCHEMAS, Schema
from millrace.plans.ir import Join, Pipeline


@dataclass(frozen=True)
class ObjectType:
    name: str
    schema: Schema
    identity: str
    description: str = ""


class ObjectTypes:
    def __init__(self, types: dict[str, ObjectType] | None = None):
        self._known = dict(types or {n: ObjectType(n, SCHEMAS[n], SCHEMAS[n].key) for n in ("SupportCase", "KnowledgeArticle", "Customer", "Product", "Transaction")})

    def register(self, kind: ObjectType) -> None:
        if kind.identity not in kind.schema.index:
            raise ValueError(f"{kind.name} has no field {kind.identity!r}")
        self._known[kind.name] = kind

    def get(self, name: str) -> ObjectType:
        if name not in self._known:
            raise ValueError(f"unknown object type {name!r}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


def instances(df: DataFrame, kind: ObjectType) -> DataFrame:
    """object_type, identity (text), record (the row) of every row with an identity."""
    identity = F.col(f"`{kind.identity}`")
    return df.filter(identity.isNotNull()).select(F.lit(kind.name).alias("object_type"), identity.cast("string").alias("identity"), F.struct("*").alias("record"))


def instance_counts(df: DataFrame, kind: ObjectType) -> DataFrame:
    """One row: object_type, mapped_count, unmapped_count (rows without an identity)."""
    c = F.col(f"`{kind.identity}`")
    return df.agg(F.lit(kind.name).alias("object_type"), F.count(c).alias("mapped_count"), F.count_if(c.isNull()).alias("unmapped_count"))


def map_record(record: dict, kind: ObjectType) -> dict | None:
    value = record.get(kind.identity)
    return None if value is None else {"object_type": kind.name, "identity": value, "record": record}


def relationships(plan: Pipeline, types: dict[str, str]) -> list[dict]:
    """One relationship per key pair of each join. `types` says which object type each dataset holds; a join's output
    holds the left one's, and other steps hand on what they read.
    """
    held, out = dict(types), []
    for s in plan.steps:
        if isinstance(s, Join):
            for k in s.on:
                out.append({
                    "from": held.get(s.left), "to": held.get(s.right), "left_key": k.left, "right_key": k.right,
                    "kind": "one_to_many" if s.one_to_many else "many_to_one", "via": s.output,
                })
        if s.inputs and s.inputs[0] in held:
            held.setdefault(s.output, held[s.inputs[0]])
    return out
