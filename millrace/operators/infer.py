"""What the data says about types, join keys and column mappings, and how far it can be trusted."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTO_APPLY, JOIN_LIMIT = 0.85, 0.95

#: Weights of the parts of each score (fixed values).
WEIGHTS = {
    "mapping": {"name": 0.45, "type": 0.30, "domain": 0.25},
    "join": {"name": 0.15, "type": 0.20, "overlap": 0.30, "uniqueness": 0.35},
    "transform": {"keyword": 0.30, "type": 0.35, "catalog": 0.35},
    "source": {"keyword": 0.60, "schema": 0.40},
}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """field_name, type_name of text columns, by all their non-empty values in one pass.

    Boolean if all are true, false, 0 or 1; Integer, Double if all are; Timestamp if any is a date or has both a hyphen
    and a colon; else String. Nothing but null and empty values: String.
    """
    columns = list(columns or df.columns)
    made = []
    for i, c in enumerate(columns):
        v = F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
        made += [
            F.count(v).alias(f"n{i}"), F.bool_and(F.lower(v).isin("true", "false", "0", "1")).alias(f"b{i}"), F.bool_and(v.rlike(r"^[+-]?\d+$")).alias(f"i{i}"),
            F.bool_and(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"d{i}"),
            F.bool_or(v.rlike(r"^\d{4}-\d{2}-\d{2}$") | (v.contains("-") & v.contains(":"))).alias(f"t{i}"),
        ]
    kinds = [
        F.struct(F.lit(c).alias("field_name"), F.when(F.col(f"n{i}") == 0, "String").when(F.col(f"b{i}"), "Boolean").when(F.col(f"i{i}"), "Integer").when(F.col(f"d{i}"), "Double").when(F.col(f"t{i}"), "Timestamp").otherwise("String").alias("type_name"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*made).select(F.explode(F.array(*kinds)).alias("r")).select("r.*")


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field_name, n_values (neither null nor empty), n_distinct, ratio (0 without values)."""
    # one column at a time keeps each aggregate partial; several distincts in one would expand every row
    out = None
    for c in columns:
        v = F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
        one = df.select(v.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(c).alias("field_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
        one = one.withColumn("ratio", F.coalesce(F.try_divide("n_distinct", "n_values"), F.lit(0.0)))
        out = one if out is None else out.unionByName(one)
    return out


def overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row: n_left (left values, neither null nor empty), n_found (those among the right's values, as text), ratio.

    Both sides are reduced to distinct values first; the left ones carry their numbers of rows.
    """
    v = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
    a = left.select(v(left_column).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    b = right.select(v(right_column).alias("v")).distinct().filter("v IS NOT NULL").withColumn("here", F.lit(1))
    both = a.join(b, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_left"), F.coalesce(F.sum(F.when(F.col("here") == 1, F.col("n"))), F.lit(0)).alias("n_found"))
    return both.withColumn("ratio", F.coalesce(F.try_divide("n_found", "n_left"), F.lit(0.0)))


def overlaps(left: DataFrame, left_columns: Sequence[str], right: DataFrame, right_columns: Sequence[str]) -> DataFrame:
    """left, right, n_left, n_found, ratio of `overlap` for every pair of columns, by one job."""
    def valued(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias(name), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for i, c in enumerate(columns)])
        return df.select(F.explode(cells).alias("x")).select("x.*").filter("v IS NOT NULL")

    a = valued(left, left_columns, "i").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    b = valued(right, right_columns, "j").distinct()
    # each value once, with the right columns that hold it, so that a left value isn't copied for each of them
    holders = b.groupBy("v").agg(F.collect_set("j").alias("js"))
    met = a.join(holders, "v", "left").groupBy("i").agg(
        F.sum("n").alias("n_left"), *[F.sum(F.when(F.array_contains("js", F.lit(j)), F.col("n")).otherwise(0)).alias(f"f{j}") for j in range(len(right_columns))]
    )
    names = lambda cs, c: F.element_at(F.array(*[F.lit(x) for x in cs]), c + 1)
    rows = met.select("i", "n_left", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"f{j}").alias("n_found")) for j in range(len(right_columns))])).alias("x"))
    return rows.select(names(left_columns, F.col("i")).alias("left"), names(right_columns, F.col("x.j")).alias("right"), "n_left", "x.n_found", F.coalesce(F.try_divide("x.n_found", "n_left"), F.lit(0.0)).alias("ratio"))


def normalized(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name.lower())


def name_similarity(a: str, b: str) -> float:
    """1 for names equal but for case and separators, 0.85 if one holds the other, else shared words over all words, or
    where there are none, the likeness of their characters.
    """
    x, y = normalized(a), normalized(b)
    if x == y:
        return 1.0
    if x and y and (x in y or y in x):
        return 0.85
    p, q = (set(re.split(r"[\s_\-]+", n.lower())) - {""} for n in (a, b))
    return len(p & q) / len(p | q) if p & q else difflib.SequenceMatcher(None, x, y).ratio()


def types_join(a: str, b: str) -> bool:
    return a == b or {a, b} == {"Integer", "Double"} or "String" in (a, b)


def types_map(source: str, target: str) -> bool:
    return source == target or (source, target) == ("Integer", "Double") or target == "String"


def score(kind: str, **parts: float) -> float:
    """The weighted sum of the parts of one kind of proposal, each from 0 to 1, to three places."""
    weights = WEIGHTS[kind]
    if set(parts) != set(weights):
        raise ValueError(f"{kind} is scored by {sorted(weights)}")
    return round(sum(weights[k] * v for k, v in parts.items()), 3)


def route(kind: str, confidence: float) -> str:
    """`auto` or `review`: sources always go ahead, joins never do, the others from AUTO_APPLY on."""
    if kind == "source":
        return "auto"
    return "auto" if kind != "join" and confidence >= AUTO_APPLY else "review"


def infer_joins(left: DataFrame, left_columns: Sequence[str], right: DataFrame, right_columns: Sequence[str], types: dict[str, str] | None = None) -> list[dict]:
    """Candidates for an equi-join, best first: left, right, overlap, uniqueness, confidence, is_unique_key, note."""
    kinds = types or {}
    from millrace.functions.types import type_name

    kind = lambda df, c: kinds.get(c, type_name(df.schema[c].dataType))
    if not left_columns or not right_columns:
        return []
    ratios = {r["field_name"]: r["ratio"] for r in uniqueness(right, right_columns).collect()}
    found = {(r["left"], r["right"]): r["ratio"] for r in overlaps(left, left_columns, right, right_columns).collect()}  # a row for each pair of columns
    out = []
    for a in left_columns:
        for b in right_columns:
            if not types_join(kind(left, a), kind(right, b)):
                continue
            shared = found.get((a, b), 0.0)
            conf = score("join", name=float(normalized(a) == normalized(b)), type=1.0, overlap=shared, uniqueness=ratios[b])
            note = "WARNING: values of the right key repeat" if ratios[b] < 0.5 else "NOTE: some values of the right key repeat" if ratios[b] < 0.9 else ""
            out.append({"left": a, "right": b, "overlap": shared, "uniqueness": ratios[b], "confidence": conf, "is_unique_key": ratios[b] >= 0.95, "note": note})
    return sorted(out, key=lambda r: (-r["confidence"], r["left"], r["right"]))


def infer_mappings(df: DataFrame, target, domains: dict[str, Sequence[str]] | None = None) -> list[dict]:
    """For each column of `df` the field of the schema `target` it most likely is; the first of equals."""
    kinds = {r["field_name"]: r["type_name"] for r in infer_types(df).collect()}
    shares: dict[tuple[str, str], float] = {}
    if domains:
        made = [F.avg(F.col(f"`{c}`").cast("string").isin(*map(str, values)).cast("double")).alias(f"{c}\x1f{f}") for c in df.columns for f, values in domains.items()]
        shares = {tuple(k.split("\x1f")): v or 0.0 for k, v in df.agg(*made).first().asDict().items()}
    out = []
    for c in df.columns:
        best = None
        for f in target.fields:
            domain = shares.get((c, f.name), 1.0 if f.name not in (domains or {}) else 0.0)
            conf = score("mapping", name=name_similarity(c, f.name), type=1.0 if types_map(kinds[c], f.type) else 0.0, domain=domain)
            if best is None or conf > best["confidence"]:
                best = {"source_field": c, "target_field": f.name, "source_type": kinds[c], "confidence": conf, "route": route("mapping", conf)}
        out.append(best)
    return out


#: Word of a request -> transform it asks for (fixed values).
KEYWORDS = {
    "clean": "trim_whitespace", "trim": "trim_whitespace", "normalize": "trim_whitespace",
    "parse": "parse_timestamp", "timestamp": "parse_timestamp", "date": "parse_timestamp",
}
#: Transform -> operation of the type catalog that it carries out.
CATALOG_OPERATION = {"trim_whitespace": "trim", "empty_to_none": "replace", "prefix_id": "concat", "parse_timestamp": "parse"}


def infer_transforms(request: str, df: DataFrame, target=None) -> list[dict]:
    """Transforms for the text columns that a request names or whose values look like times; one per field and transform."""
    from millrace.functions.types import TYPES

    text = request.lower()
    wanted = list(dict.fromkeys(t for w, t in KEYWORDS.items() if w in text))
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    kinds = {r["field_name"]: r["type_name"] for r in infer_types(df, texts).collect()} if texts else {}
    out: dict[tuple[str, str], dict] = {}
    for c in texts:
        asked = [(t, 1.0 if normalized(c) in normalized(text) else 0.8) for t in wanted if t != "parse_timestamp"]
        if kinds[c] == "Timestamp":
            asked.append(("parse_timestamp", 0.8))
        for t, keyword in asked:
            kind = "Timestamp" if t == "parse_timestamp" else "String"
            conf = score("transform", keyword=keyword, type=1.0, catalog=1.0 if TYPES.has_operation(kind, CATALOG_OPERATION[t]) else 0.0)
            out[c, t] = {"op": "Map", "field": c, "transform": t, "confidence": conf, "route": route("transform", conf)}
        for f in target.fields if target else ():
            if name_similarity(c, f.name) > 0.7 and f.type != kinds[c] and f.type != "String":
                conf = score("transform", keyword=name_similarity(c, f.name), type=1.0 if types_map(kinds[c], f.type) else 0.0, catalog=1.0)
                out[c, f"cast:{f.type}"] = {"op": "Cast", "field": c, "to": f.type, "confidence": conf, "route": route("transform", conf)}
    return list(out.values())


def identify_sources(request: str, catalog) -> list[dict]:
    """Catalog entries a request speaks of, best first; those without any relevance are left out.

    Scored by the share of the entry's keywords in the request, and by whether it names the source (0.5), its schema
    (0.3) or its format (0.2).
    """
    text = request.lower()
    out = []
    for entry in catalog:
        s = entry.source
        keyword = sum(w.lower() in text for w in entry.keywords) / len(entry.keywords) if entry.keywords else 0.0
        schema = 0.5 * (s.name.lower() in text) + 0.3 * bool(s.schema_name and s.schema_name.lower() in text) + 0.2 * (s.format.lower() in text)
        if keyword or schema:
            out.append({"source": s.name, "confidence": score("source", keyword=keyword, schema=schema), "route": route("source", 1.0)})
    return sorted(out, key=lambda r: (-r["confidence"], r["source"]))
