"""Data-quality measures, output contracts, quarantine and schema drift."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import Schema, type_name


def null_rates(df: DataFrame) -> DataFrame:
    """field_name, null_count, total_count, null_rate of every column, from one pass; no rows for an empty table."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), (F.col("total") - F.col(f"c{i}")).alias("null_count")) for i, c in enumerate(df.columns)]))
    out = counts.filter("total > 0").select("total", rows.alias("r"))
    return out.select("r.field_name", "r.null_count", F.col("total").alias("total_count"), (F.col("r.null_count") / F.col("total")).alias("null_rate"))


def empty_percentages(df: DataFrame) -> DataFrame:
    """field_name, empty_pct: share of null or empty values in percent, of every column."""
    made = [F.avg(F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), 100.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"c{i}").alias("empty_pct")) for i, c in enumerate(df.columns)]))
    return df.agg(*made).select(rows.alias("r")).select("r.*").filter("empty_pct IS NOT NULL")


def _comparable(df: DataFrame) -> list[Column]:
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))).alias(f.name) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]


def duplicate_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: total_rows, unique_rows, duplicate_rows (equal to an earlier one), duplicate_rate (0 for no rows).

    Grouped with partial counts, so rows that repeat a billion times cost one state per task.
    """
    picked = df.select(*columns) if columns else df
    groups = picked.select(*_comparable(picked)).groupBy(*picked.columns).agg(F.count(F.lit(1)).alias("_mr_n"))
    out = groups.agg(F.coalesce(F.sum("_mr_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"))
    dup = F.col("total_rows") - F.col("unique_rows")
    return out.select("total_rows", "unique_rows", dup.alias("duplicate_rows"), F.coalesce(F.try_divide(dup, "total_rows"), F.lit(0.0)).alias("duplicate_rate"))


def value_frequencies(df: DataFrame, column: str, top: int | None = 30) -> DataFrame:
    """value, n: the most frequent values, ties by value; all values if `top` is None."""
    out = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """key_value, n of the keys that occur more than once."""
    return df.groupBy(F.col(f"`{key}`").cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dominant_types(df: DataFrame) -> DataFrame:
    """field_name, type_name: what most of a text column's non-null values look like; a typed column's own type.

    Boolean (true, false), Integer, Double, Timestamp or String; ties go to the first of this order.
    """
    kinds = (("Boolean", r"(?i)^(true|false)$"), ("Integer", r"^[+-]?\d+$"), ("Double", r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), ("Timestamp", r"^\d{4}-\d{2}-\d{2}"))
    made, order = [], ["Boolean", "Integer", "Double", "Timestamp", "String"]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "string":
            kind = F.lit("String")
            for name, pattern in reversed(kinds):
                kind = F.when(c.rlike(pattern), name).otherwise(kind)
            made += [F.count_if(c.isNotNull() & (kind == k)).alias(f"c{i}_{k}") for k in order]
    counts = df.agg(F.count(F.lit(1)).alias("_mr_n"), *made)
    rows = []
    for i, f in enumerate(df.schema.fields):
        if f.dataType.typeName() == "string":
            most = F.greatest(*[F.col(f"c{i}_{k}") for k in order])
            kind = F.coalesce(*[F.when((F.col(f"c{i}_{k}") == most) & (most > 0), F.lit(k)) for k in order])
        else:
            kind = F.lit(type_name(f.dataType))
        rows.append(F.struct(F.lit(f.name).alias("field_name"), kind.alias("type_name")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class Drift:
    field_name: str
    kind: str  # missing_field, extra_field, type_mismatch
    expected: str | None = None
    actual: str | None = None


def schema_drift(df: DataFrame, schema: Schema, observed: dict[str, str | None] | None = None) -> list[Drift]:
    """Differences between a frame and its declared schema; whole and broken numbers pass for each other.

    `observed` gives types found in the values (as by `dominant_types`); a field whose values are all null is skipped.
    """
    out = [Drift(n, "missing_field", schema.get(n).type) for n in schema.names if n not in df.columns]
    for f in df.schema.fields:
        if f.name not in schema.index:
            out.append(Drift(f.name, "extra_field", actual=type_name(f.dataType)))
            continue
        want = schema.get(f.name).type
        have = (observed or {}).get(f.name, type_name(f.dataType)) if observed is None or f.name in observed else type_name(f.dataType)
        if isinstance(f.dataType, T.NullType) or have is None:
            continue
        same = {"PhoneNumber": "String", "GeometryCol": "String"}.get(want, want)
        if have != same and {have, same} != {"Integer", "Double"}:
            out.append(Drift(f.name, "type_mismatch", want, have))
    return sorted(out, key=lambda d: (d.kind, d.field_name))


def drift_frame(spark, drifts: Sequence[Drift]) -> DataFrame:
    return spark.createDataFrame([(d.field_name, d.kind, d.expected, d.actual) for d in drifts], "field_name string, kind string, expected string, actual string")


def quarantine(df: DataFrame, schema: Schema) -> DataFrame:
    """`df` with `errors`: the texts of what is wrong in each row; an empty array for a valid row. One scan."""
    found = F.array_compact(F.concat(*[f.problems() for f in schema.fields if f.name in df.columns]))
    return df.withColumn("errors", found)


def split_valid(df: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    marked = quarantine(df, schema)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def contract_violations(df: DataFrame, schema: Schema, key: str | None = None) -> DataFrame:
    """kind, field_name, n_rows of each violation: missing_required, null_violation, duplicate_key, empty_output."""
    key = key or schema.key
    made = []
    for f in schema.fields:
        if f.name in df.columns:
            null = F.col(f"`{f.name}`").isNull()
            made += [("missing_required", f.name, F.count_if(null))] * f.required + [("null_violation", f.name, F.count_if(null))] * (not f.nullable)
        elif f.required:
            made.append(("missing_required", f.name, F.count(F.lit(1))))
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(f"c{i}") for i, (_, _, c) in enumerate(made)])
    rows = [F.struct(F.lit("empty_output").alias("kind"), F.lit(None).cast("string").alias("field_name"), F.when(F.col("total") == 0, F.lit(1).cast("bigint")).otherwise(0).alias("n_rows"))]
    rows += [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field_name"), F.col(f"c{i}").alias("n_rows")) for i, (kind, name, _) in enumerate(made)]
    out = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if key and key in df.columns:
        repeats = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out = out.unionByName(repeats.agg(F.lit("duplicate_key").alias("kind"), F.lit(key).alias("field_name"), F.count(F.lit(1)).alias("n_rows")))
    return out.filter("n_rows > 0")


def required_status(df: DataFrame, schema: Schema, first_row: bool = False) -> DataFrame:
    """field_name, satisfied of the required fields: not null in any row (or in the first row only)."""
    rows = df.limit(1) if first_row else df
    need = [f for f in schema.fields if f.required]
    counts = rows.agg(*[(F.count_if(F.col(f"`{f.name}`").isNull()) if f.name in df.columns else F.lit(1).cast("bigint")).alias(f"c{i}") for i, f in enumerate(need)])
    made = [F.struct(F.lit(f.name).alias("field_name"), (F.col(f"c{i}") == 0).alias("satisfied")) for i, f in enumerate(need)]
    return counts.select(F.explode(F.array(*made)).alias("r")).select("r.*")


@dataclass
class ContractResult:
    satisfied: bool
    violations: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def check_contract(df: DataFrame, schema: Schema, key: str | None = None, previous: Schema | None = None) -> ContractResult:
    """The contract's verdict from one pass over the metrics; required columns that were dropped only warn."""
    found = [r.asDict() for r in contract_violations(df, schema, key).collect()]
    dropped = sorted({f.name for f in previous.fields if f.required} - set(schema.names)) if previous else []
    if any(v["kind"] == "empty_output" for v in found):
        found = [v for v in found if v["kind"] == "empty_output"]
    return ContractResult(not found, found, [f"breaking change: required column {c!r} was dropped" for c in dropped])


def safe_to_deploy(build_errors: int, contract: ContractResult) -> tuple[bool, list[str]]:
    reasons = [f"{build_errors} rows failed to build"] if build_errors else []
    reasons += [f"{v['kind']} {v['field_name'] or ''}: {v['n_rows']}".replace(" :", ":") for v in contract.violations]
    return not reasons, reasons


def run_trends(runs: DataFrame, pipeline: str = "pipeline", status: str = "status", at: str = "at", seconds: str = "seconds", rows: str = "rows") -> DataFrame:
    """Per pipeline: total_runs, successes, failures, success_rate, avg_seconds (all runs), avg_rows (successful ones
    only), and latest_status, latest_rows of the run with the latest `at` (ties: the larger status and rows).
    """
    ok = F.col(status) == "success"
    return runs.groupBy(F.col(pipeline).alias("pipeline")).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"), F.avg(seconds).alias("avg_seconds"), F.avg(F.when(ok, F.col(rows))).alias("avg_rows"),
        F.max_by(F.col(status), F.struct(at, status, rows)).alias("latest_status"), F.max_by(F.col(rows), F.struct(at, status, rows)).alias("latest_rows"),
    )


def run_histories(runs: DataFrame, pipeline: str = "pipeline", at: str = "at", run_id: str = "run_id", seconds: str = "seconds", rows: str = "rows") -> DataFrame:
    """pipeline, record_count_history and duration_history: (run_id, value) of each run in the order of `at`, then run_id."""
    one = F.struct(F.col(at).alias("at"), F.col(run_id).alias("run_id"), F.col(rows).alias("rows"), F.col(seconds).alias("seconds"))
    listed = runs.groupBy(F.col(pipeline).alias("pipeline")).agg(F.array_sort(F.collect_list(one)).alias("h"))
    return listed.select(
        "pipeline", F.transform("h", lambda x: F.struct(x["run_id"].alias("run_id"), x["rows"].alias("record_count"))).alias("record_count_history"),
        F.transform("h", lambda x: F.struct(x["run_id"].alias("run_id"), x["seconds"].alias("duration_seconds"))).alias("duration_history"),
    )


def run_alerts(runs: DataFrame, limits: DataFrame, seen: DataFrame | None = None, status: str = "status", seconds: str = "seconds") -> DataFrame:
    """run_id, pipeline, kind, severity: run_failure (critical) for runs that failed, sla_breach (warning) for
    successful runs that took strictly longer than the pipeline's limit_s. Runs in `seen` (run_id, kind) raise nothing again.
    """
    joined = runs.join(limits, "pipeline", "left")
    kind = F.when(F.col(status) != "success", "run_failure").when(F.col(seconds) > F.col("limit_s"), "sla_breach")
    out = joined.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("severity", F.when(F.col("kind") == "run_failure", "critical").otherwise("warning"))
    out = out.select("run_id", "pipeline", "kind", "severity")
    return out if seen is None else out.join(seen.select("run_id", "kind"), ["run_id", "kind"], "left_anti")


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times given as text or time; 0 where either can't be read."""
    micros = lambda c: F.unix_micros(c.try_cast("timestamp"))
    return F.coalesce((micros(end) - micros(start)) / 1e6, F.lit(0.0))


def numbered_runs(runs: DataFrame, order: str) -> DataFrame:
    """`runs` with run_id `run_0001`, .. in the order of `order`, numbered within range partitions."""
    from millrace.sources.connectors import with_position

    return with_position(runs, "_mr_n", order).withColumn("run_id", F.format_string("run_%04d", F.col("_mr_n") + 1)).drop("_mr_n")


def parse_deploy_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """at, records, path, approved, version, deployed_by of each line of the deploy log; lines of another form are left out."""
    v = F.col(column)
    get = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    return lines.filter(v.rlike(r"\| *Deployed \d+ records to ")).select(
        F.trim(F.split(v, r"\|")[0]).alias("at"), get(r"Deployed (\d+) records").cast("bigint").alias("records"), F.trim(get(r"records to ([^|]+)")).alias("path"),
        (get(r"approved=(\w+)") == "True").alias("approved"), get(r"version=([^| ]+)").alias("version"), get(r"deployed_by=([^| ]+)").alias("deployed_by"),
    )
