"""Profile of a Parquet table's columns by load: nulls and extrema from footers where they suffice, values counted by dictionary code."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Writers may cut the extrema of long texts at 64 bytes; such statistics aren't taken for exact.
EXACT_TEXT_BYTES = 64
BYTES_PER_TASK = 64 << 20


class ScanReport:
    """What the scans of a profile opened, counted by the tasks: row groups' columns, their bytes, values that were built.

    A task that is run again counts again, so the numbers are upper bounds.
    """

    def __init__(self, spark: SparkSession):
        self.chunks, self.bytes, self.values = (spark.sparkContext.accumulator(0) for _ in range(3))


def located(path: str) -> tuple[str, str]:
    """(address of the file system, path inside it) of a path as Spark writes it, which isn't percent-encoded."""
    if path.startswith("file:"):
        return "", "/" + path[5:].lstrip("/")
    if "://" not in path:
        return "", path
    scheme, rest = path.split("://", 1)
    place, _, inner = rest.partition("/")
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{place}/", inner


def _open(path: str, **options):
    import pyarrow.parquet as pq
    from pyarrow import fs

    address, inner = located(path)
    if not address:
        return pq.ParquetFile(inner, **options)
    system, base = fs.FileSystem.from_uri(address)
    return pq.ParquetFile(system.open_input_file(f"{base.rstrip('/')}/{inner}"), **options)


def open_coded(path: str):
    """The Parquet file at `path`, whose text columns are read as their dictionaries and codes."""
    first = _open(path)
    texts = [f.name for f in first.schema_arrow if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) or pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type)]
    return _open(path, metadata=first.metadata, read_dictionary=texts)


def _text(value, unit_scale=None) -> str | None:
    import datetime as dt

    if value is None:
        return None
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=None) if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return str((value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
    if isinstance(value, dt.date):
        return str((value - dt.date(1970, 1, 1)).days)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def chunk_statistics(spark: SparkSession, path: str, load: str, columns: Sequence[str]) -> DataFrame:
    """What the footers say: one row per row group and column, read by the executors.

    path, row_group, column, n_rows, load (null if the row group holds more than one load or a null one),
    nulls, lo, hi (as text; timestamps as microseconds), exact (nulls and extrema hold for that one load).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / BYTES_PER_TASK))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for p in batch.column("path").to_pylist():
                file = _open(p)
                meta = file.metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    at = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                    s = at[load].statistics if load in at else None
                    one = s is not None and s.has_null_count and s.null_count == 0 and s.has_min_max and s.min == s.max
                    for c in columns:
                        t = at[c].statistics if c in at else None
                        nulls = t.null_count if t is not None and t.has_null_count else None
                        full = nulls is not None and (t.has_min_max or nulls == group.num_rows)
                        lo, hi = (_text(t.min), _text(t.max)) if full and t.has_min_max else (None, None)
                        if at.get(c) is not None and at[c].physical_type in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
                            full = full and all(v is None or len(v.encode()) < EXACT_TEXT_BYTES for v in (lo, hi))
                        for k, v in zip(names, (p, g, c, group.num_rows, s.min if one else None, nulls, lo, hi, bool(one and full))):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = ("path", "row_group", "column", "n_rows", "load", "nulls", "lo", "hi", "exact")
    schema = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("n_rows", pa.int64()), ("load", pa.int64()),
                        ("nulls", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("exact", pa.bool_())])
    ddl = "path string, row_group int, column string, n_rows bigint, load bigint, nulls bigint, lo string, hi string, exact boolean"
    return files.select("path").repartition(tasks).mapInArrow(footers, ddl)


def _extrema(loads: pa.Array, values: pa.Array) -> list[tuple]:
    """(load, smallest, largest) of each load's values that aren't null (nor NaN); of nested and binary values none."""
    import pyarrow.compute as pc

    kind = values.type
    if pa.types.is_nested(kind) or pa.types.is_binary(kind) or pa.types.is_decimal(kind):
        return []
    keep = pc.is_valid(values)
    if pa.types.is_floating(kind):
        keep = pc.and_(keep, pc.invert(pc.fill_null(pc.is_nan(values), True)))
    t = pa.table({"none": loads.is_null(), "l": loads, "v": values}).filter(keep)
    t = t.take(pc.sort_indices(t, [("none", "ascending"), ("l", "ascending"), ("v", "ascending")]))
    if not len(t):
        return []
    none, number, v = t.column("none").to_numpy(), t.column("l").fill_null(0).to_numpy(), t.column("v").combine_chunks()
    first = np.append(0, np.flatnonzero((number[1:] != number[:-1]) | (none[1:] != none[:-1])) + 1).tolist()
    return [(None if none[a] else int(number[a]), v.slice(a, 1), v.slice(b - 1, 1)) for a, b in zip(first, [*first[1:], len(t)])]


def chunk_values(chunks: DataFrame, load: str, tasks: int, reads: ScanReport | None = None) -> DataFrame:
    """The distinct values of each chunk with their numbers of rows: (load, column, value, n, exact, lo, hi).

    `chunks` has path, row_group, column, load, exact; all of these are read. Of text columns the dictionaries and codes
    are read and (load, code) counted; the rows' texts aren't built (pages that the writer left without a dictionary get
    one on reading). Other columns' values are counted as they are. A null is a row with a null value. For each chunk
    that isn't exact and each of its loads there is another row with n = 0 and the smallest and largest value as text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def as_text(values: pa.Array) -> pa.Array:
            if pa.types.is_dictionary(values.type):
                values = values.dictionary_decode()
            if pa.types.is_timestamp(values.type):
                values = values.cast(pa.timestamp("us", tz=values.type.tz)).cast(pa.int64())
            elif pa.types.is_date(values.type):
                values = values.cast(pa.date32()).cast(pa.int32())
            if pa.types.is_binary(values.type) or pa.types.is_nested(values.type):
                return pa.array([None if v is None else _text(v) for v in values.to_pylist()], pa.string())
            return values.cast(pa.string())

        opened: tuple[str, object] = ("", None)
        for batch in batches:
            for row in batch.to_pylist():
                if opened[0] != row["path"]:
                    opened = (row["path"], open_coded(row["path"]))
                kind = opened[1].schema_arrow.field(row["column"]).type if row["column"] in opened[1].schema_arrow.names else None
                if kind is None:
                    continue
                file = opened[1]
                if reads is not None:
                    group = file.metadata.row_group(row["row_group"])
                    size = sum(c.total_compressed_size for c in map(group.column, range(group.num_columns)) if c.path_in_schema.split(".")[0] == row["column"])
                    reads.chunks.add(1)
                    reads.bytes.add(size)
                picked = [row["column"]] if row["load"] is not None else list(dict.fromkeys([load, row["column"]]))
                table = file.read_row_group(row["row_group"], columns=picked).unify_dictionaries()
                column = table.column(row["column"]).combine_chunks()
                if pa.types.is_nested(kind):
                    column = as_text(column)
                words = None
                if pa.types.is_dictionary(column.type):
                    words, column = column.dictionary, column.indices
                if row["load"] is not None:
                    counts = pc.value_counts(column)
                    values, n = counts.field("values"), counts.field("counts").cast(pa.int64())
                    loads = pa.array([row["load"]] * len(n), pa.int64())
                else:
                    t = pa.table({"l": table.column(load).combine_chunks().cast(pa.int64()), "v": column}).group_by(["l", "v"]).aggregate([([], "count_all")])
                    values, n, loads = t.column("v").combine_chunks(), t.column("count_all").combine_chunks().cast(pa.int64()), t.column("l").combine_chunks()
                values = values if words is None else words.take(values)
                if reads is not None:
                    reads.values.add(len(values))
                ends = [] if row["exact"] else _extrema(loads, values)
                texts = as_text(values)
                m = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([loads, pa.array([e[0] for e in ends], pa.int64())]), pa.array([row["column"]] * (len(n) + m), pa.string()),
                        pa.concat_arrays([texts, pa.nulls(m, pa.string())]), pa.concat_arrays([n, pa.array([0] * m, pa.int64())]), pa.array([row["exact"]] * (len(n) + m), pa.bool_()),
                        *[pa.concat_arrays([pa.nulls(len(n), pa.string()), *[as_text(e[k]) for e in ends]]) for k in (1, 2)],
                    ],
                    names=["load", "column", "value", "n", "exact", "lo", "hi"],
                )

    placed = chunks.select("path", "row_group", "column", "load", "exact").repartition(tasks, "path", "row_group").sortWithinPartitions("path", "row_group")
    return placed.mapInArrow(scan, "load bigint, column string, value string, n bigint, exact boolean, lo string, hi string")


def column_profile(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    load: str = "load_id",
    valid: dict[str, str] | None = None,
    counted: Sequence[str] | None = None,
    reads: ScanReport | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(profile, shares) of the Parquet table at `path`, by load.

    profile: load_id, column_name, n_rows, n_null, n_distinct, lo, hi (smallest and largest whole number of a
    whole-number column), least, most (smallest and largest value as text: numbers and truth values as numbers, times
    as microseconds, dates as days, texts by their bytes, NaN left out; null for decimals, binary and nested columns),
    n_malformed (non-null values that don't match the pattern `valid[column]`; 0 without one).
    shares: load_id, column_name, v1, v2 (128-bit hash of a value), n (its rows).
    Rows with a null load form a load of their own, with a null load_id. A column that the files lack has no row;
    an empty table has none either. Nested columns are compared by their text.

    `counted` names the columns whose distinct values, shares and patterns are asked (None: all); the others have a null
    n_distinct and no shares. Nulls and extrema come from footers wherever a row group holds one load and its statistics
    are exact. A chunk (one column of a row group) is opened only if its column's values are asked or its footer
    doesn't suffice. What leaves a task is each chunk's distinct values with counts, so a frequent value weighs as
    much as a rare one. `reads` counts the chunks opened, their bytes and the values built.
    """
    from millrace.session import cut

    valid = valid or {}
    asked = sorted(set(columns if counted is None else counted) | set(valid))
    chunks = cut(chunk_statistics(spark, path, load, columns))
    tasks = max(spark.sparkContext.defaultParallelism, chunks.rdd.getNumPartitions())
    kinds = {f.name: f.dataType.typeName() for f in spark.read.parquet(path).schema.fields}
    of = lambda *names: F.col("column").isin([c for c in columns if kinds.get(c) in names] or [""])
    whole = of("byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz")

    def ends(least: Column, most: Column) -> list[Column]:
        """The smallest and the largest value, each as whole number, as other number and as text."""
        switch = lambda c: F.when(of("boolean"), (c == "true").cast("bigint")).when(whole, c.try_cast("bigint"))
        broken = lambda c: F.when(of("float", "double"), c.try_cast("double"))
        text = lambda c: F.when(of("string", "char", "varchar"), c)
        return [a(f(c)).alias(f"{name}_{f_name}") for name, c, a in (("lo", least, F.min), ("hi", most, F.max)) for f_name, f in (("x", switch), ("y", broken), ("s", text))]

    seen = chunk_values(chunks.filter(~F.col("exact") | F.col("column").isin(asked or [""])), load, tasks, reads)
    bad: Column = F.lit(False)
    for c, pattern in valid.items():
        bad = F.when(F.col("column") == c, ~F.col("value").rlike(pattern)).otherwise(bad)
    hashed = seen.select(
        "load", "column", "n", "exact", "lo", "hi", F.col("value").isNull().alias("none"), F.coalesce(bad, F.lit(False)).alias("bad"),
        F.xxhash64("value").alias("v1"), F.xxhash64(F.concat(F.lit("~"), F.col("value"))).alias("v2"),
    )
    values = cut(
        hashed.groupBy("load", "column", "none", "v1", "v2", "lo", "hi").agg(  # lo and hi are null but in the rows of extrema
            F.sum("n").alias("n"), F.max("bad").alias("bad"), F.sum(F.when(~F.col("exact"), F.col("n")).otherwise(0)).alias("n_read"),
        )
    )
    scanned = values.groupBy("load", "column").agg(
        F.sum("n_read").alias("n_rows"), F.sum(F.when(F.col("none"), F.col("n_read")).otherwise(0)).alias("n_null"),
        F.count(F.when(~F.col("none"), 1)).alias("n_distinct"), F.sum(F.when(F.col("bad") & ~F.col("none"), F.col("n")).otherwise(0)).alias("n_malformed"),
    )
    read_ends = values.filter("lo IS NOT NULL").groupBy("load", "column").agg(*ends(F.col("lo"), F.col("hi")))
    footer = chunks.filter("exact").groupBy("load", "column").agg(F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("n_null"), *ends(F.col("lo"), F.col("hi")))
    parts = scanned.unionByName(read_ends, allowMissingColumns=True).unionByName(footer, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "n_null", "n_distinct", "n_malformed")]
    sides = [a(f"{side}_{k}").alias(f"{side}_{k}") for side, a in (("lo", F.min), ("hi", F.max)) for k in "xys"]
    number = of("byte", "short", "integer", "long")
    profile = parts.groupBy("load", "column").agg(*sums, *sides).filter("n_rows > 0").select(
        F.col("load").alias("load_id"), F.col("column").alias("column_name"), "n_rows", "n_null", F.when(F.col("column").isin(asked or [""]), F.col("n_distinct")).alias("n_distinct"),
        F.when(number, F.col("lo_x")).alias("lo"), F.when(number, F.col("hi_x")).alias("hi"), "n_malformed",
        *[F.coalesce(F.col(f"{side}_x").cast("string"), F.col(f"{side}_y").cast("string"), f"{side}_s").alias(name) for side, name in (("lo", "least"), ("hi", "most"))],
    )
    shares = values.filter(~F.col("none") & F.col("column").isin(asked or [""]))
    return profile, shares.select(F.col("load").alias("load_id"), F.col("column").alias("column_name"), "v1", "v2", "n")


def load_changes(profile: DataFrame, shares: DataFrame) -> DataFrame:
    """For each load and column: the rates and what changed against the load before (next smaller load_id).

    load_id, column_name, null_rate, malformed_rate, distinct_share, d_null, d_malformed, d_distinct, distribution
    (half the sum of the absolute differences of the shares of each non-null value), lo, hi, prior_load_id. All
    changes are null in the first load; a rate over no values is null; a load of nothing but nulls has no shares,
    so its distribution differs from the load before by half the sum of the other's shares.
    """
    filled = F.col("n_rows") - F.col("n_null")
    rates = profile.filter("load_id IS NOT NULL").select(
        "load_id", "column_name", "lo", "hi", (F.col("n_null") / F.col("n_rows")).alias("null_rate"),
        F.try_divide("n_malformed", filled).alias("malformed_rate"), F.try_divide("n_distinct", filled).alias("distinct_share"), filled.alias("filled"),
    )
    w = Window.partitionBy("column_name").orderBy("load_id")
    moved = rates.select(
        "*", F.lag("load_id").over(w).alias("prior_load_id"), F.lead("load_id").over(w).alias("next_load_id"),
        *[(F.col(c) - F.lag(c).over(w)).alias(d) for c, d in (("null_rate", "d_null"), ("malformed_rate", "d_malformed"), ("distinct_share", "d_distinct"))],
    )
    share = shares.join(moved.select("load_id", "column_name", "next_load_id", "filled"), ["load_id", "column_name"]).withColumn("s", F.col("n") / F.col("filled"))
    signed = share.select("column_name", "v1", "v2", F.explode(F.array(F.struct(F.col("load_id").alias("l"), F.col("s").alias("s")), F.struct(F.col("next_load_id").alias("l"), (-F.col("s")).alias("s")))).alias("x")).filter("x.l IS NOT NULL")
    distance = (
        signed.groupBy("column_name", "v1", "v2", F.col("x.l").alias("load_id")).agg(F.sum("x.s").alias("d"))
        .groupBy("load_id", "column_name").agg((F.sum(F.abs("d")) / 2).alias("distribution"))
    )
    out = moved.drop("next_load_id", "filled").join(distance, ["load_id", "column_name"], "left")
    return out.withColumn("distribution", F.when(F.col("prior_load_id").isNotNull(), F.coalesce("distribution", F.lit(0.0))))
