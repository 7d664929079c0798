"""Sources by format name, reading that isolates failures, and sinks."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace.plans.ir import Source

Connector = Callable[[SparkSession, Source], DataFrame]
HTTP_TIMEOUT_S = 15


def read_csv(spark: SparkSession, source: Source) -> DataFrame:
    """Header row, UTF-8, every column a string; quoted fields may hold commas, line breaks and doubled quotes.

    A missing file raises FileNotFoundError (for local paths) or Spark's own error.
    """
    if "://" not in source.location and not source.location.startswith("file:") and not Path(source.location).exists():
        raise FileNotFoundError(source.location)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "inferSchema": False, **source.options}
    return spark.read.options(**options).csv(source.location)


def read_json(spark: SparkSession, source: Source) -> DataFrame:
    """A JSON array of objects (or, with multiLine false, one object per line)."""
    reader = spark.read.options(**{"multiLine": True, **source.options})
    return (reader.schema(_struct(source)) if source.schema_name else reader).json(source.location)


def _struct(source: Source) -> T.StructType:
    from millrace.functions.types import get_schema

    return get_schema(source.schema_name).struct()


def _format(name: str) -> Connector:
    return lambda spark, source: spark.read.format(name).options(**source.options).load(source.location)


def fetch_json(url: str, timeout: float = HTTP_TIMEOUT_S) -> list[dict]:
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        rows = json.load(answer)
    if not isinstance(rows, list):
        raise ValueError(f"{url} doesn't give a list")
    return rows


class HttpJson(DataSource):
    """`spark.read.format("http_json").schema(..).option("url", ..).load()`: one GET, read by a task.

    If the request fails, the rows in the option `fallback_text` are taken instead; without them that's a ConnectionError.
    An answer that is no list is a ValueError in any case.
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return self.options.get("ddl", "userId bigint, id bigint, title string, completed boolean")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(dict(self.options), schema)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, schema.names

    def read(self, partition):
        try:
            rows = fetch_json(self.options["url"], float(self.options.get("timeout", HTTP_TIMEOUT_S)))
        except OSError as problem:
            if "fallback_text" not in self.options:
                raise ConnectionError(f"{self.options['url']}: {problem}") from problem
            rows = json.loads(self.options["fallback_text"])
        for row in rows:
            yield tuple(row.get(n) for n in self.names)


def read_http(spark: SparkSession, source: Source) -> DataFrame:
    spark.dataSource.register(HttpJson)
    """The rows at a URL; if it can't be reached, those of the JSON file in the option `fallback`.

    That file is read here, on the driver, and sent along, so no executor needs it.
    """
    options = {k: str(v) for k, v in source.options.items()}
    fallback = options.pop("fallback", None)
    if fallback and Path(fallback).exists():
        options["fallback_text"] = Path(fallback).read_text(encoding="utf-8")
    reader = spark.read.format("http_json").option("url", source.location).options(**options)
    return (reader.schema(_struct(source)) if source.schema_name else reader).load()


class ConnectorRegistry:
    def __init__(self):
        self._known: dict[str, Connector] = {"csv": read_csv, "json": read_json, "http": read_http, "api": read_http}
        self._known |= {f: _format(f) for f in ("parquet", "orc", "text", "jdbc", "kafka", "avro")}

    def register(self, name: str, connector: Connector) -> None:
        self._known[name] = connector

    def names(self) -> list[str]:
        return sorted(self._known)

    def read(self, spark: SparkSession, source: Source) -> DataFrame:
        if source.format not in self._known:
            raise ValueError(f"no connector for {source.format!r}; known are {self.names()}")
        return self._known[source.format](spark, source)

    def stream(self, spark: SparkSession, source: Source) -> DataFrame:
        """The source as a stream: new files of a folder (its schema is needed), or what arrives in kafka or another
        streaming format, whose options say where. `rate` and the like need no location.
        """
        if source.format in ("http", "api", "jdbc"):
            raise ValueError(f"{source.format!r} can't be read as a stream")
        options = {"multiLine": True, **source.options} if source.format == "json" else source.options
        reader = spark.readStream.format(source.format).options(**options)
        if source.schema_name:
            reader = reader.schema(_struct(source))
        return reader.load(source.location) if source.location else reader.load()


CONNECTORS = ConnectorRegistry()


@dataclass
class SourceEntry:
    """A source in the catalog, with the words a request may use for it."""

    source: Source
    keywords: tuple[str, ...] = ()
    description: str = ""


@dataclass
class IngestResult:
    name: str
    frame: DataFrame | None = None
    count: int = 0
    error: str | None = None
    error_type: str | None = None
    duration_s: float = 0.0

    @property
    def success(self) -> bool:
        return self.error is None


@dataclass
class IngestRun:
    results: list[IngestResult] = field(default_factory=list)

    @property
    def all_succeeded(self) -> bool:
        return bool(self.results) and all(r.success for r in self.results)

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {r.name: r.frame for r in self.results if r.frame is not None}

    @property
    def failed(self) -> list[str]:
        return [r.name for r in self.results if not r.success]

    def summary(self) -> dict:
        return {
            "total": len(self.results), "succeeded": len(self.results) - len(self.failed), "failed": self.failed,
            "errors": {r.name: f"{r.error_type}: {r.error}" for r in self.results if not r.success}, "rows": sum(r.count for r in self.results),
        }


def ingest_one(name: str, read: Callable[[], DataFrame], empty: DataFrame | None = None, count: bool = True) -> IngestResult:
    """Read one source; whatever goes wrong is in the result. Reading is lazy, so an action belongs to the attempt."""
    began = time.monotonic()
    try:
        frame = read()
        n = frame.count() if count else len(frame.take(1))
        return IngestResult(name, frame, n, duration_s=time.monotonic() - began)
    except Exception as problem:  # noqa: BLE001
        return IngestResult(name, empty, 0, str(problem)[:500], type(problem).__name__, time.monotonic() - began)


def ingest_all(readers: dict[str, Callable[[], DataFrame]], empties: dict[str, DataFrame] | None = None, threads: int = 4) -> IngestRun:
    """All sources, side by side; one that fails keeps none of the others from their rows."""
    with ThreadPoolExecutor(max(1, min(threads, len(readers) or 1))) as pool:
        jobs = {n: pool.submit(ingest_one, n, r, (empties or {}).get(n)) for n, r in readers.items()}
        return IngestRun([jobs[n].result() for n in readers])


def with_position(df: DataFrame, name: str = "_ord", order_by: str | None = None) -> DataFrame:
    """`df` with a consecutive position from 0: by `order_by`, else in the order the source is read.

    Positions come from partition sizes and offsets inside partitions, not from one sorted task: rows are numbered
    within range partitions, and each gets the number of rows before its partition.
    """
    # frozen first: two evaluations of a range partitioning may draw its bounds differently
    from millrace.session import cut

    if order_by is not None:
        df = df.repartitionByRange(F.col(order_by).asc_nulls_first()).sortWithinPartitions(F.col(order_by).asc_nulls_first())
    parted = cut(df.withColumns({"_mr_p": F.spark_partition_id(), "_mr_m": F.monotonically_increasing_id()}))
    sizes = parted.groupBy("_mr_p").agg(F.count(F.lit(1)).alias("n"), F.min("_mr_m").alias("first"))
    before = sizes.selectExpr("_mr_p", "first", "coalesce(sum(n) over (order by _mr_p rows between unbounded preceding and 1 preceding), 0) as base")
    out = parted.join(F.broadcast(before), "_mr_p")  # one row per partition
    return out.withColumn(name, (F.col("base") + F.col("_mr_m") - F.col("first")).cast("bigint")).drop("_mr_p", "_mr_m", "base", "first")


def sample_rows(df: DataFrame, n: int = 200) -> DataFrame:
    """The first `n` rows."""
    return df.limit(n)


def sample_to_file(df: DataFrame, path: str, n: int = 200) -> int:
    """The first `n` rows as a JSON array; the number of rows written."""
    return write_json_array(sample_rows(df, n), path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One JSON array in one file, written by the driver partition by partition; the number of rows.

    For readers that want a single file. However many rows, the driver holds one partition at a time; a large output is
    better written by all executors, with `df.write`.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as out:
        out.write("[\n")
        for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            out.write((",\n  " if n else "  ") + row[0])
            n += 1
        out.write("\n]\n")
    return n


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The array that `write_json_array` wrote; with `schema`, times come back as times rather than text."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
