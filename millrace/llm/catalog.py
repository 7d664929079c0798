"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bktree, bpe, canon, leak, truncation
from millrace.session import spread


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: table, key, field, shape of the records that problem 1 compares
RECORDS = (
    ("duplicate_flags", "record_index", "field_values", "object"),
    ("api_sample", "id", "title", "text"),
    ("joined_case_output", "record_index", "subject", "text"),
)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, field, shape in RECORDS:
        one = canon.repeated_records(_table(spark, d, table), key, field, shape).select(F.lit(table).alias("table_name"), "keep_id", "copy_id")
        out = one if out is None else out.unionByName(one)
    return out


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, field, shape in RECORDS[1:]:
        groups, _ = canon.copy_groups(_table(spark, d, table), key, field, shape)
        one = groups.select(F.lit(table).alias("table_name"), "keep_id", F.col("n").alias("n_copies"))
        out = one if out is None else out.unionByName(one)
    return out


def p1_object_copies(spark: SparkSession, d: str) -> DataFrame:
    table, key, field, shape = RECORDS[0]
    groups, _ = canon.copy_groups(_table(spark, d, table), key, field, shape)
    return groups.select(F.lit(table).alias("table_name"), "keep_id", F.col("n").alias("n_copies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    mapped = bktree.map_to_canonical(spark, _table(spark, d, "joined_case_output"), "record_index", ("ticket_type", "matched_category"), _table(spark, d, "canonical_values"))
    return mapped.select("record_index", "field_name", "canonical_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = bktree.map_to_canonical(spark, _table(spark, d, "joined_case_output"), "record_index", ("ticket_type", "matched_category"), _table(spark, d, "canonical_values"))
    return mapped.filter("canonical_id = -1").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(_table(spark, d, "documents").select("doc_id", "text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(spread(_table(spark, d, "documents").select("doc_id", "text")), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    found = leak.leaked_passages(spread(_table(spark, d, "documents").select("doc_id", "text")), _table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(spread(_table(spark, d, "documents").select("doc_id", "text", "source"))).filter("truncated").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    judged = truncation.truncated(spread(_table(spark, d, "documents").select("doc_id", "text", "source")))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncated_rate")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_copies, p1_object_copies, p4_found, p4_unmatched, p6_ids, p7_found, p7_items, p8_found, p8_sources)}

_CANON = r"translate(regexp_replace(replace(lower(upper({0})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g'), 'ς', 'σ')"

ORACLES = {
    "p1_copies": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, min({k}) AS keep_id, count(*) AS n_copies FROM {t} WHERE {_CANON.format(f)} <> '' GROUP BY {_CANON.format(f)}" for t, k, f, _ in RECORDS[1:]
    ),
}
