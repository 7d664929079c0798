"""The support pipeline: three sources normalized, united, joined to the knowledge base by a mapping, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.transforms import empty_to_none, flag_status, parse_timestamp, prefix_id
from millrace.functions.types import SCHEMAS
from millrace.operators.relational import mapping_join_count, union_frames
from millrace.plans.ir import Join, JoinKey, Map, Pipeline, Source, Union
from millrace.sources.connectors import SourceEntry, with_position

#: Ticket type -> category of the knowledge base (fixed values).
TICKET_CATEGORY = {
    "Refund request": "REFUND",
    "Cancellation request": "CANCEL",
    "Billing inquiry": "PAYMENT",
    "Product inquiry": "ORDER",
    "Technical issue": "CONTACT",
}

CASE = SCHEMAS["SupportCase"]


def _as_case(df: DataFrame, **made) -> DataFrame:
    """The canonical case fields; those not given are null."""
    return df.select(*[(made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in CASE.struct().fields])


def map_tickets(df: DataFrame) -> DataFrame:
    c = lambda name: empty_to_none(F.col(f"`{name}`"))
    return _as_case(
        df, case_id=prefix_id(F.col("`Ticket ID`"), "ticket_"), subject=c("Ticket Subject"), description=c("Ticket Description"), status=c("Ticket Status"),
        priority=c("Ticket Priority"), channel=c("Ticket Channel"), created_at=parse_timestamp(c("First Response Time")), resolution=c("Resolution"),
        ticket_type=c("Ticket Type"), source_system=F.lit("support_tickets"),
    )


def map_activity(df: DataFrame) -> DataFrame:
    return _as_case(
        df, case_id=prefix_id(F.col("id"), "api_"), subject=F.col("title"), status=flag_status(F.col("completed")), channel=F.lit("activity_api"),
        source_system=F.lit("support_activity_api"),
    )


def map_articles(df: DataFrame) -> DataFrame:
    """Articles numbered by their position in the source."""
    placed = df if "_ord" in df.columns else with_position(df)
    c = lambda name: empty_to_none(F.col(name))
    return placed.select(
        prefix_id(F.col("_ord"), "kb_").alias("article_id"), c("category").alias("category"), c("intent").alias("intent"), c("instruction").alias("question"),
        c("response").alias("answer"), F.lit("kb_articles").alias("source_system"),
    )


MAPPERS = {"tickets": map_tickets, "activity": map_activity, "articles": map_articles}

CATALOG = [
    SourceEntry(Source("support_tickets", "csv", "data/support_tickets.csv", "SupportCase"), ("ticket", "support", "customer", "issue", "refund", "cancellation", "billing")),
    SourceEntry(Source("kb_articles", "csv", "data/kb_articles.csv", "KnowledgeArticle"), ("kb", "knowledge", "article", "faq", "answer", "question")),
    SourceEntry(Source("support_activity_api", "api", "http://localhost/activity", "SupportCase"), ("api", "activity", "support", "todo", "task")),
]


def support_plan(tickets: Source | None = None, activity: Source | None = None, articles: Source | None = None) -> Pipeline:
    """The pipeline as a plan; its last step is the nested join."""
    sources = [tickets or CATALOG[0].source, activity or CATALOG[2].source, articles or CATALOG[1].source]
    return Pipeline(
        "support", sources,
        [
            Map("ticket_cases", sources[0].name, mapper="tickets"), Map("activity_cases", sources[1].name, mapper="activity"), Map("articles", sources[2].name, mapper="articles"),
            Union("cases", ["ticket_cases", "activity_cases"]),
            Join("joined", "cases", "articles", [JoinKey("ticket_type", "category", dict(TICKET_CATEGORY))]),
        ],
        "JoinedCaseOutput",
    )


OUTPUT = SCHEMAS["JoinedCaseOutput"].names


def joined_output(joined: DataFrame) -> DataFrame:
    """The contract's columns of the nested join."""
    return joined.select("case.case_id", "case.subject", "case.ticket_type", "matched_category", F.size("matched_articles").cast("bigint").alias("matched_article_count"), "case.source_system")


def counted_output(cases: DataFrame, articles: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The same without building the lists of articles: they're counted by category before the join."""
    return mapping_join_count(cases, articles, "ticket_type", mapping if mapping is not None else TICKET_CATEGORY).select(*OUTPUT)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's shape over the test tables: orders and events as cases, parts by type as articles."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    orders = _as_case(read("orders"), case_id=prefix_id(F.col("o_orderkey"), "order_"), subject=F.col("o_orderstatus"), ticket_type=F.col("o_orderpriority"), created_at=F.col("o_orderdate"), source_system=F.lit("orders"))
    events = _as_case(read("events"), case_id=prefix_id(F.col("event_id"), "event_"), subject=F.col("props"), ticket_type=F.col("event_type"), created_at=F.col("ts"), source_system=F.lit("events"))
    mapping = {"1-URGENT": "ECONOMY", "2-HIGH": "SMALL", "3-MEDIUM": "NOSUCH", "purchase": "LARGE", "error": "ECONOMY"}
    return counted_output(union_frames({"orders": orders, "events": events}), read("part").withColumnRenamed("p_type", "category"), mapping)
