"""Queries of the data-processing problems that belong to the core, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.eager import eager_join_aggregate, frequent_groups
from millrace.operators.profile import column_profile, load_changes
from millrace.operators.sessions import sessions

PROFILED = ("record_index", "case_id", "subject", "ticket_type", "matched_category", "matched_article_count", "source_system", "created_at")
#: What a well-formed value holds.
VALID = {"case_id": r"^[a-z]+_[0-9]+$", "subject": r"\p{L}", "ticket_type": r"\p{L}", "matched_category": r"\p{L}"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = sessions(_table(spark, d, "security_audit_log"), action=None)
    return out.select("actor", "first_event_id", "last_event_id")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = sessions(_table(spark, d, "security_audit_log"))
    entries = F.transform(F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("actions", F.array_join(entries, ","))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return eager_join_aggregate(
        _table(spark, d, "joined_case_output"), _table(spark, d, "knowledge_articles"), on=[("matched_category", "category")],
        group_left=["ticket_type", "matched_category"], sum_left={"sum_article_count": "matched_article_count"},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = frequent_groups(_pairs(spark, d), "n_left", 0.03)
    return found.select(*[F.coalesce(c, F.lit("<null>")).alias(c) for c in ("ticket_type", "matched_category")])


def p3_pair_stats(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumnsRenamed({"n_left": "n_cases", "n_join": "n_case_articles"})


def p3_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    articles = _table(spark, d, "knowledge_articles").select("category", "source_system", F.length("answer").cast("bigint").alias("answer_chars"))
    return eager_join_aggregate(
        _table(spark, d, "joined_case_output"), articles, on=[("matched_category", "category")], group_left=["load_id"],
        group_right=["category"], sum_right={"sum_answer_chars": "answer_chars"}, how="inner",
    ).withColumnsRenamed({"n_left": "n_cases", "n_join": "n_case_articles"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = ("subject", "ticket_type", "matched_article_count")
    profile, shares = column_profile(spark, f"{d}/joined_case_output.parquet", found, valid={c: VALID[c] for c in found[:2]})
    most = _table(spark, d, "knowledge_articles").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("column_name")
    text, count = c.isin("subject", "ticket_type"), c == "matched_article_count"
    metrics = F.array(
        F.when(F.abs("d_null") > 0.10, F.lit("null_rate")),
        F.when(text & (F.col("d_malformed") > 0.06), F.lit("pattern")),
        F.when((c == "subject") & (F.abs("d_distinct") > 0.12), F.lit("distinct_share")),
        F.when(c.isin("ticket_type", "matched_article_count") & (F.col("distribution") > 0.325), F.lit("distribution")),
        F.when(count & ((F.col("lo") < 0) | (F.col("hi") > most.scalar())), F.lit("value_range")),
    )
    out = load_changes(profile, shares).select("load_id", "column_name", F.explode(F.array_compact(metrics)).alias("metric"))
    return out


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    profile, _ = column_profile(spark, f"{d}/joined_case_output.parquet", PROFILED, valid=VALID)
    return profile.drop("least", "most")


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and ranges alone: chunks are opened only where a footer doesn't suffice."""
    profile, _ = column_profile(spark, f"{d}/joined_case_output.parquet", PROFILED, counted=())
    return profile.select("load_id", "column_name", "n_rows", "n_null", "least", "most")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    found = ("subject", "ticket_type", "matched_article_count")
    profile, shares = column_profile(spark, f"{d}/joined_case_output.parquet", found, valid={c: VALID[c] for c in found[:2]})
    rounded = ("null_rate", "malformed_rate", "distinct_share", "d_null", "d_malformed", "d_distinct", "distribution")
    return load_changes(profile, shares).select("load_id", "column_name", "prior_load_id", "lo", "hi", *[F.round(c, 6).alias(c) for c in rounded])


QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p3_found, p3_pair_stats, p3_category_rollup, p5_found, p5_profile, p5_ranges, p5_changes)}

_INSTANT = r"""
CASE WHEN regexp_full_match(ts, '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?([Zz]|[+-]\d{2}:?(\d{2})?)?') AND NOT starts_with(ts, '0000')
     THEN epoch_us(TRY_CAST(regexp_extract(ts, '^(\d{4}-\d{2}-\d{2})', 1) || ' ' || regexp_extract(ts, '^.{11}(\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)', 1) AS TIMESTAMP))
          - CASE WHEN regexp_matches(ts, '[+-]\d{2}:?\d{0,2}$') AND regexp_matches(ts, ':\d{2}(\.\d+)? ?[+-]\d{2}:?\d{0,2}$')
                 THEN (CASE WHEN regexp_extract(ts, '([+-])\d{2}:?\d{0,2}$', 1) = '-' THEN -1 ELSE 1 END)
                      * (60 * regexp_extract(ts, '[+-](\d{2}):?\d{0,2}$', 1)::BIGINT + COALESCE(TRY_CAST(regexp_extract(ts, '[+-]\d{2}:?(\d{2})$', 1) AS BIGINT), 0)) * 60000000
                 ELSE 0 END
     WHEN regexp_full_match(ts, '-?\d{1,16}') AND abs(ts::BIGINT) <= 253402300799999 THEN ts::BIGINT * 1000 END
"""
_SESSIONS = f"""
WITH trimmed AS (
  SELECT event_id, nullif(lower(regexp_replace(actor, '^\\s+|\\s+$', '', 'g')), '') AS actor, regexp_replace("timestamp", '^\\s+|\\s+$', '', 'g') AS ts,
         coalesce(nullif(trim(action), ''), '<none>') AS action FROM security_audit_log),
e AS (SELECT actor, event_id, action, {_INSTANT} AS t FROM trimmed WHERE actor IS NOT NULL),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY actor ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM e WHERE t IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f),
h AS (SELECT actor, s, min(t) AS lo, max(t) AS hi, count(*) AS n FROM g GROUP BY actor, s),
k AS (SELECT actor, s, string_agg(action || '=' || c, ',' ORDER BY action) AS actions FROM (SELECT actor, s, action, count(*) AS c FROM g GROUP BY actor, s, action) GROUP BY actor, s),
z AS (SELECT h.actor, h.s, lo, hi, n, min(event_id) FILTER (WHERE t = lo) AS first_event_id, max(event_id) FILTER (WHERE t = hi) AS last_event_id
      FROM h JOIN g USING (actor, s) GROUP BY h.actor, h.s, lo, hi, n)
"""
_PROFILE = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
    + (f"min({c}) AS lo, max({c}) AS hi, " if c in ("record_index", "matched_article_count") else "NULL::BIGINT AS lo, NULL::BIGINT AS hi, ")
    + (f"count(*) FILTER (WHERE NOT regexp_matches({c}, '{VALID[c]}')) AS n_malformed" if c in VALID else "0::BIGINT AS n_malformed")
    + " FROM joined_case_output GROUP BY load_id"
    for c in PROFILED
)
_CHANGES = f"""
WITH p AS ({_PROFILE}),
r AS (SELECT load_id, column_name, lo, hi, n_null / n_rows AS null_rate, n_malformed / nullif(n_rows - n_null, 0) AS malformed_rate,
             n_distinct / nullif(n_rows - n_null, 0) AS distinct_share FROM p WHERE column_name IN ('subject', 'ticket_type', 'matched_article_count')),
m AS (SELECT *, lag(load_id) OVER w AS prior_load_id, null_rate - lag(null_rate) OVER w AS d_null, malformed_rate - lag(malformed_rate) OVER w AS d_malformed,
             distinct_share - lag(distinct_share) OVER w AS d_distinct FROM r WINDOW w AS (PARTITION BY column_name ORDER BY load_id)),
v AS (SELECT load_id, c AS column_name, x, count(*) AS n FROM (
        SELECT load_id, 'subject' AS c, subject AS x FROM joined_case_output UNION ALL SELECT load_id, 'ticket_type', ticket_type FROM joined_case_output
        UNION ALL SELECT load_id, 'matched_article_count', matched_article_count::VARCHAR FROM joined_case_output) WHERE x IS NOT NULL GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY load_id, column_name) AS s FROM v),
u AS (SELECT m.load_id, m.column_name, q.x, q.s FROM m JOIN q ON q.load_id = m.load_id AND q.column_name = m.column_name
      UNION ALL SELECT m.load_id, m.column_name, q.x, -q.s FROM m JOIN q ON q.load_id = m.prior_load_id AND q.column_name = m.column_name),
t AS (SELECT load_id, column_name, sum(abs(d)) / 2 AS distribution FROM (SELECT load_id, column_name, x, sum(s) AS d FROM u GROUP BY ALL) GROUP BY ALL),
o AS (SELECT m.*, CASE WHEN prior_load_id IS NOT NULL THEN coalesce(distribution, 0) END AS distribution FROM m LEFT JOIN t USING (load_id, column_name))
"""

ORACLES = {
    "p2_found": _SESSIONS + "SELECT actor, first_event_id, last_event_id FROM z",
    "p2_sessions": _SESSIONS
    + "SELECT z.actor, first_event_id, last_event_id, make_timestamp(lo) AS started_at, make_timestamp(hi) AS ended_at, (hi - lo) / 1e6 AS duration_s, n AS n_events, actions FROM z JOIN k USING (actor, s)",
    "p3_found": "SELECT coalesce(ticket_type, '<null>') AS ticket_type, coalesce(matched_category, '<null>') AS matched_category FROM joined_case_output GROUP BY joined_case_output.ticket_type, joined_case_output.matched_category HAVING count(*) >= 0.03 * (SELECT count(*) FROM joined_case_output)",
    "p3_pair_stats": "SELECT ticket_type, matched_category, count(DISTINCT record_index) AS n_cases, count(*) AS n_case_articles, sum(matched_article_count)::BIGINT AS sum_article_count FROM joined_case_output LEFT JOIN knowledge_articles ON matched_category = category GROUP BY ALL",
    "p3_category_rollup": "SELECT load_id, category, count(DISTINCT record_index) AS n_cases, count(*) AS n_case_articles, sum(length(answer))::BIGINT AS sum_answer_chars FROM joined_case_output JOIN knowledge_articles ON matched_category = category GROUP BY ALL",
    "p5_profile": _PROFILE,
    "p5_ranges": " UNION ALL ".join(
        f"SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        + ", ".join(f"{f}({c})".join(("epoch_us(", ")") if c == "created_at" else ("", "")) + f"::VARCHAR AS {n}" for f, n in (("min", "least"), ("max", "most")))
        + " FROM joined_case_output GROUP BY load_id"
        for c in PROFILED
    ),
    "p5_changes": _CHANGES
    + "SELECT load_id, column_name, prior_load_id, lo, hi, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("null_rate", "malformed_rate", "distinct_share", "d_null", "d_malformed", "d_distinct", "distribution")) + " FROM o",
    "p5_found": _CHANGES
    + """SELECT load_id, column_name, metric FROM (
      SELECT load_id, column_name, 'null_rate' AS metric FROM o WHERE abs(d_null) > 0.10
      UNION ALL SELECT load_id, column_name, 'pattern' FROM o WHERE column_name <> 'matched_article_count' AND d_malformed > 0.06
      UNION ALL SELECT load_id, column_name, 'distinct_share' FROM o WHERE column_name = 'subject' AND abs(d_distinct) > 0.12
      UNION ALL SELECT load_id, column_name, 'distribution' FROM o WHERE column_name <> 'subject' AND distribution > 0.325
      UNION ALL SELECT load_id, column_name, 'value_range' FROM o WHERE column_name = 'matched_article_count' AND (lo < 0 OR hi > (SELECT count(*) FROM knowledge_articles)))""",
}
