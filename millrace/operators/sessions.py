"""Sessions of activity separated by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)? ?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?$"
_MAX_MS = 253_402_300_799_999  # the last millisecond of the year 9999
#: Number of ids to one instant in a rank; ids lie between minus and plus its half.
_STEP = 1 << 64
#: The characters of Unicode's White_Space property (fixed values).
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(_SPACES))


def clean_key(value: Column) -> Column:
    """Trimmed (all Unicode white space) and in lower case; null where nothing is left."""
    return F.nullif(F.lower(_trimmed(value)), F.lit(""))


def instant_of_trimmed(text: Column) -> Column:
    """`parse_instant` of a text without white space around it. `text` is used several times, so it should be a column."""
    # by its pattern the date has ten characters and the time to minutes sits at 12 to 16; seconds follow if a colon does
    rest = F.substring(text, 17, 64)
    clock = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 5), F.when(F.startswith(rest, F.lit(":")), F.lit("")).otherwise(F.lit(":00")))
    zone = F.when(F.endswith(rest, F.lit("Z")) | F.contains(rest, F.lit("+")) | F.contains(rest, F.lit("-")), F.lit("")).otherwise(F.lit("Z"))
    stamp = F.concat(clock, F.translate(rest, "z ", "Z"), F.when(F.endswith(rest, F.lit("z")), F.lit("")).otherwise(zone))
    number = text.try_cast("bigint")
    return F.when(text.rlike(_ISO), F.when(~F.startswith(text, F.lit("0000")), F.unix_micros(stamp.try_cast("timestamp")))).when(
        text.rlike(r"^-?\d{1,16}$") & (F.abs(number) <= _MAX_MS), number * 1000
    )


def parse_instant(value: Column) -> Column:
    """Microseconds since 1970 of a text that states a date and a time, else null; never raises.

    `2018-01-05T10:11[:12[.123456]]`, with T or a space, with Z, an offset or none (then UTC);
    or a bare whole number of milliseconds since 1970. A date without a time, an impossible date, the hour 24
    and the year 0000 give null. Doesn't depend on the session's time zone.
    """
    return instant_of_trimmed(_trimmed(value))


def sessions(
    events: DataFrame,
    actor: str = "actor",
    at: str = "timestamp",
    event_id: str = "event_id",
    action: str | None = "action",
    gap_s: int = 1800,
) -> DataFrame:
    """One row per session: actor, first_event_id, last_event_id, started_at, ended_at, duration_s, n_events, actions.

    An event more than `gap_s` seconds after the actor's event before it starts a new session; one exactly
    `gap_s` after it doesn't. `at` is a text (see `parse_instant`), a timestamp or microseconds. Events with a
    null or blank actor or no readable instant don't count. first_event_id is the smallest id at the first
    instant, last_event_id the largest at the last; ids are compared as bigint, null ids count as events but
    never as first or last. Each delivered row counts as an event, repeats included. actions maps each action
    to its number of events (null and blank are counted under `<none>`); it is left out if `action` is None.
    An empty table gives no rows. Other columns, whatever their names, are ignored.

    Time is divided into chunks as long as the gap. Two events of one chunk are always in one session, so a
    chunk's local session is an aggregate that is combined before the shuffle: however many rows an actor has,
    at most one row per chunk (and action) leaves a task. Adjacent partial sessions are then merged where the
    gap between them is small enough. That step sees, for one actor, at most (time span / gap) x actions rows.
    """
    gap = gap_s * 1_000_000
    kind = events.schema[at].dataType.simpleString()
    act = F.coalesce(F.nullif(F.trim(F.col(action).cast("string")), F.lit("")), F.lit("<none>")) if action else F.lit("")
    stated = _trimmed(F.col(at)) if kind == "string" else F.col(at) if kind == "bigint" else F.unix_micros(F.col(at).cast("timestamp"))
    picked = events.select(clean_key(F.col(actor).cast("string")).alias("a"), stated.alias("x"), F.col(event_id).cast("bigint").alias("i"), act.alias("k"))
    instant = instant_of_trimmed(F.col("x")) if kind == "string" else F.col("x")
    base = picked.select("a", "i", "k", F.when(F.col("a").isNotNull(), instant).alias("t"))
    # instant and id in one sortable number, so that the smallest id at the first instant needs no sort;
    # decimals have a fixed-width buffer, hence hash aggregation
    chunks = (
        base.select("a", "k", "t", F.expr(f"(t - pmod(t, {gap}L)) div {gap}L").alias("c"), F.expr(f"cast(cast(t AS decimal(20,0)) * {_STEP}BD + cast(i AS decimal(20,0)) AS decimal(38,0))").alias("r"))
        .groupBy("a", "c", "k")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("r").alias("rlo"), F.max("r").alias("rhi"), F.count(F.lit(1)).alias("n"))
        # on a result of the aggregate, so that the filter isn't pushed below it, where it would parse every time again
        .filter("lo IS NOT NULL")
    )
    by_actor = Window.partitionBy("a").orderBy("lo", "c", "k")
    before = F.max("hi").over(by_actor.rowsBetween(Window.unboundedPreceding, -1))
    numbered = (
        chunks.withColumn("new", F.when(F.col("lo") - before <= gap, 0).otherwise(1))
        .withColumn("s", F.sum("new").over(by_actor.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    per_action = numbered.groupBy("a", "s", "k").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("rlo").alias("rlo"), F.max("rhi").alias("rhi"), F.sum("n").alias("n")
    )
    one = per_action.groupBy("a", "s").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("rlo").alias("rlo"), F.max("rhi").alias("rhi"), F.sum("n").alias("n"),
        *([F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("actions")] if action else []),
    )
    back = f"cast({{0}} - floor(({{0}} + {_STEP // 2}BD) / {_STEP}BD) * {_STEP}BD AS bigint)"
    return one.select(
        F.col("a").alias("actor"), F.expr(back.format("rlo")).alias("first_event_id"), F.expr(back.format("rhi")).alias("last_event_id"),
        F.timestamp_micros("lo").cast("timestamp_ntz").alias("started_at"), F.timestamp_micros("hi").cast("timestamp_ntz").alias("ended_at"),
        ((F.col("hi") - F.col("lo")) / 1e6).alias("duration_s"), F.col("n").alias("n_events"), *(["actions"] if action else []),
    )
