"""Joins by time: the latest earlier row, and points in intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(df: DataFrame, column: str):
    kind = df.schema[column].dataType.typeName()
    return F.col(f"`{column}`").cast("bigint") if kind in ("byte", "short", "integer", "long") else F.unix_micros(F.col(f"`{column}`").cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_at: str, right_at: str, chunk: int = 86_400_000_000, tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """Every left row with `matched`: the latest right row (as a struct) of its keys at or before its time, else null.

    Times are whole numbers, or times compared in microseconds; `chunk` and `tolerance` (how far back a match may lie)
    are in the same unit. Of right rows at one time the one with the largest `tie` wins (without it, the largest row by
    its columns). Null keys and null times match nothing; such left rows are kept.

    Time is divided into chunks, and rows are matched within (keys, chunk), so a key that holds a large share of the rows
    is spread over its chunks. Into a chunk only the last right row of each earlier one can reach; these, one per key and
    chunk, are carried forward by a window over themselves. No range join and no row per pair.
    """
    lk, rk = [f"_mr_k{i}" for i in range(len(on))], [f"_mr_j{i}" for i in range(len(on))]
    row = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    order = F.struct(F.col("_mr_t"), F.col(f"_mr_r.`{tie}`") if tie else F.col("_mr_r"))
    a = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_mr_l"), *[F.col(f"`{x}`").alias(k) for (x, _), k in zip(on, lk)], _micros(left, left_at).alias("_mr_t"))
    b = right.select(row.alias("_mr_r"), *[F.col(f"`{y}`").alias(k) for (_, y), k in zip(on, lk)], _micros(right, right_at).alias("_mr_t"))
    whole = F.col("_mr_t").isNotNull()
    for k in lk:
        whole = whole & F.col(k).isNotNull()
    cell = F.expr(f"(_mr_t - pmod(_mr_t, {chunk}L)) div {chunk}L")
    b = b.filter(whole).withColumns({"_mr_c": cell, "_mr_x": F.struct(F.col("_mr_t").alias("t"), order.alias("o"), F.col("_mr_r").alias("r"))})
    a = a.withColumn("_mr_c", F.when(whole, cell))
    both = a.withColumn("_mr_x", F.lit(None).cast(b.schema["_mr_x"].dataType)).select("_mr_l", *lk, "_mr_t", "_mr_c", "_mr_x")
    both = both.unionByName(b.select(F.lit(None).cast(a.schema["_mr_l"].dataType).alias("_mr_l"), *lk, "_mr_t", "_mr_c", "_mr_x"))
    w = Window.partitionBy(*lk, "_mr_c").orderBy("_mr_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_mr_m", F.max_by(F.col("_mr_x"), F.col("_mr_x.o")).over(w)).filter("_mr_l IS NOT NULL")
    ends = b.groupBy(*lk, "_mr_c").agg(F.max_by("_mr_x", "_mr_x.o").alias("_mr_e"))
    # the last right row before each chunk that has left rows: chunks of both sides, one row each
    cells = a.filter("_mr_c IS NOT NULL").select(*lk, "_mr_c").distinct().join(ends, [*lk, "_mr_c"], "full_outer")
    earlier = F.last("_mr_e", True).over(Window.partitionBy(*lk).orderBy("_mr_c").rowsBetween(Window.unboundedPreceding, -1))
    carried = cells.select(*[F.col(k).alias(j) for k, j in zip(lk, rk)], F.col("_mr_c").alias("_mr_d"), earlier.alias("_mr_b")).filter("_mr_b IS NOT NULL")
    met = F.col("_mr_c") == F.col("_mr_d")
    for k, j in zip(lk, rk):
        met = met & (F.col(k) == F.col(j))
    found = here.join(carried, met, "left").withColumn("_mr_m", F.coalesce("_mr_m", "_mr_b"))
    near = F.col("_mr_m.t") >= F.col("_mr_t") - tolerance if tolerance is not None else F.lit(True)
    return found.select("_mr_l.*", F.when(near, F.col("_mr_m.r")).alias("matched"))


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, cell: int, how: str = "inner") -> DataFrame:
    """Each point with each interval it lies in, `start` and `end` included; columns of both (their names must differ).

    All three are whole numbers, or times compared in microseconds. The line is cut into cells; an interval is sent to
    each cell it touches and a point to its own, so rows meet by an equality and no pair of all with all is made. Intervals
    longer than 64 cells are sent to cells 64 (or 4,096, ..) times as long instead, so that none has more than 65 copies.
    `how` is inner or left. Null points and intervals with a null or a reversed end match nothing.
    """
    sizes = [cell * 64**k for k in range(6) if cell * 64**k < 1 << 62]
    a = points.withColumn("_mr_t", _micros(points, at))
    lo, hi = _micros(intervals, start), _micros(intervals, end)
    b = intervals.withColumns({"_mr_lo": lo, "_mr_hi": hi}).filter("_mr_lo <= _mr_hi")
    floor = lambda c, size: F.expr(f"({c} - pmod({c}, {size}L)) div {size}L")
    level = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        level = F.when(F.col("_mr_hi") - F.col("_mr_lo") <= 64 * sizes[k], k).otherwise(level)
    b = b.withColumn("_mr_v", level)
    cells = lambda c: F.coalesce(*[F.when(F.col("_mr_v") == k, floor(c, size)) for k, size in enumerate(sizes)])
    b = b.withColumn("_mr_c", F.explode(F.sequence(cells("_mr_lo"), cells("_mr_hi"))))
    used = [r[0] for r in b.select("_mr_v").distinct().collect()]  # of six levels at most
    placed = F.explode_outer(F.array(*[F.struct(F.lit(k).alias("v"), floor("_mr_t", sizes[k]).alias("c")) for k in sorted(used) or [0]]))
    if how == "left":
        a = a.withColumn("_mr_id", F.monotonically_increasing_id())
        from millrace.session import cut

        a = cut(a)  # ids must not change between the two uses
    inner = a.withColumn("_mr_p", placed).join(b.withColumnsRenamed({"_mr_c": "_mr_d"}), (F.col("_mr_p.v") == F.col("_mr_v")) & (F.col("_mr_p.c") == F.col("_mr_d")) & F.col("_mr_t").between(F.col("_mr_lo"), F.col("_mr_hi")))
    kept = [F.col(f"`{c}`") for c in (*points.columns, *intervals.columns)]
    if how == "inner":
        return inner.select(*kept)
    met = inner.select("_mr_id", *kept)
    lone = a.join(met.select("_mr_id").distinct(), "_mr_id", "left_anti")
    return met.drop("_mr_id").unionByName(lone.select(*points.columns), allowMissingColumns=True)
