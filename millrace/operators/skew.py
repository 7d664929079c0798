"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, or than a quarter of a shuffle partition's mean share if
#: that's less; so there are at most max(1 / HOT_SHARE, 4 x shuffle partitions) hot keys.
HOT_SHARE = 1 / 512


def hot_share(spark: SparkSession) -> float:
    return min(HOT_SHARE, 1 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hot_split_join(rows: DataFrame, states: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join `rows` to `states` (one row per `key`, with `weight` = how many rows hold that key).

    Keys that hold more than `hot_share` of all rows are joined by broadcasting their states, of which
    there are at most 1 / `hot_share` whatever the input's size; so no shuffle partition receives a hot key.
    The others meet in an ordinary shuffle join, whose largest key is bounded by `hot_share` of the rows.
    `how` is inner or left. A null key matches nothing. `weight` isn't in the result.
    """
    total = states.agg(F.sum(weight).alias("_mr_total"))
    least = F.coalesce(total.scalar() * F.lit(hot_share(rows.sparkSession)), F.lit(0.0))
    hot = states.filter(F.col(weight) > least).drop(weight)
    cold = states.filter(F.col(weight) <= least).drop(weight)
    keys = F.broadcast(hot.select(F.col(key).alias("_mr_hot")))
    hot_rows = rows.join(F.broadcast(hot), key, "inner")
    cold_rows = rows.join(keys, F.col(key) == F.col("_mr_hot"), "left_anti").join(cold, key, how)
    return hot_rows.unionByName(cold_rows)
