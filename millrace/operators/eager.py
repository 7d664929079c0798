"""Aggregation over a join without expanding the join: pre-aggregate, join compact states, combine algebraically."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    group_left: Sequence[str] = (),
    group_right: Sequence[str] = (),
    sum_left: dict[str, str] | None = None,
    sum_right: dict[str, str] | None = None,
    how: str = "left",
) -> DataFrame:
    """`SELECT groups, count(*), sum(..) FROM left JOIN right ON .. GROUP BY groups`, computed before the join.

    Result: the group columns (those of `right` under their own names), n_left (rows of `left`), n_join (rows
    of the join), and each sum over the rows of the join under the name given to it in `sum_left` or `sum_right`
    (name -> column). `how` is left or inner. A null key meets nothing; a null group is a group; a sum of nothing
    but nulls is null; empty inputs give no rows. n_left counts a left row once for each right group it meets.
    A product beyond bigint raises an error rather than wrapping round.

    Each side is reduced to one state per (key, groups) with map-side combining, so a key that holds most rows
    weighs no more in the shuffle than a rare one. The join sees states only, and its counts are multiplied:
    a left state (n_l, s_l) and a right state (n_r, s_r) give n_l * n_r rows, s_l * n_r and n_l * s_r.
    """
    sum_left, sum_right = sum_left or {}, sum_right or {}
    lk, rk = [f"_mr_l{i}" for i in range(len(on))], [f"_mr_r{i}" for i in range(len(on))]
    gl, gr = [f"_mr_gl{i}" for i in range(len(group_left))], [f"_mr_gr{i}" for i in range(len(group_right))]

    def states(df: DataFrame, keys, key_names, groups, group_names, sums, n):
        picked = df.select(
            *[F.col(f"`{c}`").alias(k) for c, k in zip(keys, key_names)], *[F.col(f"`{c}`").alias(g) for c, g in zip(groups, group_names)],
            *[F.col(f"`{c}`").alias(f"_mr_{n}_{i}") for i, c in enumerate(sums.values())],
        )
        return picked.groupBy(*key_names, *group_names).agg(
            F.count(F.lit(1)).alias(n), *[F.sum(f"_mr_{n}_{i}").alias(f"_mr_s{n}_{i}") for i in range(len(sums))]
        )

    a = states(left, [x for x, _ in on], lk, group_left, gl, sum_left, "_mr_nl")
    b = states(right, [y for _, y in on], rk, group_right, gr, sum_right, "_mr_nr")
    met = F.lit(True)
    for x, y in zip(lk, rk):
        met = met & (F.col(x) == F.col(y))
    times = F.coalesce(F.col("_mr_nr"), F.lit(1).cast("bigint"))
    joined = a.join(b, met, how)
    out = joined.groupBy(*gl, *gr).agg(
        F.sum("_mr_nl").alias("n_left"),
        F.sum(F.col("_mr_nl") * times).alias("n_join"),
        *[F.sum(F.col(f"_mr_s_mr_nl_{i}") * times).alias(name) for i, name in enumerate(sum_left)],
        *[F.sum(F.col("_mr_nl") * F.col(f"_mr_s_mr_nr_{i}")).alias(name) for i, name in enumerate(sum_right)],
    )
    return out.select(
        *[F.col(g).alias(c) for g, c in zip(gl, group_left)], *[F.col(g).alias(c) for g, c in zip(gr, group_right)],
        "n_left", "n_join", *sum_left, *sum_right,
    )


def frequent_groups(stats: DataFrame, weight: str, least_share: float) -> DataFrame:
    """The rows of `stats` whose `weight` is at least `least_share` of the sum of all weights; no row for no rows."""
    total = stats.agg(F.sum(weight).alias("total"))
    return stats.filter(F.col(weight) >= F.lit(least_share) * total.scalar())
