"""The seven plan operators as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.transforms import lookup, parse_timestamp
from millrace.functions.types import TYPES
from millrace.plans.check import parse_condition
from millrace.plans.ir import Aggregation, JoinKey


class SchemaMismatchError(ValueError):
    pass


def cast_column(df: DataFrame, field: str, to: str) -> DataFrame:
    """`field` as canonical type `to`; what can't be cast becomes null."""
    value = F.col(f"`{field}`")
    kind = TYPES.get(to).spark
    text = df.schema[field].dataType.typeName() == "string"
    made = parse_timestamp(value) if to == "Timestamp" and text else value.try_cast(kind)
    return df.withColumn(field, made)


def cast_failures(df: DataFrame, field: str, to: str) -> DataFrame:
    """One row: field, n_values (non-null before), n_failed (null after the cast)."""
    after = cast_column(df.select(F.col(f"`{field}`").alias("before"), F.col(f"`{field}`").alias(field)), field, to)
    return after.agg(F.lit(field).alias("field"), F.count("before").alias("n_values"), F.count_if(F.col("before").isNotNull() & F.col(f"`{field}`").isNull()).alias("n_failed"))


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet `field == 'v'`, `field != 'v'` (which keeps nulls) or any other Spark SQL condition.

    In the two simple forms the literal is cast to the field's type; one that can't be cast equals nothing.
    """
    simple = parse_condition(condition)
    if simple is None or simple[0] not in df.columns:
        return df.filter(F.expr(condition.replace("==", "=") if simple else condition))
    name, op, text = simple
    value = F.lit(text).try_cast(df.schema[name].dataType)
    # a literal that can't be cast is null, but it doesn't mean null
    same = F.col(f"`{name}`").eqNullSafe(value) & value.isNotNull()
    return df.filter(same if op == "==" else ~same)


def _meet(a: Column, b: Column, key: JoinKey, null_safe: bool) -> Column:
    if key.mapping is not None:
        return lookup(a.cast("string"), key.mapping) == b
    return a.eqNullSafe(b) if null_safe else a == b


def join_frames(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[JoinKey],
    how: str = "left",
    shape: str = "flat",
    one_to_many: bool = True,
    null_safe: bool = False,
    order_by: str | None = None,
    left_name: str = "record",
    right_name: str = "matched",
) -> DataFrame:
    """Join on all key pairs.

    flat: the columns of both sides; those of the right whose names occur on the left get the prefix `right_`; a mapped
    key adds `matched_category`. nested: a struct of the left row and, with `one_to_many`, an array of the matching
    right rows, else the first one by `order_by` (by all columns if that's None). Nested right and full joins add a
    row for each right row without a match, with a null left struct.
    `how` is inner, left, right, full, semi or anti; the last two are flat and have the left columns only.
    """
    mapped = [k for k in on if k.mapping is not None]
    names = [f"_mr_k{i}" for i in range(len(on))]
    lk = [lookup(F.col(f"`{k.left}`").cast("string"), k.mapping) if k.mapping is not None else F.col(f"`{k.left}`") for k in on]
    rk = [F.col(f"`{k.right}`") for k in on]
    equal = lambda: [F.col(f"_l{n}").eqNullSafe(F.col(f"_r{n}")) if null_safe and k.mapping is None else F.col(f"_l{n}") == F.col(f"_r{n}") for n, k in zip(names, on)]
    a = left.select("*", *[c.alias(f"_l{n}") for c, n in zip(lk, names)])
    category = F.col(f"_l{names[on.index(mapped[0])]}") if mapped else None
    drop = [f"_l{n}" for n in names] + [f"_r{n}" for n in names]
    if shape == "flat" and one_to_many:
        renamed = [F.col(f"`{c}`").alias(f"right_{c}" if c in left.columns else c) for c in right.columns]
        b = right.select(*renamed, *[c.alias(f"_r{n}") for c, n in zip(rk, names)])
        out = a.join(b, equal(), {"full": "outer", "semi": "left_semi", "anti": "left_anti"}.get(how, how))
        return (out.withColumn("matched_category", category) if category is not None else out).drop(*drop)
    whole = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    keyed = right.select(whole.alias("_mr_row"), *[c.alias(f"_r{n}") for c, n in zip(rk, names)])
    rn = [f"_r{n}" for n in names]
    if one_to_many:
        b = keyed.groupBy(*rn).agg(F.collect_list("_mr_row").alias("_mr_m"))
    else:
        order = F.col(f"_mr_row.`{order_by}`") if order_by else F.col("_mr_row")
        b = keyed.groupBy(*rn).agg(F.min_by("_mr_row", order).alias("_mr_m"))
    out = a.join(b, equal(), {"full": "outer"}.get(how, how))
    absent = F.lit(True)
    for n in names:
        absent = absent & F.col(f"_l{n}").isNull()
    record = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    if how in ("right", "full"):
        marked = a.withColumn("_mr_here", F.lit(True)).join(b, equal(), {"full": "outer"}.get(how, how))
        out, record = marked, F.when(F.col("_mr_here"), record)
    matches = F.coalesce(F.col("_mr_m"), F.array().cast(b.schema["_mr_m"].dataType)) if one_to_many else F.col("_mr_m")
    picked = [record.alias(left_name), *([category.alias("matched_category")] if category is not None else []), matches.alias(right_name)]
    if shape == "flat":
        return out.select(*[F.col(f"`{c}`") for c in left.columns], *([category.alias("matched_category")] if category is not None else []),
                          *[F.col(f"_mr_m.`{c}`").alias(f"right_{c}" if c in left.columns else c) for c in right.columns])
    return out.select(*picked)


def mapping_join_count(cases: DataFrame, articles: DataFrame, key: str, mapping: dict[str, str], category: str = "category") -> DataFrame:
    """Every case with `matched_category` (null if its key isn't mapped) and `matched_article_count` (0 without a match).

    The articles are counted by category before the join, so it carries a number instead of a list, and its right
    side has a row for each category at most; how it is joined is left to the measured size.
    """
    per = articles.groupBy(F.col(f"`{category}`").alias("_mr_c")).agg(F.count(F.lit(1)).alias("_mr_n"))
    tagged = cases.withColumn("matched_category", lookup(F.col(f"`{key}`"), mapping))
    out = tagged.join(per, F.col("matched_category") == F.col("_mr_c"), "left")
    return out.withColumn("matched_article_count", F.coalesce("_mr_n", F.lit(0).cast("bigint"))).drop("_mr_c", "_mr_n")


def aggregate_rows(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Aggregation], grouping: str | Sequence[Sequence[str]] = "plain") -> DataFrame:
    """sum, count, avg, min, max, count_distinct, approx_distinct (a sketch of fixed size) by group; a null key is a
    group. Nulls are left out; sum and avg of nothing are 0, min and max null. No rows give no groups, also without keys.

    `grouping` is plain, rollup, cube or a list of grouping sets; with these a column `grouping_id` tells which keys are
    summed over (bit by bit, the last key's the lowest), since their null isn't the null of a value.
    """
    def one(a: Aggregation) -> Column:
        c = F.lit(1) if a.field == "*" else F.col(f"`{a.field}`")
        made = {
            "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "count": lambda: F.count(c), "avg": lambda: F.coalesce(F.avg(c), F.lit(0.0)),
            "min": lambda: F.min(c), "max": lambda: F.max(c), "count_distinct": lambda: F.count_distinct(c), "approx_distinct": lambda: F.approx_count_distinct(c),
        }
        if a.function not in made:
            raise ValueError(f"unknown function {a.function!r}")
        return made[a.function]().alias(a.alias)

    keys = [F.col(f"`{g}`") for g in group_by]
    if grouping != "plain":
        made = [one(a) for a in aggregations] + [F.grouping_id().alias("grouping_id")]
        if isinstance(grouping, str):
            return getattr(df, grouping)(*keys).agg(*made)
        return df.groupingSets([[F.col(f"`{g}`") for g in x] for x in grouping], *keys).agg(*made)
    if keys:
        return df.groupBy(*keys).agg(*[one(a) for a in aggregations])
    return df.agg(*[one(a) for a in aggregations], F.count(F.lit(1)).alias("_mr_n")).filter("_mr_n > 0").drop("_mr_n")


def window_column(
    df: DataFrame, function: str, alias: str, partition_by: Sequence[str] = (), order_by: Sequence[str] = (), field: str | None = None,
    descending: bool = False, offset: int = 1, frame: Sequence[int | None] | None = None, tie: str | None = None, frame_kind: str = "rows",
) -> DataFrame:
    """`df` with a window column. Nulls sort first; ties keep no order unless `tie` names a column that breaks them.

    frame: rows before and after the current one, None for unbounded; aggregates without a frame span the partition,
    or up to the current row if there's an order. With `frame_kind` range the frame's ends are differences of the one
    (numeric) ordering column instead of numbers of rows.
    """
    order = [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    order += [F.col(f"`{tie}`").asc()] if tie else []
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in partition_by])
    w = w.orderBy(*order) if order else w
    c = F.col(f"`{field}`") if field else None
    if function in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        made = getattr(F, function)()
    elif function == "ntile":
        made = F.ntile(offset)
    elif function in ("lag", "lead"):
        made = getattr(F, function)(c, offset)
    elif function in ("first", "last", "sum", "count", "avg", "min", "max"):
        made = getattr(F, function)(F.lit(1) if c is None else c)
        if frame is not None or order:
            low, high = frame if frame is not None else (None, 0)
            w = (w.rangeBetween if frame_kind == "range" else w.rowsBetween)(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    else:
        raise ValueError(f"unknown function {function!r}")
    return df.withColumn(alias, made.over(w))


def top_per_group(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], k: int, alias: str = "rank") -> DataFrame:
    """The first `k` rows of each group; planned as a group limit, which keeps k rows per task before the shuffle."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(alias, F.row_number().over(w)).filter(F.col(alias) <= k)


def check_union(frames: dict[str, DataFrame], types: bool = False) -> list[str]:
    """What keeps the frames from being united: differing field names, and with `types` differing types."""
    items = list(frames.items())
    errors = []
    for name, df in items[1:]:
        first_name, first = items[0]
        missing, extra = sorted(set(first.columns) - set(df.columns)), sorted(set(df.columns) - set(first.columns))
        if missing or extra:
            errors.append(f"{name} against {first_name}: missing {missing}, extra {extra}")
        elif types:
            errors += [f"{name}.{c}: {df.schema[c].dataType.simpleString()} against {first.schema[c].dataType.simpleString()}" for c in first.columns if df.schema[c].dataType != first.schema[c].dataType]
    return errors


def union_frames(frames: dict[str, DataFrame], tag: str | None = None) -> DataFrame:
    """All rows of all frames, columns matched by name; with `tag`, a column that names each row's frame."""
    errors = check_union(frames)
    if errors:
        raise SchemaMismatchError("; ".join(errors))
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name)) if tag else df
        out = df if out is None else out.unionByName(df)
    return out


def set_rows(frames: Sequence[DataFrame], kind: str, all: bool = False) -> DataFrame:
    """distinct rows of one frame, or intersect or except of two whose columns are matched by name; nulls equal nulls.

    `all` keeps numbers of rows: the smaller one (intersect), or the first's less the second's (except).
    """
    a, *rest = frames
    if kind == "distinct":
        return a.distinct()
    errors = check_union({"first": a, "second": rest[0]})
    if errors:
        raise SchemaMismatchError("; ".join(errors))
    b = rest[0].select(*[F.col(f"`{c}`") for c in a.columns])
    made = {("intersect", False): a.intersect, ("intersect", True): a.intersectAll, ("except", False): a.subtract, ("except", True): a.exceptAll}
    if (kind, all) not in made:
        raise ValueError(f"unknown kind {kind!r}")
    return made[kind, all](b)


def source_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """source, n_rows of each frame."""
    return union_frames({n: d.select(F.lit(n).alias("source")) for n, d in frames.items()}).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_flags(df: DataFrame, source: str = "source_system", order: str | None = None, ignore: Sequence[str] = (), counts: bool = False) -> DataFrame:
    """Groups of rows that agree in all columns but `source`, `order` and `ignore`: those columns, record_index (smallest
    `order`), sources (sorted, one for each row), n_rows and, with `counts`, source_counts (source -> rows; null sources count in n_rows only). Nulls agree with nulls. No row is removed from `df`.
    """
    keys = [c for c in df.columns if c not in {source, order, *ignore}]
    by = [F.col(f"`{k}`") for k in keys]
    # rows are counted by source first, so a group travels as one entry for each source, however many rows it has
    first = [F.min(F.col(f"`{order}`")).alias("_mr_o")] if order else []
    counted = df.groupBy(*by, F.col(f"`{source}`").alias("_mr_s")).agg(F.count(F.lit(1)).alias("_mr_n"), *first)
    made = [F.array_sort(F.collect_list(F.when(F.col("_mr_s").isNotNull(), F.struct("_mr_s", "_mr_n")))).alias("_mr_l"), F.sum("_mr_n").alias("n_rows")]
    made += [F.min("_mr_o").alias("record_index")] if order else []
    out = counted.groupBy(*by).agg(*made).filter("n_rows > 1")
    listed = F.flatten(F.transform("_mr_l", lambda x: F.array_repeat(x["_mr_s"], x["_mr_n"].cast("int"))))
    return out.select(*by, listed.alias("sources"), "n_rows", *(["record_index"] if order else []), *([F.map_from_entries("_mr_l").alias("source_counts")] if counts else []))
