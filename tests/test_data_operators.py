"""Eager joins, column profiles and balanced joins against plain versions, with their edge cases."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators.eager import eager_join_aggregate, frequent_groups
from millrace.operators.profile import ScanReport, chunk_statistics, column_profile, load_changes, located, open_coded
from millrace.operators.skew import hot_split_join


def test_eager_join_equals_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for _ in range(400)], "k string, g string, n_left bigint")
    right = spark.createDataFrame([(rng.choice(["hot", "hot", "b", "c", None]), rng.choice([3, None]), rng.choice(["p", None])) for _ in range(60)], "k string, w bigint, h string")
    for how in ("inner", "left"):
        got = eager_join_aggregate(left, right, [("k", "k")], ["g"], ["h"], {"sv": "n_left"}, {"sw": "w"}, how)
        a, b = left.alias("a"), right.alias("b")
        want = a.join(b, F.col("a.k") == F.col("b.k"), how).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("a.n_left").alias("sv"), F.sum("w").alias("sw"))
        rows = lambda d, n: sorted(map(str, d.select("g", "h", n, "sv", "sw").collect()))
        assert rows(got.withColumnRenamed("n_join", "n"), "n") == rows(want, "n")


def test_eager_join_edges(spark):
    empty = spark.createDataFrame([], "k string, v bigint")
    one = spark.createDataFrame([("a", 2)], "k string, v bigint")
    assert eager_join_aggregate(empty, one, [("k", "k")], ["k"]).count() == 0
    got = eager_join_aggregate(one, empty, [("k", "k")], ["k"], sum_right={"s": "v"}).first()
    assert (got.n_left, got.n_join, got.s) == (1, 1, None)
    assert frequent_groups(eager_join_aggregate(empty, one, [("k", "k")], ["k"]), "n_left", 0.03).count() == 0


def test_frequent_groups_takes_the_limit_itself(spark):
    df = spark.createDataFrame([("a", 3), ("b", 97)], "k string, n bigint")
    assert {r.k for r in frequent_groups(df, "n", 0.03).collect()} == {"a", "b"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_split_join(spark, how):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"c{i}", i) for i in range(3000)] + [(None, 1), ("lone", 2)], "k string, v bigint")
    states = rows.filter("k <> 'lone'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = hot_split_join(rows, states, "k", "n", how)
    want = rows.join(states.drop("n"), "k", how)
    assert sorted(map(str, got.select("k", "v", "top").collect())) == sorted(map(str, want.select("k", "v", "top").collect()))


def write(path, rows, groups):
    schema = pa.schema([("load_id", pa.int64()), ("subject", pa.string()), ("ticket_type", pa.string()), ("matched_article_count", pa.int64()), ("column", pa.string())])
    with pq.ParquetWriter(path, schema) as w:
        at = 0
        for n in groups:
            w.write_table(pa.Table.from_pylist(rows[at : at + n], schema=schema))
            at += n


def test_profile_reads_only_what_footers_lack(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        {"load_id": 1 + i // 250, "subject": rng.choice([None, "", "42", "Ä b", "ü" * 100]), "ticket_type": rng.choice(["t", None]), "matched_article_count": rng.choice([None, -5, 7]), "column": "c"}
        for i in range(1000)
    ]
    path = str(tmp_path / "t.parquet")
    write(path, rows, [250, 150, 200, 400])
    columns = ("subject", "ticket_type", "matched_article_count", "column")
    stats = {(r.row_group, r.column): r.exact for r in chunk_statistics(spark, path, "load_id", columns).collect()}
    assert stats[0, "ticket_type"] and stats[0, "matched_article_count"]
    assert not stats[2, "ticket_type"]  # holds two loads
    assert not stats[0, "subject"]  # its largest value is too long to be known exactly
    profile, shares = column_profile(spark, path, columns, valid={"subject": r"\p{L}"})
    got = {(r.load_id, r.column_name): r for r in profile.collect()}
    for load in (1, 2, 3, 4):
        for c in columns:
            vs = [r[c] for r in rows if r["load_id"] == load]
            full = [v for v in vs if v is not None]
            r = got[load, c]
            assert (r.n_rows, r.n_null, r.n_distinct) == (len(vs), len(vs) - len(full), len(set(full)))
            if c == "matched_article_count":
                assert (r.lo, r.hi) == (min(full), max(full))
            if c == "subject":
                assert r.n_malformed == sum(not any(ch.isalpha() for ch in v) for v in full)
    assert shares.filter("column_name = 'ticket_type'").agg(F.sum("n")).first()[0] == sum(r["ticket_type"] is not None for r in rows)


def test_chunks_are_opened_only_where_footers_lack(spark, tmp_path):
    import datetime as dt

    schema = pa.schema([("load_id", pa.int64()), ("n", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("at", pa.timestamp("us")), ("day", pa.date32()), ("ok", pa.bool_())])
    start = dt.datetime(2020, 1, 1)
    rows = [
        {"load_id": None if k == 3 else k, "n": i - 7 if i % 5 else None, "d": float("nan") if i % 11 == 0 else i / 4, "s": None if i % 3 == 0 else f"v{i % 40:02d}", "at": start + dt.timedelta(hours=i * k), "day": (start + dt.timedelta(days=i)).date(), "ok": i % 2 == 0}
        for k in (1, 2, 3, 4) for i in range(k, 100)
    ]
    columns = schema.names[1:]
    groups = {"by_load": [[r for r in rows if r["load_id"] == k] for k in (1, 2, 4, None)], "mixed": [rows[:150], rows[150:]]}
    seen = {}
    for name, parts in groups.items():
        path = str(tmp_path / f"{name}.parquet")
        with pq.ParquetWriter(path, schema) as w:
            for part in parts:
                w.write_table(pa.Table.from_pylist(part, schema=schema))
        reads = ScanReport(spark)
        profile, shares = column_profile(spark, path, columns, counted=(), reads=reads)
        seen[name] = {(r.load_id, r.column_name): (r.n_rows, r.n_null, r.n_distinct, r.least, r.most) for r in profile.collect()}
        assert shares.count() == 0
        # by load: only those of the null load, whose footer doesn't name a load, and doubles with NaN, which have no statistics there
        assert reads.chunks.value == 12 if name == "mixed" else reads.chunks.value <= 6 + 3
        assert reads.bytes.value > 0 and reads.values.value > 0
    assert seen["by_load"] == seen["mixed"]
    us = lambda t: str(int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    for k in (1, 2, 3, 4):
        vs = [r for r in rows if r["load_id"] == (None if k == 3 else k)]
        got = {c: seen["mixed"][None if k == 3 else k, c] for c in columns}
        assert got["n"] == (len(vs), sum(r["n"] is None for r in vs), None, str(min(r["n"] for r in vs if r["n"] is not None)), "92")
        assert got["s"][3:] == (min(r["s"] for r in vs if r["s"]), max(r["s"] for r in vs if r["s"])) and got["ok"][3:] == ("0", "1")
        assert got["at"][3:] == (us(min(r["at"] for r in vs)), us(max(r["at"] for r in vs))) and got["d"][4] == "24.5"
    reads = ScanReport(spark)
    column_profile(spark, str(tmp_path / "by_load.parquet"), ("n", "s"), counted=("s",), reads=reads)[0].count()
    assert reads.chunks.value == 4 + 1  # all of s, and of n only the null load's


def test_places_of_files():
    assert located("file:///a/b c%20.parquet") == ("", "/a/b c%20.parquet") and located("/a/b") == ("", "/a/b")
    assert located("s3a://bucket/a b/c.parquet") == ("s3://bucket/", "a b/c.parquet")
    assert located("hdfs://host:9000/a/b") == ("hdfs://host:9000/", "a/b")


def test_profile_edges(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(path, [], [0])
    profile, shares = column_profile(spark, path, ("subject",))
    assert profile.count() == 0 and load_changes(profile, shares).count() == 0
    nulls = [{"load_id": k, "subject": None, "ticket_type": None, "matched_article_count": None, "column": None} for k in (1, 1, None)]
    other = str(tmp_path / "n.parquet")
    write(other, nulls, [2, 1])
    profile, shares = column_profile(spark, other, ("subject", "matched_article_count"))
    got = {(r.load_id, r.column_name): (r.n_rows, r.n_null, r.n_distinct, r.lo) for r in profile.collect()}
    assert got[1, "subject"] == (2, 2, 0, None) and got[None, "matched_article_count"] == (1, 1, 0, None)
    assert all(r.d_null is None and r.distribution is None for r in load_changes(profile, shares).collect())


def test_changes_between_loads(spark, tmp_path):
    rows = [{"load_id": 3, "subject": "a", "ticket_type": t, "matched_article_count": 1, "column": None} for t in "aabb"]
    rows += [{"load_id": 8, "subject": s, "ticket_type": t, "matched_article_count": 1, "column": None} for s, t in (("a", "b"), (None, "b"), ("c", "b"), ("d", "c"))]
    path = str(tmp_path / "t.parquet")
    write(path, rows, [8])
    got = {(r.load_id, r.column_name): r for r in load_changes(*column_profile(spark, path, ("subject", "ticket_type"))).collect()}
    assert got[8, "ticket_type"].distribution == pytest.approx(0.5) and got[8, "ticket_type"].prior_load_id == 3
    assert got[8, "subject"].d_null == pytest.approx(0.25) and got[8, "subject"].d_distinct == pytest.approx(0.75)


def test_texts_are_counted_by_dictionary_code(spark, tmp_path):
    rows = [{"load_id": 1 + i % 3, "subject": None if i % 7 == 0 else f"{i % 9000} {'x' * 200}", "ticket_type": "ab"[i % 2], "matched_article_count": i % 5, "column": None} for i in range(30_000)]
    path = str(tmp_path / "t.parquet")
    write(path, rows, [20_000, 10_000])  # too many long subjects for one dictionary: later pages are plain
    table = open_coded(path).read_row_group(0)
    assert pa.types.is_dictionary(table.schema.field("subject").type) and pa.types.is_dictionary(table.schema.field("ticket_type").type)
    assert pa.types.is_int64(table.schema.field("load_id").type)
    profile, shares = column_profile(spark, path, ("subject", "ticket_type", "matched_article_count", "column"))
    got = {(r.load_id, r.column_name): (r.n_rows, r.n_null, r.n_distinct) for r in profile.collect()}
    for load in (1, 2, 3):
        for c in ("subject", "ticket_type", "matched_article_count", "column"):
            vs = [r[c] for r in rows if r["load_id"] == load]
            assert got[load, c] == (len(vs), vs.count(None), len({v for v in vs if v is not None}))
