"""Sessions against a row-by-row version, and the defined edge cases."""

import datetime as dt
import random

import pytest

from millrace.operators.sessions import parse_instant, sessions

SCHEMA = "event_id bigint, timestamp string, actor string, action string, a string, t string"


def brute(rows, gap=1800):
    by = {}
    for i, at, actor, action in rows:
        if actor is None or not actor.strip() or at is None:
            continue
        by.setdefault(actor.strip().lower(), []).append((at, i, action))
    out = []
    for actor, es in by.items():
        es.sort(key=lambda e: (e[0], e[1]))
        current = []
        for e in es + [None]:
            if current and (e is None or (e[0] - current[-1][0]).total_seconds() > gap):
                lo, hi = current[0][0], current[-1][0]
                out.append((actor, min(i for a, i, _ in current if a == lo), max(i for a, i, _ in current if a == hi), lo, hi, len(current)))
                current = []
            if e is not None:
                current.append(e)
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    start = dt.datetime(2018, 1, 1)
    rows = []
    for i in range(3000):
        actor = rng.choice(["root"] * 6 + ["Ann", " ann ", "ANN\t", "bob", None, " "])
        at = start + dt.timedelta(seconds=rng.choice([0, 1, 1799, 1800, 1801, 60]) + rng.randrange(0, 400) * 1800)
        rows.append((i, at, actor, rng.choice(["view", "edit", None])))
    df = spark.createDataFrame([(i, at.isoformat(), actor, action, "x", "y") for i, at, actor, action in rows], SCHEMA)
    got = sorted((r.actor, r.first_event_id, r.last_event_id, r.started_at, r.ended_at, r.n_events) for r in sessions(df).collect())
    assert got == brute(rows)
    assert all(sum(r.actions.values()) == r.n_events for r in sessions(df).collect())


@pytest.mark.parametrize("text, micros", [
    ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01 00:00:01", 1_000_000), ("1970-01-01T05:30:01+05:30", 1_000_000), ("1969-12-31T19:00:01.5-0500", 1_500_000),
    (" 1970-01-01T00:00 ", 0), ("1500", 1_500_000), ("-1", -1000), ("2018-02-30T00:00:00Z", None), ("0000-00-00 00:00:00", None), ("12:44", None), ("2018-01-01", None),
    ("pending", None), ("", None), (None, None), ("99999999999999999999", None), ("2018-01-01T24:00:00Z", None), ("2018-13-01T10:00:00", None),
])
def test_parse_instant(spark, text, micros):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert spark.createDataFrame([(text,)], "s string").select(parse_instant(__import__("pyspark").sql.functions.col("s"))).first()[0] == micros
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_form_gives_what_duckdb_gives(spark):
    import itertools

    import duckdb
    from pyspark.sql import functions as F

    from millrace.catalog_data import _INSTANT

    clocks = ["10:11", "10:11:12", "00:00:00.5", "23:59:59.123456", "10:60", "10:11:60"]
    zones = ["", "Z", "z", " Z", "+05:30", "-0430", "+02", " -02:00", "+00:00", "-17:59", "UTC", "+5"]
    texts = [f"{d}{sep}{c}{z}" for d, sep, c, z in itertools.product(["1970-01-01", "2018-02-28", "2018-02-30", "1900-01-01"], "T ", clocks, zones)]
    got = {r.s: r.t for r in spark.createDataFrame([(x,) for x in texts], "s string").select("s", parse_instant(F.col("s")).alias("t")).collect()}
    db = duckdb.connect()
    want = dict(db.execute(f"SELECT ts, {_INSTANT} FROM (SELECT unnest(?) AS ts)", [texts]).fetchall())
    assert got == want and sum(v is not None for v in got.values()) > 200
    assert got["1970-01-01T10:11"] == 36_660_000_000 and got["1970-01-01 10:11+05:30"] == 16_860_000_000


def test_events_without_seconds_count(spark):
    rows = [(1, "2018-01-05 10:11", "a", "v", "", ""), (2, "2018-01-05T10:12:00Z", "a", "v", "", ""), (3, "2018-01-05T12:15+02", "a", "v", "", "")]
    got = sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.first_event_id, r.last_event_id, r.n_events) for r in got] == [(1, 3, 3)]


def test_edges(spark):
    assert sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, "2018-01-01T00:00:00Z", "a", "x" * 5000, None, None) for i in (5, 3, 3, None)]
    r = sessions(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(r) == 1 and (r[0].first_event_id, r[0].last_event_id, r[0].n_events, r[0].duration_s) == (3, 5, 4, 0.0)
    exact = [(1, "2018-01-01T00:00:00Z", "a", "v", "", ""), (2, "2018-01-01T00:30:00Z", "A ", "v", "", ""), (3, "2018-01-01T01:00:00.000001Z", "a", "v", "", "")]
    got = sorted((x.first_event_id, x.last_event_id) for x in sessions(spark.createDataFrame(exact, SCHEMA), action=None).collect())
    assert got == [(1, 2), (3, 3)]
