"""The metric, the tree against a scan, and values mapped to a reference list."""

import random

from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import bktree as B

word = st.text(alphabet="abc", max_size=7)


@given(word, word, word)
def test_a_true_metric(a, b, c):
    d = lambda x, y: B.distance(x, y, 99)
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b)
    assert d(a, c) <= d(a, b) + d(b, c)
    for most in range(4):
        assert B.distance(a, b, most) == min(d(a, b), most + 1)


def test_transpositions_cost_one():
    assert B.distance("ca", "abc", 9) == 2 and B.distance("order", "roder", 9) == 1 and B.distance("kitten", "sitting", 9) == 3


@given(st.lists(word, min_size=1, max_size=60), word, st.integers(0, 3))
def test_tree_gives_every_entry_within_reach(entries, text, radius):
    tree = B.BKTree([(e, 1) for e in entries])
    assert sorted(tree.within(text, radius)) == sorted((B.distance(text, e, 99), e) for e in set(entries) if B.distance(text, e, 99) <= radius)


ENTRIES = [(1, "Technical issue"), (2, "Refund request"), (3, "Loyalty points dispute"), (4, "Order")]


def test_what_stands_for_what():
    m = B.Matcher(ENTRIES)
    for value, want in (
        ("TECHNICAL  ISSUE!", 1), ("issue / Tehcnical", 1), ("T3chnica1 is", 1), ("Rfnd reques", 2), ("Refunds request #2", 2), ("Réfund-request pls", 2), ("dispute, points, Loyalty", 3),
        ("Techni. issue", 1), ("0rder", 4), ("Оrder", 4), ("oorder", 4),
    ):
        assert m.best(value) and m.best(value)[1] == want, value
    for value in ("", "   ", "123", "?!", "coffee machine", "other", "n/a", "x" * 20_000, "tbd"):
        assert m.best(value) is None, value[:20]


def test_typos_of_a_long_list_are_found():
    rng = random.Random(2)
    entries = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))) for i in range(150)]
    m = B.Matcher(entries)
    for i, e in entries:
        k = rng.randrange(1, 9)
        assert m.best(e[:k] + e[k + 1 :])[1] == i


@given(word, st.lists(word, max_size=30))
def test_distances_at_once(a, texts):
    assert B.distances(a, texts).tolist() == [B.distance(a, t, 99) for t in texts]


def test_rules_are_parameters():
    strict = B.Matcher(ENTRIES, B.Rules(radius=(), most=0))
    assert strict.best("techncal issue") is None and strict.best("technical issue")[1] == 1
    assert B.Matcher(ENTRIES, B.Rules(fillers=frozenset({"kindly"}))).best("kindly order")[1] == 4 and B.Matcher(ENTRIES).best("kindly order") is None


def test_a_long_list_in_shards(spark, monkeypatch):
    """Every entry within the radius is met by some shard: typos of a list of 3,000 entries map as over one tree."""
    rng = random.Random(6)
    monkeypatch.setattr(B, "SHARD_ENTRIES", 500)
    monkeypatch.setattr(B, "TREES_AT_ONCE", 1 << 20)
    entries = sorted({"".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(8, 14))) for _ in range(3000)})
    ref = spark.createDataFrame([(i, "f", e) for i, e in enumerate(entries)], "canonical_id bigint, field_name string, canonical_value string")
    asked = {}
    for i in rng.sample(range(len(entries)), 120):
        k = rng.randrange(1, 7)
        asked[entries[i][:k] + rng.choice("xz") + entries[i][k + 1 :]] = i
    df = spark.createDataFrame([(n, v) for n, v in enumerate(asked)], "id bigint, f string")
    got = {r.value: r.canonical_id for r in B.map_to_canonical(spark, df, "id", ("f",), ref).collect()}
    whole = B.Matcher(list(enumerate(entries)))
    assert got == {v: whole.best(v)[1] for v in asked}
    assert sum(got[v] == i for v, i in asked.items()) >= 0.97 * len(asked)


def test_rows(spark, monkeypatch):
    rows = [(i, "Technical issue" if i % 3 == 0 else ["tchnical issue", None, "coffee", "REFUND REQUEST", ""][i % 5], "ordr" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, f string, value string")
    ref = spark.createDataFrame([(i, "f", v) for i, v in ENTRIES[:3]] + [(4, "value", "Order"), (None, "f", "none"), (9, None, "x")], "canonical_id bigint, field_name string, canonical_value string")

    def run():
        return sorted(tuple(r) for r in B.map_to_canonical(spark, df, "id", ("f", "value"), ref).collect())

    want = []
    for i, f, v in rows:
        if f is not None and f != "Technical issue":
            want.append((i, "f", f, {"tchnical issue": 1, "REFUND REQUEST": 2}.get(f, -1)))
        if v is not None:
            want.append((i, "value", v, 4))
    assert run() == sorted(want)
    monkeypatch.setattr(B, "SHARD_ENTRIES", 1)  # one tree for each entry; the winners are merged
    assert run() == sorted(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, f string")
    ref = spark.createDataFrame([], "canonical_id bigint, field_name string, canonical_value string")
    assert [tuple(r) for r in B.map_to_canonical(spark, df, "id", ("f",), ref).collect()] == [(1, "f", "a", -1)]
    assert B.map_to_canonical(spark, df.limit(0), "id", ("f",), ref).count() == 0
