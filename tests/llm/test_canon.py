"""Copies hidden by formatting, against plain Python, with collisions, hot groups and the defined edge cases."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import canon


def brute(rows, form):
    groups = {}
    for i, text in rows:
        c = form(text)
        if c:
            groups.setdefault(c, []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


@pytest.mark.parametrize("text, want", [
    ("  Ab-C\t1!", "abc1"), ("STRASSE", "strasse"), ("Straße", "strasse"), ("é", "é"), ("É", "é"), ("ΣΑΣ", "σασ"), ("​x﻿­y", "xy"), ("１٣", "１٣"), ("…", ""), ("", ""), ("x" * 50_000, "x" * 50_000),
])
def test_canonical_text(spark, text, want):
    assert canon.letters_and_digits(text) == want
    assert spark.createDataFrame([(text,)], "s string").select(canon.canonical_text(F.col("s"))).first()[0] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=1, max_size=30))
def test_both_forms_group_alike(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", canon.canonical_text(F.col("s")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if a.isascii() and b.isascii():
                assert (got[i] == got[j]) == (canon.letters_and_digits(a) == canon.letters_and_digits(b))


SAME = [
    '{"case_id":"t_1","subject":"A b","n":48,"x":null}', "{'subject': 'a-B!', 'N': '48', 'Case Id': 'T 1', 'x': None}", '{ "X" : null , "case-id" : "t\\u20091", "n" : "4 8" , "subject" : "AB" }\n',
    "{case_id: 't_1', subject: \"Ab\", n: 48, x: null,}",
]
OTHER = ['{"case_id":"t_1","subject":"A b","n":48,"x":""}', '{"case_id":"A b","subject":"t_1","n":48,"x":null}', '{"case_id":"t_1","subject":"A b","n":48}', '{"case_id":"t_1","subject":"A b","n":480,"x":null}', "no object", "[1]"]


def test_objects():
    assert len({canon.canonical_object(s) for s in SAME}) == 1
    assert len({canon.canonical_object(s) for s in [SAME[0], *OTHER]}) == len(OTHER) + 1
    assert canon.canonical_object(None) is None
    assert canon.canonical_object('{"a": {"b": [1, "x y"]}}') == canon.canonical_object('{"A": {"B": ["1", "XY"]}}')


def test_numbers_keep_their_spelling():
    same = canon.canonical_object
    assert same('{"a": 1e3, "b": [1.50, {"c": -7}]}') == same("{'b': [1.50, {'c': -7}], 'a': 1e3}")
    assert same("{'a': 1e3}") != same("{'a': 1000.0}") and same("{'a': True, 'b': None}") == same('{"b": null, "a": true}')


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["The same!", "the SAME", "T h e same"]) if i % 3 == 0 else f"{rng.choice(['Item', 'ITEM ', 'item-'])} {rng.randrange(400)}" if i % 3 == 1 else rng.choice([None, "", "...", "​"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, s string").withColumn("h", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in canon.repeated_records(df.repartition(5), "id", "s").collect())
    assert got == brute([r for r in rows if r[1]], canon.letters_and_digits)
    groups, members = canon.copy_groups(df, "id", "s")
    assert groups.agg(F.sum("n")).first()[0] == members.count() == sum(bool(r[1] and canon.letters_and_digits(r[1])) for r in rows)


def test_collisions_are_told_apart(spark, monkeypatch):
    real = canon.fingerprints

    def weak(rows, key, field, shape="text"):
        return real(rows, key, field, shape).withColumn("h", F.unhex(F.lit("00")))

    monkeypatch.setattr(canon, "fingerprints", weak)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A!"), (4, "b")], "id bigint, s string")
    assert sorted(tuple(r) for r in canon.repeated_records(df, "id", "s").collect()) == [(1, 3), (2, 4)]


def test_empty(spark):
    assert canon.repeated_records(spark.createDataFrame([], "id bigint, s string"), "id", "s").count() == 0
    assert canon.repeated_records(spark.createDataFrame([(None, "a"), (1, None)], "id bigint, s string"), "id", "s").count() == 0


def test_unicode_data_is_usable():
    assert unicodedata.normalize("NFC", "é") == "é"
