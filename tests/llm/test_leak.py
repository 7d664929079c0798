"""Leaked passages: planted ones are found, others aren't, whatever the formatting."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import leak
from pyspark.sql import functions as F

ITEM = "Question: " + " ".join(f"term{i} of case{i}" for i in range(20)) + ". Which step comes next?"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")


def found(spark, texts, items=((7, ITEM),), **kw):
    its = spark.createDataFrame(list(items), "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in leak.leaked_passages(docs(spark, texts), its, **kw).collect())


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def altered(rng, words):
    """One word in ten altered, dropped or added."""
    out = []
    for i, w in enumerate(words):
        if i % 10 == 5:
            out += rng.choice([["changed"], [], [w, "added"]])
        else:
            out.append(w)
    return out


def test_planted_passages(spark):
    rng = random.Random(1)
    ws = ITEM.split()
    texts = [
        f"{filler(rng, 50)} {ITEM} {filler(rng, 40)}",
        f"{filler(rng, 500)}\n{' '.join(ws[10:34]).upper()}",
        " ".join(f"<b>{w}</b>" if i % 3 == 0 else f"_{w}_," for i, w in enumerate(ws[5:40])),
        "\n   ".join(ws[2:50]),
        f"{filler(rng, 10)} {' '.join(altered(rng, ws[0:45]))} {filler(rng, 9)}",
        " ".join(ws[0:15]),  # too short
        f"{' '.join(ws[0:12])} {filler(rng, 12)} {' '.join(ws[30:42])}",  # two short ones
        " ".join(w if i % 4 else "zzz" for i, w in enumerate(ws)),  # altered too often
        filler(rng, 300), None, "", "   ", "...", "😀 " * 50, filler(rng, 30_000) + " " + ITEM,
    ]
    assert found(spark, texts) == [(i, 7) for i in (0, 1, 2, 3, 4, 14)]


def test_repeated_words_and_items(spark):
    same = "again " * 60
    assert found(spark, [same, f"{ITEM} {ITEM}", "again"], [(1, same), (2, ITEM), (3, ITEM), (4, "short"), (None, ITEM)]) == [(0, 1), (1, 2), (1, 3)]


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, ["a"], [(1, None)]) == [] and found(spark, [ITEM], [(1, "")]) == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leak, "WORDS_AT_ONCE", 1)
    assert found(spark, [ITEM], [(1, ITEM), (2, ITEM + " more")]) == [(0, 1), (0, 2)]


def test_words(spark):
    get = lambda s: spark.createDataFrame([(s,)], "s string").select(leak.words(F.col("s"))).first()[0]
    assert get("Crème <br/> XU-93480,\n**bold** &amp; é - x") == ["creme", "xu93480", "bold", "e", "x"]
    assert get("") == [] and get(None) is None


def test_hashes_follow_words(spark):
    import pyarrow as pa

    texts = [None, "", "Crème <br/> XU-93480,\n**bold** &amp; é - x", "a  <b class='x y'>c</b> < d [l](http://x.y/z) 3<4 &#x41; ß Œuvre\u3000終わり\u200b。", "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", leak.words(F.col("s")).alias("w")).orderBy("i").collect()
    hashes, counts = leak.word_hashes(pa.array(texts))
    assert counts.tolist() == [len(r.w or []) for r in rows]
    assert hashes.tolist() == [leak._word_hash(w) for r in rows for w in r.w or []]


def test_long_tags_and_links_are_markup(spark):
    tag, link = f"<a title='{'x y ' * 200}'>", f"[it](http://{'z' * 500})"
    ws = ITEM.split()
    assert found(spark, [" ".join([*ws[:12], tag, *ws[12:24]]), " ".join([*ws[:11], link[:3], "]" + link[4:], *ws[11:22]])]) == [(0, 7), (1, 7)]


def test_runs():
    assert leak.unaltered_run(20, 8) == 6 and leak.unaltered_run(20, 99) == 20 and leak.unaltered_run(6, 8) == 4


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_candidates_lose_no_passage(data):
    """Every document in which the aligner finds a passage of an item is found by way of the index."""
    import numpy as np

    few = data.draw(st.sampled_from([5, 40, 400]))
    items = [data.draw(st.lists(st.integers(0, few), min_size=20, max_size=90)) for _ in range(data.draw(st.integers(1, 3)))]
    texts = []
    for _ in range(4):
        at = data.draw(st.integers(0, len(items) - 1))
        low = data.draw(st.integers(0, 30))
        text = list(items[at][low : low + data.draw(st.integers(15, 80))])
        for place, kind in data.draw(st.lists(st.tuples(st.integers(0, 89), st.sampled_from("adsb")), max_size=8)):
            place %= max(1, len(text))
            text[place : place + 1] = [999, *text[place : place + 1]] if kind == "a" else [] if kind == "d" else [998] * (3 if kind == "b" else 1)
        noise = st.lists(st.integers(0, 500), max_size=20)
        texts.append(data.draw(noise) + text + data.draw(noise))
    asked = leak.Asked([(i, np.array(w, np.int64)) for i, w in enumerate(items)], 20, 8)
    flat, counts = np.array([w for x in texts for w in x], np.int64), np.array([len(x) for x in texts])
    bounds = np.append(0, np.cumsum(counts + 1))
    at = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), counts)
    terms, code = np.unique(flat, return_inverse=True)
    part = {"bounds": bounds, "terms": terms, "starts": np.append(0, np.cumsum(np.bincount(code))), "places": at[np.argsort(code, kind="stable")]}
    pairs, n = asked.frequencies(part)
    frequency = np.zeros(len(asked.pairs), np.int64)
    frequency[pairs] = n
    asked.place_seeds(frequency)
    got = {(d, i) for d, i, *_ in asked.search(part)}
    want = {(d, i) for d, x in enumerate(texts) for i, v in enumerate(items) if leak.longest_passage(v, x, 8, 20)[0] >= 20}
    assert want <= got


def test_the_stored_index_serves_later_items(spark, tmp_path):
    rng = random.Random(2)
    other = " ".join(f"word{i} part{i}" for i in range(30))
    index = leak.build_index(docs(spark, [f"{filler(rng, 30)} {ITEM}", None, "", f"{other} {filler(rng, 3)}", ITEM]), path=str(tmp_path / "index"))
    ask = lambda i, t: sorted((r.doc_id, r.item_id) for r in leak.leaked_passages(index, spark.createDataFrame([(i, t)], "item_id bigint, text string")).collect())
    assert ask(1, ITEM) == [(0, 1), (4, 1)] and ask(2, other) == [(3, 2)] and ask(3, "something else") == []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_bound_never_drops_a_passage(data):
    """What the aligner takes for a passage passes the bound at some offset near it."""
    item = data.draw(st.lists(st.integers(0, 30), min_size=20, max_size=50))
    edits = data.draw(st.lists(st.tuples(st.integers(0, 49), st.sampled_from("ads")), max_size=3))
    text = list(item)
    for at, kind in edits:
        at = at % max(1, len(text))
        text[at : at + 1] = [99, text[at]] if kind == "a" else [] if kind == "d" else [98]
    import numpy as np

    length, *_ = leak.longest_passage(item, text, 8, 20)
    if length:
        assert leak.offsets_that_may_hold(np.array(item), np.array(text), -4, 4, 18, 3)
