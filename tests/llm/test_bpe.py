"""Ids equal to those of the public libraries, boundaries equal to those of the public pattern, exact decoding."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

FILES = Path(bpe.TOKENIZERS)
pytestmark = pytest.mark.skipif(not (FILES / "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary files here")
#: The public pattern (a fixed value), used here to test against, never to encode.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = ["'", "s", "t", "re", "ll", "'ll", "'ve", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "٣", "!", "?", "😀", "'m", "'d", "\x00", "漢", "…", "²", "​", "ſ", "<|endoftext|>"]


def libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (FILES / "byte_bpe_50k.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return libraries(), bpe.PairMerger(bpe.load_ranks(str(FILES / "byte_bpe_50k.tiktoken")))


def ids_of(texts, merger):
    ids, counts, *_ = bpe.encode_batch(texts, merger)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_and_boundaries(known, texts):
    lib, merger = known
    assert ids_of(texts, merger) == [lib.encode_ordinary(t) for t in texts]
    *_, starts, pieces = bpe.encode_batch(texts, merger)
    assert [x.tolist() for x in np.split(starts, np.cumsum(pieces)[:-1])] == [[m.start() for m in regex.finditer(PATTERN, t)] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(known, text):
    lib, merger = known
    assert ids_of([text], merger) == [lib.encode_ordinary(text)]
    assert bpe.decode(ids_of([text], merger)[0]) == text


def test_the_other_library_agrees(known):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(FILES / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello, world! It's 2018.", "Rückgabe  nicht möglich\n\n", "<|endoftext|> stays text", "x" * 3000]
    assert ids_of(texts, known[1]) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_scan_is_associative():
    of_symbol, compose, apply, _ = bpe.monoid()
    rng = random.Random(1)
    symbols = np.array([rng.randrange(9) for _ in range(5000)])
    functions = of_symbol[symbols]
    by_hand, f = [], 0
    for g in functions:
        f = compose[f, g]
        by_hand.append(f)
    assert bpe._prefix(functions, compose).tolist() == by_hand
    a, b, c = (rng.randrange(len(compose)) for _ in range(3))
    assert compose[compose[a, b], c] == compose[a, compose[b, c]]


def test_long_words_and_texts(known):
    lib, merger = known
    texts = ["ab" * 20_000, "word " * 60_000, "é" * 5000]
    assert ids_of(texts, merger) == [lib.encode_ordinary(t) for t in texts]


def test_rows(spark, known):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (4, " ", None), (None, "tie", "t"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df, offsets=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].ids == [] == by[3].ids and by[4].ids == known[0].encode_ordinary(" ") and by[1].starts == [0, 1]
    assert bpe.encode(df.limit(0)).count() == 0
