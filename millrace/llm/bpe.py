"""Encoding with a public byte-level BPE vocabulary: pre-tokens found by a scan of transition functions, then cached merges."""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")

# The input symbols of the scanner: what a code point is, with as much of its surroundings as the rules look ahead.
END, LETTER, NUMBER, OTHER, WHITE, LAST_WHITE, LAST_SPACE, APOSTROPHE2, APOSTROPHE3 = range(9)
# Its states: the kind of the pre-token that the code point before belongs to. OPEN: a space that waits for what
# it's joined to; LEFT2, LEFT1: a contraction that takes two code points more, or one; DONE: the next starts anew.
S_DONE, S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_OPEN, S_LEFT2, S_LEFT1 = range(8)

#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Most characters scanned at once; bounds a task's memory, not a text's length.
CHARS_AT_ONCE = 4_000_000
CACHE_ENTRIES = 400_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    category = unicodedata.category
    table = np.full(0x110000, OTHER, np.uint8)
    for start in range(0, 0x110000, 0x10000):
        initials = [category(chr(c))[0] for c in range(start, start + 0x10000)]
        part = np.array(initials)
        table[start : start + 0x10000][part == "L"] = LETTER
        table[start : start + 0x10000][part == "N"] = NUMBER
    table[list(WHITE_SPACE)] = WHITE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token starts at this code point)."""
    if symbol == END:
        return S_DONE, True
    if state == S_LEFT2:
        return S_LEFT1, False
    if state == S_LEFT1:
        return S_DONE, False
    if symbol in (APOSTROPHE2, APOSTROPHE3) and state not in (S_OPEN, S_OTHER):
        return (S_LEFT1 if symbol == APOSTROPHE2 else S_LEFT2), True
    if symbol in (APOSTROPHE2, APOSTROPHE3, OTHER):
        return S_OTHER, state not in (S_OTHER, S_OPEN)
    if symbol == LETTER:
        return S_LETTER, state not in (S_LETTER, S_OPEN)
    if symbol == NUMBER:
        return S_NUMBER, state not in (S_NUMBER, S_OPEN)
    if symbol == WHITE:
        return S_WHITE, state != S_WHITE
    return (S_OPEN if symbol == LAST_SPACE else S_DONE), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions from state to state that texts can induce, closed under composition.

    (of_symbol: function of one symbol; compose[f, g]: f then g; apply[f, state]; starts[state, symbol]).
    Composition is associative, so a text can be cut anywhere and its parts scanned side by side.
    """
    generators = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    for g in generators:
        known.setdefault(g, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return (
        np.array([known[g] for g in generators], np.uint16), compose, np.array(functions, np.uint8),
        np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)], bool),
    )


def _prefix(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan: the composition of all functions up to each place. Blocks are scanned side by side."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    width = max(8, int(n**0.5))
    blocks = -(-n // width)
    grid = np.zeros((blocks, width), functions.dtype)  # function 0 is the identity
    grid.ravel()[:n] = functions
    columns = np.ascontiguousarray(grid.T)
    for i in range(1, width):
        columns[i] = compose[columns[i - 1], columns[i]]
    carried = _prefix(columns[-1].copy(), compose)
    columns[:, 1:] = compose[carried[:-1][None, :], columns[:, 1:]]
    return np.ascontiguousarray(columns.T).ravel()[:n]


def pretoken_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for texts laid end to end, each followed by one separator at `ends`.

    The separator itself counts as a start. No pattern is matched: code points become classes by a table lookup,
    classes with one or two code points of look-ahead become symbols, and a scan gives the state before each.
    """
    symbols = classes()[codes]
    symbols[ends] = END
    white = symbols == WHITE
    following = np.append(symbols[1:], END)
    last = white & (following != WHITE) & (following != END)
    symbols[last] = LAST_WHITE
    symbols[last & (codes == 0x20)] = LAST_SPACE
    quotes = np.flatnonzero((codes == 0x27) & (symbols == OTHER))
    if len(quotes):
        padded = np.append(codes, [0, 0]).astype(np.uint32)
        a, b = padded[quotes + 1], padded[quotes + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        ended = np.zeros(len(codes) + 2, bool)
        ended[ends] = True
        two &= ~ended[quotes + 1]
        three &= ~(ended[quotes + 1] | ended[quotes + 2])
        symbols[quotes[two]] = APOSTROPHE2
        symbols[quotes[three]] = APOSTROPHE3
    of_symbol, compose, apply, starts = monoid()
    after = apply[_prefix(of_symbol[symbols], compose), S_DONE]
    before = np.append(np.uint8(S_DONE), after[:-1])
    return starts[before, symbols]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return _ranks(f.read())


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PairMerger(dict):
    """Pre-token (text) -> its ids; merged once, then kept. Emptied when it holds CACHE_ENTRIES."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else self.merged(raw)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(raw) <= 256:
            self[text] = ids
        return ids

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left; O(n log n)."""
        ranks, n = self.ranks, len(raw)
        ends = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            r, i, end = heapq.heappop(queue)
            if not alive[i] or ends[i] >= end:
                continue
            j = ends[i]
            if j >= n or not alive[j] or ends[j] != end:
                continue
            ends[i], alive[j] = end, False
            if end < n:
                left[end] = i
                r = ranks.get(raw[i : ends[end]])
                if r is not None:
                    heapq.heappush(queue, (r, i, ends[end]))
            k = left[i]
            if k >= 0:
                r = ranks.get(raw[k:end])
                if r is not None:
                    heapq.heappush(queue, (r, k, end))
        return tuple(ranks[raw[i : ends[i]]] for i in range(n) if alive[i])


def encode_batch(texts: Sequence[str | None], merger: PairMerger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each text, start of each pre-token in its text, number of pre-tokens of each text)."""
    filled = [t or "" for t in texts]
    joined = "\x00".join(filled) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    starts = np.flatnonzero(pretoken_starts(codes, ends))
    owner = np.searchsorted(ends, starts, side="left")
    real = starts != ends[owner]
    stops = np.append(starts[1:], len(codes))[real]  # a text's last pre-token stops at its separator
    starts, owner = starts[real], owner[real]
    pieces = [merger[joined[a:b]] for a, b in zip(starts.tolist(), stops.tolist())]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum()))
    per_text = np.bincount(owner, weights=sizes, minlength=len(filled)).astype(np.int64)
    return ids, per_text, starts - begins[owner], np.bincount(owner, minlength=len(filled)).astype(np.int64)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold at most CHARS_AT_ONCE characters, or one longer text by itself."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > CHARS_AT_ONCE:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def merger_of(data: bytes) -> PairMerger:
    """The merger of a vocabulary file's content, kept by the process with its cache of pre-tokens."""
    return PairMerger(_ranks(data))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int32()))


def encode(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, offsets: bool = False
) -> DataFrame:
    """key, ids[, starts] of every row; ids of an empty or null text are an empty list.

    White space alone is text and has ids. No special token is ever given: their strings are ordinary text.
    starts has the place in the text (in code points) where each pre-token starts; between two starts lies what was
    merged together. Rows keep their partition: nothing is shuffled. Rows with a null key are encoded like others.
    The vocabulary file is read by the driver and sent to the tasks; no executor needs the folder.
    """
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary, under a megabyte
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                ids, counts, starts, pieces = encode_batch(texts[a:b], merger)
                columns = [batch.column(0).slice(a, b - a), _lists(ids, counts)]
                yield pa.RecordBatch.from_arrays(columns + ([_lists(starts, pieces)] if offsets else []), names=names)

    names = [key, "ids", *(["starts"] if offsets else [])]
    ddl = f"`{key}` {kind}, ids array<int>" + (", starts array<int>" if offsets else "")
    return documents.select(f"`{key}`", f"`{text}`").mapInArrow(run, ddl)


def decode(ids: Sequence[int], vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text that `ids` came from."""
    back = _inverse(f"{folder}/{vocabulary}.tiktoken")
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _inverse(path: str) -> dict[int, bytes]:
    return {i: b for b, i in load_ranks(path).items()}
