"""Passages of held-out items inside a corpus: a stored positional inverted index, offset-adjusted intersection, exact check."""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir

#: Words of the items searched for at once, about (one longer item is in a block by itself). What is broadcast or
#: collected depends on the items of one block alone, never on the corpus.
WORDS_AT_ONCE = 500_000
#: Words of one part of the index (a longer document is a part by itself).
PART_WORDS = 1 << 17
#: Postings that are intersected at once; bounds a task's memory.
POSTINGS_AT_ONCE = 50_000

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœæ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyoa"
_MARKUP = r"<[/!?a-z][^<>]*>|&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);|\]\([^()\s]+\)"


def words(text: Column) -> Column:
    """The words of a text: lower case, without accents, markup, punctuation and white space, in their order.

    A word is what stands between white space, reduced to its letters and digits; tags and character references
    count as white space. null gives null, a text without words an empty array.
    """
    lower = F.lower(text)
    marked = F.regexp_replace(lower, _MARKUP, " ")
    plain = F.when(lower.contains("<") | lower.contains("&") | lower.contains("]("), marked).otherwise(lower)
    packed = F.regexp_replace(F.translate(plain, _ACCENTED, _PLAIN), r"[^\p{L}\p{N}\s\p{Z}]+", "")
    return F.filter(F.split(packed, r"[\s\p{Z}]+"), lambda w: w != "")


_TABLE = str.maketrans(_ACCENTED, _PLAIN)
_KEPT = re.compile(r"[^\W_]+")
_SEEN: dict[str, int] = {}
_NONE = -1


def _word_hash(token: str) -> int:
    """63-bit hash of a token's letters and digits, -1 if it has none. The cache only saves time."""
    import xxhash

    got = _SEEN.get(token)
    if got is None:
        if len(_SEEN) > 300_000:
            _SEEN.clear()
        core = "".join(_KEPT.findall(token.translate(_TABLE)))
        got = _SEEN[token] = xxhash.xxh3_64_intdigest(core) >> 1 if core else _NONE
    return got


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, one after the other; number of words of each text), as `words` has them.

    A null text has no words. Each different token is looked at once.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    marked = pc.or_(pc.or_(pc.match_substring(lower, "<"), pc.match_substring(lower, "&")), pc.match_substring(lower, "]("))
    if pc.any(marked).as_py():
        lower = pc.if_else(marked, pc.replace_substring_regex(lower, _MARKUP, " "), lower)
    split = pc.utf8_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    kinds = np.fromiter(map(_word_hash, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    hashes = kinds[coded.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.zeros(0, np.int64)
    kept = hashes != _NONE
    ends = np.append(0, np.cumsum(kept))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    after = np.cumsum(lengths)
    return hashes[kept], ends[after] - ends[after - lengths]


def longest_passage(item: list[int] | np.ndarray, found: list[int] | np.ndarray, per: int, least: int = 1) -> tuple[int, int, int, int]:
    """(item words, first item word, first and last place in `found`) of the longest passage of `item` in `found`.

    A passage is a stretch of an alignment in which at most one word in `per` is altered, dropped or added.
    At least `least` of its words are unaltered. The alignment is local: a match earns 1, an edit costs 2.
    (0, 0, 0, 0) if there is no such passage.
    """
    a, b = np.asarray(item, np.int64), np.asarray(found, np.int64)
    n, m = len(a), len(b)
    if not n or not m:
        return 0, 0, 0, 0
    score = np.zeros((n + 1, m + 1), np.int32)
    ramp = 2 * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        diagonal = score[i - 1, :-1] + np.where(b == a[i - 1], 1, -2)
        row = np.maximum(score[i - 1] - 2, 0)
        np.maximum(row[1:], diagonal, out=row[1:])
        score[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    steps: list[tuple[int, int, int]] = []  # (is a match, is an item word, is a found word)
    at: list[tuple[int, int]] = []
    while score[i, j] > 0:
        s = score[i, j]
        if i and j and s == score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2):
            steps.append((int(a[i - 1] == b[j - 1]), 1, 1))
            i, j = i - 1, j - 1
        elif i and s == score[i - 1, j] - 2:
            steps.append((0, 1, 0))
            i -= 1
        else:
            steps.append((0, 0, 1))
            j -= 1
        at.append((i, j))
    if not steps:
        return 0, 0, 0, 0
    steps.reverse()
    at.reverse()
    hits = np.array([x[0] for x in steps])
    weight = np.append(0, np.cumsum(np.where(hits == 1, 1, 1 - per)))
    covered = np.append(0, np.cumsum([x[1] for x in steps]))
    same = np.append(0, np.cumsum(hits))
    ok = (weight[None, :] >= weight[:, None]) & (same[None, :] - same[:, None] >= least) & (np.arange(len(weight))[None, :] > np.arange(len(weight))[:, None])
    length = np.where(ok, covered[None, :] - covered[:, None], 0)
    s, e = np.unravel_index(int(length.argmax()), length.shape)
    return int(length[s, e]), int(at[s][0]), int(at[s][1]), int(at[e - 1][1])


def offsets_that_may_hold(item: np.ndarray, found: np.ndarray, low: int, high: int, span: int, edits: int, reach: int | None = None) -> list[tuple[int, int]]:
    """Ranges of offsets at which some `span` words of the item have all but `edits` of them in `found`.

    A word counts if it's at an offset of the range's neighbourhood, up to `reach` (`edits` if that's None) beyond.
    Looks from `low` to `high`. Never empty where `longest_passage` finds a passage there.
    """
    reach = edits if reach is None else reach
    low, high = low - reach, high + reach
    n, wide = len(item), high - low + 1
    padded = np.full(n + wide, -2, np.int32)
    a, b = max(0, low), min(len(found), low + n + wide)
    if b <= a:
        return []
    padded[a - low : b - low] = found[a:b]
    met = np.lib.stride_tricks.sliding_window_view(padded, wide)[:n] == item[:, None]
    near = met.copy()
    for k in range(1, reach + 1):
        near[:, k:] |= met[:, :-k]
    total = np.zeros((n + 1, wide), np.int16)
    np.cumsum(near, axis=0, dtype=np.int16, out=total[1:])
    span = min(span, n)
    good = np.flatnonzero((total[span:] - total[:-span]).max(axis=0) >= span - edits)
    if not len(good):
        return []
    groups = np.split(good, np.flatnonzero(np.diff(good) > 2 * reach + 1) + 1)
    return [(low + int(g[0]) - reach, low + int(g[-1])) for g in groups]


def _merged(ranges: list[tuple[int, int]], gap: int) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def unaltered_run(least: int, per: int) -> int:
    """The number of words in sequence that every passage has unaltered.

    A passage with e changes has at least `least` and e * (per - 1) unaltered words, in e + 1 runs at most.
    """
    if per < 3:
        raise ValueError("at most every third word may be altered")
    return min(math.ceil(max(least, e * (per - 1)) / (e + 1)) for e in range(least + per))


def build_index(documents: DataFrame, doc: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The positional inverted index of a corpus, written to `path` (the shared checkpoint folder if None) and read again.

    A row is a part of the corpus: docs, bounds (where each document begins among the part's places; one place is left
    free after each), terms (hashes of the part's words, ascending), starts and places (of each term, ascending).
    Documents without a key have no postings; a null text has no words. Later blocks of items and later sets of items
    need the index only, not the corpus: `leaked_passages` takes either.
    """
    kind = documents.schema[doc].dataType.simpleString()

    def part(keys: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bounds = np.append(0, np.cumsum(counts + 1))
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
        terms, code = np.unique(hashes, return_inverse=True)
        order = np.argsort(code, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms))))
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, t))
        return pa.RecordBatch.from_arrays(
            [one(keys, None), one(bounds, pa.int32()), one(terms, pa.int64()), one(starts, pa.int32()), one(at[order], pa.int32())], names=["docs", "bounds", "terms", "starts", "places"]
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = word_hashes(batch.column(1))
            after = np.cumsum(counts)
            first = 0
            while first < len(counts):  # whole documents, as many as a part takes
                base = int(after[first - 1]) if first else 0
                end = max(first + 1, int(np.searchsorted(after, base + PART_WORDS, "right")))
                yield part(batch.column(0).slice(first, end - first), hashes[base : int(after[end - 1])], counts[first:end])
                first = end

    rows = documents.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).filter("d IS NOT NULL")
    path = path or f"{ensure_checkpoint_dir(documents.sparkSession)}/millrace-index-{uuid.uuid4().hex}"
    rows.mapInArrow(build, f"docs array<{kind}>, bounds array<int>, terms array<bigint>, starts array<int>, places array<int>").write.parquet(path)
    return documents.sparkSession.read.parquet(path)


class Asked:
    """The items of one block, coded by their own vocabulary, and their search in parts of the index."""

    def __init__(self, items: list[tuple[object, np.ndarray]], least: int, per: int):
        self.least, self.per, self.run = least, per, unaltered_run(least, per)
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.int64)
        self.coded = [np.searchsorted(self.vocabulary, h).astype(np.int32) for _, h in items]
        # all items in one array with room between them, so that comparing beyond an end never meets a word
        room = np.full(self.run, -2, np.int32)
        self.flat = np.concatenate([room, *[x for c in self.coded for x in (c, room)]])
        self.first = np.array([self.run + sum(len(c) + self.run for c in self.coded[:k]) for k in range(len(items))], np.int64) if len(items) < 2 else np.append(self.run, self.run + np.cumsum([len(c) + self.run for c in self.coded])[:-1])
        self.place = np.concatenate([np.arange(len(c) - 1) for c in self.coded]) if items else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(items)), [len(c) - 1 for c in self.coded]) if items else np.zeros(0, np.int64)
        codes = np.concatenate([self._pairs(c) for c in self.coded]) if items else np.zeros(0, np.int64)
        self.pairs, self.pair = np.unique(codes, return_inverse=True)

    def _pairs(self, coded: np.ndarray) -> np.ndarray:
        return coded[:-1].astype(np.int64) * len(self.vocabulary) + coded[1:]

    def place_seeds(self, frequency: np.ndarray) -> None:
        """Seeds: in every run of an item that a passage may have unaltered, the pair that fewest documents hold.

        A run with a pair that no document holds is in no document.
        """
        chosen = []
        width = self.run - 1
        at = 0
        for c in self.coded:
            n = frequency[self.pair[at : at + len(c) - 1]]
            if len(n) >= width:
                windows = np.lib.stride_tricks.sliding_window_view(n, width)
                best = np.arange(len(windows)) + windows.argmin(axis=1)
                chosen.append(at + np.unique(best[windows.min(axis=1) > 0]))
            at += len(c) - 1
        chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        order = chosen[np.argsort(self.pair[chosen], kind="stable")]
        self.seed, count = np.unique(self.pair[order], return_counts=True)
        self.count, self.start, self.entry = count, np.append(0, np.cumsum(count))[:-1], order

    def read(self, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the part's places coded by the items' vocabulary, -1 for other words; places of the items' pairs; which)."""
        terms, starts, places = part["terms"], part["starts"], part["places"]
        seq = np.full(int(part["bounds"][-1]) + 1, -1, np.int32)
        if not len(self.vocabulary) or not len(terms):
            return seq, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        here = np.flatnonzero(terms[at] == self.vocabulary)
        low, n = starts[at[here]].astype(np.int64), (starts[at[here] + 1] - starts[at[here]]).astype(np.int64)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        seq[places[posting]] = np.repeat(here, n)
        both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
        codes = seq[both].astype(np.int64) * len(self.vocabulary) + seq[both + 1]
        which = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[which] == codes
        return seq, both[hit], which[hit]

    def frequencies(self, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how many of the part's documents hold them)."""
        _, at, which = self.read(part)
        doc = np.searchsorted(part["bounds"], at, "right") - 1
        return np.unique(np.unique(which.astype(np.int64) * len(part["bounds"]) + doc) // len(part["bounds"]), return_counts=True)

    def candidates(self, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the part's coded places; rows of document, item, offset wherever an item's run lies unaltered and may be in a passage)."""
        seq, at, which = self.read(part)
        if not len(self.seed) or not len(at):
            return seq, np.zeros((0, 3), np.int64)
        k = np.minimum(np.searchsorted(self.seed, which), len(self.seed) - 1)
        hit = self.seed[k] == which
        at, k = at[hit], k[hit]
        width = self.run - 1
        padded = np.concatenate([np.full(width, -1, np.int32), seq, np.full(width + 1, -1, np.int32)])
        steps = np.arange(-width + 1, width + 1)
        out = []
        first = 0
        load = np.cumsum(self.count[k])
        while first < len(at):
            end = max(first + 1, int(np.searchsorted(load, (load[first - 1] if first else 0) + POSTINGS_AT_ONCE, "right")))
            n = self.count[k[first:end]]
            row = np.repeat(np.arange(first, end), n)
            e = self.entry[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[k[first:end]], n)]
            item, q = self.owner[e], self.place[e]
            same = padded[at[row, None] + width + steps] == self.flat[(self.first[item] + q)[:, None] + steps]
            whole = np.lib.stride_tricks.sliding_window_view(same, self.run, axis=1).all(axis=2).any(axis=1)
            doc = np.searchsorted(part["bounds"], at[row[whole]], "right") - 1
            places, item, q = at[row[whole]], item[whole], q[whole]
            kept = self.may_hold(seq, places, item, q)
            out.append(np.column_stack([doc, item, places - part["bounds"][doc] - q])[kept])
            first = end
        return seq, np.unique(np.concatenate(out), axis=0)

    def may_hold(self, seq: np.ndarray, at: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a passage may run through the item's pair at `q`, found at the part's place `at`, for many of them.

        If there's a passage there's one of less than twice `least` unaltered words (of a longer one's two halves one is a
        passage), so with few changes; its words lie within as many places of the run's offset. Going from the run to both
        sides, the words that lie there must outweigh those that don't.
        """
        most = 2 * self.least - 1
        reach = most // (self.per - 1)
        wide = most + reach
        room = wide + reach + 2
        padded = np.concatenate([np.full(room, -1, np.int32), seq, np.full(room, -1, np.int32)])
        lengths = np.array([len(c) for c in self.coded], np.int64)[item]
        out = np.ones(len(at), bool)
        counts = []
        for step in (-1, 1):  # from the pair's first word to the left, from its second to the right
            move = np.arange(wide) * step + (step > 0)
            places = q[:, None] + move
            inside = (places >= 0) & (places < lengths[:, None])
            word = np.where(inside, self.flat[np.clip(self.first[item][:, None] + places, 0, len(self.flat) - 1)], -2)
            near = np.zeros(word.shape, bool)
            base = at[:, None] + move + room
            for k in range(-reach, reach + 1):
                near |= padded[base + k] == word
            # beyond the item's end nothing can be had, whatever the changes
            missed = np.cumsum(~near, axis=1, dtype=np.int16) + np.where(inside, 0, most).astype(np.int16)
            counts.append([(near & (missed <= a)).sum(axis=1) for a in range(reach + 1)])
        out = np.zeros(len(at), bool)
        for a in range(reach + 1):
            for b in range(reach + 1 - a):
                out |= counts[0][a] + counts[1][b] >= max(self.least, (a + b) * (self.per - 1))
        return out

    def search(self, part: dict[str, np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, words, first item word, first and last word of the document) of each pair's longest passage."""
        seq, found = self.candidates(part)
        best: dict[tuple[int, int], tuple] = {}
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, i, o in found.tolist():
            near[d, i].append(o)
        for (d, i), offsets in near.items():
            v = self.coded[i]
            text = seq[part["bounds"][d] : part["bounds"][d + 1] - 1]
            reach = len(v) // (self.per - 1)  # no passage of the item has more changes
            for low, high in _merged([(o, o) for o in offsets], 2 * reach + 2):
                for a, b in offsets_that_may_hold(v, text, low, high, len(v), len(v) - self.least, reach):
                    a, b = max(0, a - reach), min(len(text), b + len(v) + reach)
                    length, q, first, last = longest_passage(v, text[a:b], self.per, self.least)
                    if length >= self.least and length > best.get((d, i), (0,))[0]:
                        best[d, i] = (length, q, first + a, last + a)
        return [(d, i, *x) for (d, i), x in best.items()]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    """(keys of the documents, arrays) of each part in a batch."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    for r in range(batch.num_rows):
        yield columns["docs"][r].values, {n: columns[n][r].values.to_numpy(zero_copy_only=False) for n in ("bounds", "terms", "starts", "places")}


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 20, per: int = 8
) -> DataFrame:
    """doc_id, item_id, n_words, item_word, first_word, last_word: each document that repeats a passage of an item.

    A passage is a stretch of an item of which the document has `least` or more words in sequence; of the stretch's
    words at most one in `per` is altered, dropped or added (with `per` above `least`: none in any `least` words). One row per document and item, for its longest passage;
    item_word, first_word and last_word number the words of the item and of the document from 0. Rows whose key or
    text is null, and texts without words, are in no result. Repeated documents are reported each. An item with
    fewer than `least` words is in no result. Words are compared by a 63-bit hash.

    `documents` is a corpus or its stored index (see `build_index`); of a corpus the index is built and stored first.
    Every passage has `unaltered_run` (6) or more words in sequence unaltered, so no passage is missed by looking for these:
    of every such run of an item the pair of neighbouring words that fewest documents hold, counted over the whole
    corpus, is looked up, and the postings of the run's other words are intersected with it by offset. Where all meet,
    the document is a candidate: a bound on how many of the item's words may lie near that offset drops most of them and
    the others are aligned, all from the postings and inside the task that reads them; nothing but result rows leaves it.
    """
    stored = {"docs", "bounds", "terms", "starts", "places"} <= set(documents.columns)
    index = documents if stored else build_index(documents, doc, text)
    item_kind = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("i IS NOT NULL").mapInArrow(_hashed_items, f"i {item_kind}, h array<bigint>")
    asked = asked.filter(F.size("h") >= least)
    total = asked.agg(F.sum(F.size("h"))).first()[0] or 0
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(max(1, math.ceil(2 * total / WORDS_AT_ONCE)))))
    result = None
    for block in [r[0] for r in blocks.select("block").distinct().orderBy("block").collect()] or [0]:
        rows = blocks.filter(F.col("block") == block).select("i", "h").collect()
        one = _leaks_of(index, Asked([(r["i"], np.array(r["h"], np.int64)) for r in rows], least, per), item_kind)
        result = one if result is None else result.unionByName(one)
    return result


def _hashed_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, counts = word_hashes(batch.column(1))
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(hashes, pa.int64()))], names=["i", "h"])


def _leaks_of(index: DataFrame, asked: Asked, item_kind: str) -> DataFrame:
    sc = index.sparkSession.sparkContext
    kind = index.schema["docs"].dataType.elementType.simpleString()
    shared = sc.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch):
                pairs, n = shared.value.frequencies(part)
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    frequency = np.zeros(len(asked.pairs), np.int64)
    for pair, n in index.select("docs", "bounds", "terms", "starts", "places").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect():
        frequency[pair] = n  # at most one row per pair of the items
    asked.place_seeds(frequency)
    seeded = sc.broadcast(asked)
    out_schema = f"doc_id {kind}, item_id {item_kind}, n_words int, item_word int, first_word int, last_word int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, part in _parts(batch):
                rows = seeded.value.search(part)
                ids = pa.array([seeded.value.ids[r[1]] for r in rows], item_type)
                numbers = [pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows], pa.int64())), ids, *numbers], names=["doc_id", "item_id", "n_words", "item_word", "first_word", "last_word"])

    item_type = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(item_kind, pa.int64())
    return index.select("docs", "bounds", "terms", "starts", "places").mapInArrow(search, out_schema)
