"""Free-entered values mapped to a reference list: a BK-tree under a true edit metric."""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.skew import hot_split_join
from millrace.session import cut

#: Reference entries in one shard, about; a shard's tree is built once, by one task.
SHARD_ENTRIES = 2000
#: Bytes of trees that are broadcast at once (one larger shard is a broadcast by itself), so it never grows with the list.
TREES_AT_ONCE = 64 << 20

#: Letters of other alphabets, and digits and signs, that are typed for the Latin letter they resemble.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x",
}
DIGIT_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Words that people put round a value and that are part of no entry.
FILLERS = frozenset("a an and asap for from in my new of on or pls please re t the thx to urgent web".split())


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance in its unrestricted form, a true metric; most + 1 if it's more than `most`.

    Insertions, deletions, substitutions and transpositions cost one; text between transposed letters may be
    edited too, which is what keeps the triangle inequality.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, column = [far, i] + [0] * len(b), 0
        above = rows[-1]
        least = i
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), column
            cost = above[j] + (x != y)
            if x == y:
                column = j
            best = min(cost, row[j] + 1, above[j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
            row[j + 1] = best
            least = min(least, best)
        last[x] = i
        rows.append(row)
        if least > most + 1:
            return most + 1
    return min(rows[-1][-1], most + 1)


def distances(a: str, texts: Sequence[str]) -> np.ndarray:
    """`distance` of one text to each of many, without a limit; the table of all of them is filled cell by cell at once."""
    out = np.empty(len(texts), np.int32)
    if not a:
        return np.fromiter(map(len, texts), np.int32, len(texts))
    longest = max(map(len, texts), default=0)
    at_once = max(1, 8_000_000 // ((len(a) + 2) * (longest + 2)))
    alphabet = {c: i for i, c in enumerate(dict.fromkeys(a))}  # letters that `a` lacks are all alike
    for first in range(0, len(texts), at_once):
        part = texts[first : first + at_once]
        n = len(part)
        lengths = np.fromiter(map(len, part), np.int64, n)
        wide = int(lengths.max(initial=0))
        codes = np.full((n, wide), len(alphabet), np.int32)
        for r, t in enumerate(part):
            codes[r, : len(t)] = [alphabet.get(c, len(alphabet)) for c in t]
        columns = np.ascontiguousarray(codes.T)
        far = (len(a) + lengths).astype(np.int32)
        h = np.empty((len(a) + 2, wide + 2, n), np.int32)
        h[0], h[:, 0] = far, far
        h[1, 1:] = np.arange(wide + 1)[:, None]
        h[1:, 1] = np.arange(len(a) + 1)[:, None]
        last = np.zeros(len(alphabet) + 1, np.int64)  # the last row with each letter
        every = np.arange(n)
        for i, x in enumerate(a, 1):
            mine, seen = alphabet[x], np.zeros(n, np.int64)
            for j in range(1, wide + 1):
                y = columns[j - 1]
                k, m = last[y], seen
                same = y == mine
                best = np.minimum(h[i, j] + ~same, np.minimum(h[i + 1, j], h[i, j + 1]) + 1)
                h[i + 1, j + 1] = np.minimum(best, h[k, m, every] + (i - k - 1) + 1 + (j - m - 1))
                seen = np.where(same, j, seen)
            last[mine] = i
        out[first : first + n] = h[len(a) + 1, lengths + 1, every]
    return out


class BKTree:
    """All (text, payload) within a distance; branches are pruned by the triangle inequality.

    Built node by node from the root: the distances of a node's text to all texts below it are taken at once.
    """

    def __init__(self, items: Sequence[tuple[str, object]]):
        payloads: dict[str, list] = defaultdict(list)
        for text, payload in items:
            payloads[text].append(payload)
        self.payloads = dict(payloads)
        texts = list(payloads)
        self.root: tuple[str, dict] | None = (texts[0], {}) if texts else None
        todo = [(self.root, texts[1:])] if len(texts) > 1 else []
        while todo:
            node, below = todo.pop()
            ds = distances(node[0], below).tolist() if len(below) > 8 else [distance(node[0], t, 1 << 20) for t in below]
            groups: dict[int, list[str]] = defaultdict(list)
            for d, t in zip(ds, below):
                groups[d].append(t)
            for d, ts in groups.items():
                node[1][d] = (ts[0], {})
                if len(ts) > 1:
                    todo.append((node[1][d], ts[1:]))

    def within(self, text: str, radius: int) -> list[tuple[int, str]]:
        """Every stored text within `radius`, with its distance."""
        if radius == 0 or self.root is None:
            return [(0, text)] if text in self.payloads else []
        out, todo = [], [self.root]
        while todo:
            at, below = todo.pop()
            reach = max(below, default=0) + radius
            d = distance(text, at, reach)
            if d <= radius:
                out.append((d, at))
            todo += [x for e, x in below.items() if d - radius <= e <= d + radius]
        return out


def words(text: str) -> list[str]:
    """Lower-case words without accents and look-alikes; digits stand for letters only inside words with letters."""
    plain = unicodedata.normalize("NFKD", text).casefold()
    plain = "".join(LOOKALIKES.get(c, c) for c in plain if unicodedata.category(c) not in ("Mn", "Cf"))
    out = []
    for w in re.split(r"[^a-z0-9@$]+" if plain.isascii() else r"[^\w@$]+|_+", plain):
        if any(c.isalpha() for c in w):
            w = "".join(DIGIT_LOOKALIKES.get(c, c) for c in w)
        if w:
            out.append(w)
    return out


def _singular(word: str) -> str:
    return word[:-3] + "y" if len(word) > 4 and word.endswith("ies") else word[:-1] if len(word) > 3 and word.endswith("s") else word


def _skeleton(word: str) -> str:
    return word[:1] + re.sub(r"[aeiou]", "", word[1:])


def aliases(entry: str, fillers: frozenset[str] = FILLERS) -> dict[str, float]:
    """The spellings an entry may be cut or turned to, each with how much of the entry it lacks (0 to 1).

    Its words in order, with the last word first and (three words or more) in reverse; each with its end cut off; each word cut; vowels left out.
    """
    ws = [w for w in words(entry) if w not in fillers] or words(entry)
    whole = "".join(ws)
    out: dict[str, float] = {}

    def put(text: str, lacks: float) -> None:
        if len(text) >= 3 and lacks < out.get(text, 9):
            out[text] = lacks

    orders = [ws] if len(ws) == 1 else [ws, [ws[-1], *ws[:-1]]] if len(ws) == 2 else [ws, [ws[-1], *ws[:-1]], ws[::-1]]
    for order in orders:
        text = "".join(order)
        for n in range(max(3, (len(text) + 1) // 2), len(text) + 1):
            put(text[:n], 1 - n / len(text))
        if len(order) == 1:
            put(_skeleton(text), 0.15)
        else:
            put("".join(map(_skeleton, order)), 0.15)
            for k in range(len(order)):
                put("".join(_skeleton(w) if i == k else w for i, w in enumerate(order)), 0.1)
        cuts = [[w[:n] for n in range(min(len(w), 3), len(w) + 1)] for w in order]
        if len(order) == 2:
            for a in cuts[0]:
                for b in cuts[1]:
                    put(a + b, 1 - len(a + b) / len(text))
        elif len(order) > 2:  # all words cut to about the same share
            for share in (0.4, 0.5, 0.6, 0.7, 0.8):
                t = "".join(w[: max(3, round(len(w) * share))] for w in order)
                put(t, 1 - len(t) / len(text))
    put(whole, 0.0)
    return out


@dataclass(frozen=True)
class Rules:
    """What may pass for an entry. The numbers were set by looking at values typed for lists of this kind.

    `radius`: edits allowed up to a length of the longer spelling (beyond the last one: `most`); `cut_and_edited`: a spelling that
    lacks more of the entry than this share must be met without edits; `most_lost`: the largest share of the spelling edited
    plus share of the entry lacking; `fillers`: words that people put round a value and that are part of no entry.
    """

    radius: tuple[tuple[int, int], ...] = ((3, 0), (5, 1), (9, 2))
    most: int = 3
    cut_and_edited: float = 0.45
    most_lost: float = 0.62
    fillers: frozenset[str] = FILLERS

    def radius_for(self, length: int) -> int:
        return next((r for n, r in self.radius if length <= n), self.most)

    def near_filler(self, word: str) -> bool:
        """A filler word, its plural, or (from four letters) one edit away from one."""
        return word in self.fillers or _singular(word) in self.fillers or (len(word) > 3 and any(len(f) > 2 and distance(word, f, 1) <= 1 for f in self.fillers))


class Matcher:
    """The entries of one field (or one shard of them), and the search among them.

    `inner` are the words of the field's entries that would otherwise pass for fillers (of these entries, if not given).
    """

    def __init__(self, entries: Sequence[tuple[int, str]], rules: Rules = Rules(), inner: Iterable[str] | None = None):
        items = [(text, (lacks, cid)) for cid, value in entries for text, lacks in aliases(value, rules.fillers).items()]
        self.tree, self.rules = BKTree(items), rules
        self.inner = frozenset((w for _, v in entries for w in words(v)) if inner is None else inner)

    def _spare(self, word: str) -> bool:
        """A word that goes round a value; never a word of an entry."""
        return word not in self.inner and self.rules.near_filler(word)

    def best(self, value: str) -> tuple[float, int] | None:
        """(cost, canonical_id) of the closest entry, the smallest id among equals; None if none is close."""
        rules = self.rules
        ws = words(value)
        if not any(c.isalpha() for w in ws for c in w):
            return None
        kept = [w for w in ws if not w.isdigit()]
        variants = {"".join(ws): 0.02, "".join(kept): 0.01}
        for rest in ([w for w in kept if w not in rules.fillers], [w for w in kept if len(w) > 2 and not self._spare(w)]):
            if rest:
                variants.setdefault("".join(rest), 0.0)
                variants.setdefault("".join(map(_singular, rest)), 0.05)
        for text in list(variants):  # a plural of the whole
            variants.setdefault(_singular(text), variants[text] + 0.05)
        found: tuple[float, int] | None = None
        for most in range(rules.most + 1):
            for text, extra in variants.items():
                if len(text) < 3:
                    continue
                for d, alias in self.tree.within(text, most):
                    if d > rules.radius_for(max(len(alias), len(text))) or d > len(alias) // 2:
                        continue
                    for lacks, cid in self.tree.payloads[alias]:
                        if d and lacks > rules.cut_and_edited:
                            continue
                        cost = d + lacks + extra
                        if d / max(1, len(alias)) + lacks > rules.most_lost:
                            continue
                        if found is None or (cost, cid) < found:
                            found = (cost, cid)
            if found is not None and found[0] <= most + 1:
                break
        return found


_OPENED: dict[tuple, Matcher] = {}


def _opened(name: str, number: int, tree: bytes) -> Matcher:
    """A tree of the block `name`, unpickled once a process; those of other blocks are given up."""
    if (name, number) not in _OPENED:
        for key in [k for k in _OPENED if k[0] != name]:
            del _OPENED[key]
        _OPENED[name, number] = pickle.loads(tree)  # noqa: S301
    return _OPENED[name, number]


def _search(shared, name: str):
    """mapInPandas over rows (field_name, value): the cheapest entry of all shards of a block, each opened once a process."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_field = defaultdict(list)
        for i, (field, tree) in enumerate(shared.value):
            by_field[field].append(_opened(name, i, tree))
        for part in parts:
            best = [min((g for m in by_field.get(f, ()) if (g := m.best(v)) is not None), default=None) for f, v in zip(part["field_name"], part["value"])]
            yield pd.DataFrame({"field_name": part["field_name"], "value": part["value"], "cost": [g[0] if g else None for g in best], "canonical_id": pd.array([g[1] if g else None for g in best], "Int64")})

    return search


def shard_trees(reference: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """field_name, shard, tree (pickled `Matcher`), size: the trees of all shards, each built once, by a task of its own.

    Entries with nulls are left out. A field's entries are spread over ceil(entries / SHARD_ENTRIES) shards by their ids.
    """
    entries = reference.select(F.col("canonical_id").cast("bigint").alias("canonical_id"), "field_name", "canonical_value").dropna()
    sizes = entries.groupBy("field_name").agg(F.ceil(F.count(F.lit(1)) / SHARD_ENTRIES).cast("int").alias("shards"))

    def filler_like(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = {(f, w) for f, v in zip(part["field_name"], part["canonical_value"]) for w in words(v) if rules.near_filler(w)}
            yield pd.DataFrame(sorted(rows), columns=["field_name", "word"])

    # words within an edit of the few fillers: a bounded set
    inner = entries.select("field_name", "canonical_value").mapInPandas(filler_like, "field_name string, word string").groupBy("field_name").agg(F.collect_set("word").alias("inner"))
    placed = entries.join(sizes, "field_name").withColumn("shard", F.pmod(F.xxhash64("canonical_id"), F.col("shards")).cast("int")).join(inner, "field_name", "left")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        kept = part["inner"].iloc[0]
        entries = sorted(zip(part["canonical_id"].tolist(), part["canonical_value"]))
        tree = pickle.dumps(Matcher(entries, rules, () if kept is None else list(kept)), protocol=5)
        return pd.DataFrame({"field_name": [key[0]], "shard": [key[1]], "tree": [tree], "size": [len(tree)]})

    return placed.select("field_name", "shard", "canonical_id", "canonical_value", "inner").groupBy("field_name", "shard").applyInPandas(build, "field_name string, shard int, tree binary, size bigint")


def map_values(spark: SparkSession, values: DataFrame, reference: DataFrame, tasks: int, rules: Rules = Rules()) -> DataFrame:
    """field_name, value, canonical_id (-1: none) for each distinct row (field_name, value) of `values`.

    `reference` has canonical_id, field_name, canonical_value. Its entries are in shards, each with a tree of its own (see
    `shard_trees`); trees are sent out in blocks of TREES_AT_ONCE bytes. A value's winners of all shards and blocks are
    merged by cost, then by the smaller id.
    """
    trees = cut(shard_trees(reference, rules))
    blocks: list[list[tuple[str, int]]] = []
    room = 0
    for field, shard, size in trees.select("field_name", "shard", "size").orderBy("field_name", "shard").collect():  # a row per shard
        if not blocks or size > room:
            blocks.append([])
            room = TREES_AT_ONCE
        blocks[-1].append((field, shard))
        room -= size
    by_value = values.select("field_name", "value").repartition(tasks)
    found = None
    for block in blocks:
        here = spark.createDataFrame(block, "field_name string, shard int")
        sent = [(r[0], bytes(r[1])) for r in trees.join(F.broadcast(here), ["field_name", "shard"]).select("field_name", "tree").collect()]
        search = _search(spark.sparkContext.broadcast(sent), uuid.uuid4().hex)
        one = by_value.mapInPandas(search, "field_name string, value string, cost double, canonical_id bigint")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return values.select("field_name", "value", F.lit(-1).cast("bigint").alias("canonical_id"))
    if len(blocks) == 1:
        return found.select("field_name", "value", F.coalesce("canonical_id", F.lit(-1).cast("bigint")).alias("canonical_id"))
    best = found.groupBy("field_name", "value").agg(F.min(F.when(F.col("canonical_id").isNotNull(), F.struct("cost", "canonical_id"))).alias("m"))
    return best.select("field_name", "value", F.coalesce("m.canonical_id", F.lit(-1).cast("bigint")).alias("canonical_id"))


def map_to_canonical(spark: SparkSession, rows: DataFrame, key: str, fields: Sequence[str], reference: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """record_index (the key), field_name, value, canonical_id: the entry each free-entered value stands for, or -1.

    One row for each non-null value of `fields` that isn't literally an entry of its field. A field without entries
    in `reference` maps to -1 throughout. Each distinct value is searched once; its result goes back to the rows by
    a join that broadcasts only the values held by a large share of the rows (a bounded number).
    """
    entries = reference.select(F.col("field_name").alias("field_name"), F.col("canonical_value").alias("value")).dropna()
    long = rows.select(
        F.col(f"`{key}`").alias("record_index"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("x")
    ).select("record_index", "x.field_name", "x.value").filter("value IS NOT NULL")
    # literal entries are dropped from the distinct values, so a value that many rows hold meets the list once
    distinct = cut(long.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n")).join(entries, ["field_name", "value"], "left_anti"))
    tasks = max(spark.sparkContext.defaultParallelism, distinct.rdd.getNumPartitions())
    mapped = cut(map_values(spark, distinct.select("field_name", "value"), reference, tasks, rules))
    coded = F.unhex(F.md5(F.concat_ws("\x1f", "field_name", "value")))
    states = distinct.join(mapped, ["field_name", "value"], "left").select(coded.alias("k"), F.coalesce("canonical_id", F.lit(-1).cast("bigint")).alias("canonical_id"), "n")
    return hot_split_join(long.withColumn("k", coded), states, "k", "n").select("record_index", "field_name", "value", "canonical_id")
