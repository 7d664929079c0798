"""Records that differ only in formatting: canonical text, 128-bit hash, combined counts, collision checks."""

from __future__ import annotations

import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import hot_split_join
from millrace.session import cut

_NULL, _IS, _NEXT = "\x00", "\x1f", "\x1e"
#: One name and its value in an object that is neither strict JSON nor a Python literal.
_PAIR = re.compile(
    r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s"'{},:=][^"'{},:=]*?))\s*[:=]\s*"""
    r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^,}]*))\s*(?:[,;}]|$)""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def letters_and_digits(text: str) -> str:
    """The letters and digits of a text in their order, composed and without case; all else is dropped."""
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).upper().lower())
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN").replace("ς", "σ")


def canonical_text(text: Column) -> Column:
    """Column form of `letters_and_digits`, in the JVM; only texts with combining marks pass through Python.

    null stays null; a text without letters and digits gives the empty string.
    """

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    marked = F.when(text.rlike(r"\p{M}|[ᄀ-ᇿΩKÅ豈-﫿]"), text)
    whole = F.coalesce(composed(marked), text)
    return F.translate(F.regexp_replace(F.replace(F.lower(F.upper(whole)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", ""), "ς", "σ")


def _unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if len(c) > 1 else _PLAIN.get(c, c)

    return _ESCAPE.sub(one, raw)


def _literal(node: ast.expr, source: str):
    """The value of a Python literal; a number stays as it's written, as it does in JSON (`1e3` isn't turned to `1000.0`)."""
    if isinstance(node, ast.Dict):
        return {str(ast.literal_eval(k)): _literal(v, source) for k, v in zip(node.keys, node.values)}
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_literal(x, source) for x in node.elts]
    value = ast.literal_eval(node)
    return ast.get_source_segment(source, node) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def _parsed(text: str) -> list[tuple[str, object]] | None:
    """Name-value pairs of an object in strict JSON, as a Python literal, or nearly one of them; None if it's none."""
    pairs = lambda p: ("object", p)
    try:
        got = json.loads(text, object_pairs_hook=pairs, parse_int=str, parse_float=str, strict=False)
        return got[1] if isinstance(got, tuple) else None
    except (ValueError, RecursionError):
        pass
    try:
        source = text.strip()
        tree = ast.parse(source, mode="eval").body
        if isinstance(tree, ast.Dict) and all(k is not None for k in tree.keys):
            return [(str(ast.literal_eval(k)), _literal(v, source)) for k, v in zip(tree.keys, tree.values)]
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        pass
    body = text.strip()
    if not (body.startswith("{") or body.endswith("}")):
        return None
    out: list[tuple[str, object]] = []
    for m in _PAIR.finditer(body.lstrip("{")):
        name = next(x for x in (m[1], m[2], m[3], "") if x is not None)
        quoted = m[4] if m[4] is not None else m[5]
        bare = (m[6] or "").strip()
        out.append((_unescape(name), _unescape(quoted) if quoted is not None else None if bare.lower() in ("null", "none", "") else bare))
    return out or None


def _value(value) -> str:
    if value is None:
        return _NULL
    if isinstance(value, tuple) and len(value) == 2 and value[0] == "object":
        return "{" + canonical_pairs(value[1]) + "}"
    if isinstance(value, dict):
        return "{" + canonical_pairs(list(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_value, value)) + "]"
    return letters_and_digits(str(value))


def canonical_pairs(pairs: list[tuple[str, object]]) -> str:
    return _NEXT.join(sorted(letters_and_digits(str(k)) + _IS + _value(v) for k, v in pairs))


def canonical_object(text: str | None) -> str | None:
    """Canonical text of one object: names and values by `letters_and_digits`, in the order of names.

    A null value is kept apart from the empty string; a number or truth value equals its spelling. A text that
    is no object in any known spelling stands for itself, by its letters and digits; null gives null.
    """
    if text is None:
        return None
    pairs = _parsed(text)
    return "=" + letters_and_digits(text) if pairs is None else canonical_pairs(pairs)


def canonical_object_column(text: Column) -> Column:
    """Column form of `canonical_object`."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_object, na_action="ignore")

    return canonical(text)


def fingerprints(rows: DataFrame, key: str, field: str, shape: str = "text") -> DataFrame:
    """id, h (128-bit hash as 16 bytes), v (a second, independent hash), w (length of the canonical text), canon.

    `shape` is text or object. Rows without a key, or whose field is null or (for a text) holds no letter or
    digit, are no records and have no row.
    """
    canon = canonical_text(F.col(f"`{field}`")) if shape == "text" else canonical_object_column(F.col(f"`{field}`"))
    out = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), canon.alias("canon")).filter("id IS NOT NULL AND canon <> ''")
    return out.select("id", F.unhex(F.md5("canon")).alias("h"), F.xxhash64("canon").alias("v"), F.length("canon").alias("w"), "canon")


def copy_groups(rows: DataFrame, key: str, field: str, shape: str = "text") -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups has g, keep_id, n for each distinct record; members has g, id for each record.

    Equal means an equal canonical text. Groups are counted by the 128-bit hash with map-side combining, so a
    record with copies in a third of all rows costs one state per task. Each group carries the extremes of a
    second hash and of the length; if they differ, texts with equal hashes collided, and those groups' rows are
    regrouped by the canonical text itself.
    """
    prints = fingerprints(rows, key, field, shape)
    short = cut(prints.select("id", "h", "v", "w"))
    by_hash = cut(short.groupBy("h").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("w").alias("w0"), F.max("w").alias("w1"),
    ))
    collided = by_hash.filter("v0 <> v1 OR w0 <> w1").select("h")
    groups = by_hash.filter("v0 = v1 AND w0 = w1").select(F.hex("h").alias("g"), "keep_id", "n")
    members = short.select(F.hex("h").alias("g"), "id")
    if not collided.isEmpty():
        exact = prints.join(collided, "h", "left_semi").select(F.concat(F.hex("h"), F.lit(":"), F.col("canon")).alias("g"), "id")
        groups = groups.unionByName(exact.groupBy("g").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        members = short.join(collided, "h", "left_anti").select(F.hex("h").alias("g"), "id").unionByName(exact)
    return groups, members


def repeated_records(rows: DataFrame, key: str, field: str, shape: str = "text") -> DataFrame:
    """keep_id, copy_id: one row for each record that repeats another; keep_id is the smallest key of its group.

    Keys are taken for unique: of rows with the same key and record, each but those of the smallest key gives a row.
    """
    groups, members = copy_groups(rows, key, field, shape)
    pairs = hot_split_join(members, groups.filter("n > 1"), "g", "n")
    return pairs.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
