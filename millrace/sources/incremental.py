"""Incremental reading by high-water marks."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class WaterMark:
    source_name: str
    last_seen_index: int | None = None
    last_seen_timestamp: str | None = None
    last_seen_id: str | None = None
    last_updated: str | None = None
    total_processed: int = 0


class MarkStore:
    """Marks of all sources, kept in a JSON file if a path is given. A file that can't be read counts as none."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.marks: dict[str, WaterMark] = {}
        if self.path and self.path.exists():
            try:
                self.marks = {k: WaterMark(**v) for k, v in json.loads(self.path.read_text()).items()}
            except (ValueError, TypeError, AttributeError):
                self.marks = {}

    def get(self, source: str) -> WaterMark:
        return self.marks.get(source, WaterMark(source))

    def commit(self, mark: WaterMark) -> WaterMark:
        """Keep a mark that was read without being kept, once its rows are safe."""
        self.marks[mark.source_name] = mark
        self._save()
        return mark

    def update(self, source: str, processed: int = 0, **marks) -> WaterMark:
        """Overwrite the marks that aren't None, add to the number of rows, and keep the result."""
        return self.commit(self.advanced(source, processed, **marks))

    def advanced(self, source: str, processed: int = 0, **marks) -> WaterMark:
        """What `update` would keep; nothing is kept."""
        mark = replace(self.get(source))
        for name, value in marks.items():
            if value is not None:
                setattr(mark, name, value)
        mark.total_processed += processed
        mark.last_updated = dt.datetime.now(dt.timezone.utc).isoformat()
        return mark

    def reset(self, source: str | None = None) -> None:
        self.marks = {} if source is None else {k: v for k, v in self.marks.items() if k != source}
        self._save()

    def summary(self) -> dict[str, dict]:
        return {k: asdict(v) for k, v in sorted(self.marks.items())}

    def _save(self) -> None:
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self.summary(), indent=2))


def rows_after(df: DataFrame, column: str, mark, keep_null_first: bool = True) -> DataFrame:
    """Rows beyond `mark`, by a filter that the source can evaluate; all rows without a mark.

    Null and empty values are read on the first load (`keep_null_first`) and never afterwards.
    """
    c = F.col(f"`{column}`")
    if mark is None:
        return df if keep_null_first else df.filter(c.isNotNull())
    return df.filter(c > F.lit(mark))


def _advance(new: DataFrame, column: str, old):
    n, top = new.agg(F.count(F.lit(1)), F.max(f"`{column}`")).first()
    return n, old if top is None or top == "" else top


def _bounded(new: DataFrame, column: str, top, first: bool) -> DataFrame:
    """`new` without rows beyond the mark found, which arrived since it was found and come with the next load."""
    if top is None:
        return new
    c = F.col(f"`{column}`")
    inside = c <= F.lit(top).cast(new.schema[column].dataType)
    return new.filter(c.isNull() | inside if first else inside)


def read_by_index(df: DataFrame, store: MarkStore, source: str, column: str = "_ord", commit: bool = True) -> tuple[DataFrame, WaterMark]:
    """New rows by position, and the mark after them. An empty load leaves the mark as it was, so the next load starts at
    position 0. With `commit` false the mark isn't kept; keep it by `store.commit` when the rows are written.
    """
    old = store.get(source).last_seen_index
    new = rows_after(df, column, old)
    n, top = _advance(new, column, old)
    mark = store.advanced(source, n, last_seen_index=top)
    return _bounded(new, column, top, old is None), store.commit(mark) if commit else mark


def read_by_timestamp(df: DataFrame, store: MarkStore, source: str, column: str, commit: bool = True) -> tuple[DataFrame, WaterMark]:
    """New rows by a time column, given as time or as text that sorts like one."""
    old = store.get(source).last_seen_timestamp
    kind = df.schema[column].dataType
    new = rows_after(df, column, old if old is None or kind.typeName() == "string" else F.lit(old).cast(kind))
    n, top = _advance(new.withColumn(column, F.col(f"`{column}`").cast("string")), column, old)
    mark = store.advanced(source, n, last_seen_timestamp=top)
    return _bounded(new, column, top, old is None), store.commit(mark) if commit else mark


def read_by_id(df: DataFrame, store: MarkStore, source: str, column: str, commit: bool = True) -> tuple[DataFrame, WaterMark]:
    """New rows by a growing id; numbers are compared as numbers."""
    old = store.get(source).last_seen_id
    kind = df.schema[column].dataType
    new = rows_after(df, column, old if old is None or kind.typeName() == "string" else F.lit(old).cast(kind))
    n, top = _advance(new, column, old)
    mark = store.advanced(source, n, last_seen_id=None if top is None else str(top))
    return _bounded(new, column, top, old is None), store.commit(mark) if commit else mark


def load_new(read: Callable[..., tuple[DataFrame, WaterMark]], df: DataFrame, store: MarkStore, source: str, column: str, write: Callable[[DataFrame], None]) -> WaterMark:
    """Write what is new by `read` (one of the three above), then keep the mark; if writing fails the mark stays."""
    new, mark = read(df, store, source, column, commit=False)
    write(new)
    return store.commit(mark)
