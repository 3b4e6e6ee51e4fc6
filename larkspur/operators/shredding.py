"""Nested records to flat tables by columnar shredding.

Every repeated path (``gear``, ``gear.contents``, ``gear.contents.mags``, ...)
of a batch becomes one column of entries with a repetition and a definition
level, run-length encoded:

* repetition ``r`` of a path of depth ``d``: ``r < d`` opens a new list under
  the next entry of the parent path, ``r = d`` continues the list;
* definition ``2d`` is an item, ``2d - 1`` a null or unreadable entry that only
  takes a position, ``2d - 2`` a parent without that list.

Flat rows are rebuilt per path from the level sequences alone: cumulative sums
of the openings give the parent's ordinal, the distance from the last opening
gives the position in the list.  A path's rows link to their parent's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import gear
from larkspur.plans.ship import ship

ITEM_SCHEMA = "row_key string, item_path string, parent_path string, depth int, class string, count long"


class _Path:
    """Level sequences and leaf values of one repeated path; ``size`` counts its entries."""

    __slots__ = ("rep", "deff", "run", "cls", "cnt", "covered", "size")

    def __init__(self) -> None:
        self.rep, self.deff, self.run, self.cls, self.cnt = [], [], [], [], []
        self.covered = self.size = 0

    def skip_to(self, parent_ordinal: int, depth: int) -> None:
        """Placeholders for the parent entries since the last list (they have none)."""
        missing = parent_ordinal - self.covered
        if missing > 0:
            self.rep.append(depth - 1)
            self.deff.append(2 * depth - 2)
            self.run.append(missing)
            self.size += missing
        self.covered = parent_ordinal + 1


def shred(texts: list[str | None], name: str = "gear") -> dict[tuple[str, ...], _Path]:
    """Level sequences of all repeated paths over a batch of texts.

    A text that is null, empty, cut off or holds no list adds nothing but its ordinal.
    """
    paths: dict[tuple[str, ...], _Path] = {(name,): _Path()}

    def opened(path: tuple[str, ...], entries: list, parent_ordinal: int, rep: int) -> list:
        column = paths.get(path)
        if column is None:
            column = paths[path] = _Path()
        column.skip_to(parent_ordinal, len(path))
        return [path, column, iter(entries), rep]

    def stripe(path: tuple[str, ...], entries: list, parent_ordinal: int) -> None:
        # Lists that are under way, the innermost last: no recursion, so no limit of depth.
        stack = [opened(path, entries, parent_ordinal, 0)]
        while stack:
            path, column, rest, rep = now = stack[-1]
            depth = len(path)
            for item in rest:
                now[3] = depth
                cls = gear.item_class(item)
                column.rep.append(rep)
                column.run.append(1)
                ordinal = column.size
                column.size += 1
                if cls is None:
                    column.deff.append(2 * depth - 1)
                    rep = depth
                    continue
                column.deff.append(2 * depth)
                column.cls.append(cls)
                column.cnt.append(gear.item_count(item))
                below = []
                for field, raw in gear.item_children(item):
                    try:
                        entries = gear.read_list(raw)
                    except gear.Unreadable:
                        continue
                    if entries:
                        below.append(opened((*path, field), entries, ordinal, rep))
                if below:
                    stack += below
                    break
                rep = depth
            else:
                stack.pop()

    for row, text in enumerate(texts):
        if not text or not text.strip():
            continue
        try:
            entries = gear.gear_list(text)
        except gear.Unreadable:
            continue
        if entries:
            stripe((name,), entries, row)
    return paths


def assemble(paths: dict[tuple[str, ...], _Path]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list, list]]:
    """``depth, row ordinals, item paths, parent paths, classes, counts`` per path, from the levels."""
    names: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}
    for path in sorted(paths, key=len):
        column, depth = paths[path], len(path)
        rep, deff, run = (np.asarray(x, np.int64) for x in (column.rep, column.deff, column.run))
        if not len(rep):
            continue
        opens = rep < depth
        parent = np.cumsum(np.where(opens, run, 0)) - 1
        at = np.cumsum(run) - run
        opened_at = np.maximum.accumulate(np.where(opens, at, 0))
        position = at - opened_at
        item = deff == 2 * depth
        if depth == 1:
            rows, above = parent, np.full(len(rep), path[0], object)
        else:
            up_rows, up_names = names[path[:-1]]
            rows, above = up_rows[parent], up_names[parent]
        # Entries by ordinal, for the paths below; placeholders never have children.
        own_rows, own_names = np.full(column.size, -1, np.int64), np.full(column.size, None, object)
        k = np.flatnonzero(item)
        head = [f"{a}.{path[-1]}." if depth > 1 else f"{a}." for a in above[k]]
        full = np.array([h + str(i) for h, i in zip(head, position[k].tolist())], object)
        own_rows[at[k]], own_names[at[k]] = rows[k], full
        names[path] = (own_rows, own_names)
        yield depth, rows[k], full, above[k], column.cls, column.cnt


def item_rows(keys: list, texts: list[str | None]) -> pa.Table:
    """Flat item rows of a batch (``ITEM_SCHEMA``)."""
    out: dict[str, list] = {n: [] for n in ("row_key", "item_path", "parent_path", "depth", "class", "count")}
    for depth, rows, full, above, cls, cnt in assemble(shred(texts)):
        out["row_key"] += [keys[r] for r in rows.tolist()]
        out["item_path"] += full.tolist()
        out["parent_path"] += above.tolist() if depth > 1 else [None] * len(rows)
        out["depth"] += [depth] * len(rows)
        out["class"] += cls
        out["count"] += cnt
    return pa.table(
        [
            pa.array(out["row_key"], pa.string()),
            pa.array(out["item_path"], pa.string()),
            pa.array(out["parent_path"], pa.string()),
            pa.array(out["depth"], pa.int32()),
            pa.array(out["class"], pa.string()),
            pa.array(out["count"], pa.int64()),
        ],
        names=list(out),
    )


def gear_items(table: DataFrame, source_table: str, key: str, text: str) -> DataFrame:
    """One row per item of the nested texts: ``source_table, row_key, item_path, parent_path, depth, class, count``.

    ``parent_path`` is null for an item of the outermost list, otherwise the
    ``item_path`` of its parent under the same ``row_key``.  Null, empty and
    cut-off texts give no rows; null entries take a position but give no row;
    a child list that cannot be read is left out with everything below it.
    Nesting may be of any depth.  Repeated rows count once.
    """
    ship(table.sparkSession)
    slim = table.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield from item_rows(part.column(0).to_pylist(), part.column(1).to_pylist()).to_batches()

    return slim.mapInArrow(run, ITEM_SCHEMA).select(F.lit(source_table).alias("source_table"), "*")
