"""One wide feature row per entity from an event log.

Map side: every partition encodes entity-type pairs as integers and folds its
rows with ``numpy.bincount`` (counts, sums) and a maximum scatter (latest time),
so a hot entity leaves a fold as at most one row per type.  These rows meet in
two steps: first per (entity, type), which spreads a hot entity over its types
and leaves at most one row for each of them, then per entity, sorted, where a
partition adds every batch at once to a dense block of ``BLOCK`` entities x
types and emits Arrow columns.  A map task holds ``FOLD_ROWS`` rows and a batch,
a reduce task a batch and a block, whatever an entity's share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.ship import ship

#: Entities per dense block.
BLOCK = 1024
#: Rows folded at once on the map side.
FOLD_ROWS = 250_000
_NEVER = np.iinfo(np.int64).min
_PARTIAL = "entity long, type int, n long, flags long, total long, latest long"


def type_vocabulary(events: DataFrame, type_col: str, max_types: int = 2000) -> list[str]:
    """Sorted distinct event types; an error beyond ``max_types`` (the driver lists at most that many)."""
    found = [r[0] for r in events.select(type_col).distinct().limit(max_types + 1).collect()]
    if len(found) > max_types:
        raise ValueError(f"more than {max_types} event types; raise max_types or map rare types to one")
    return sorted(x for x in found if x is not None)


def _fold(entity: np.ndarray, code: np.ndarray, values: list[np.ndarray], latest: np.ndarray, n_types: int) -> pa.RecordBatch:
    ids, who = np.unique(entity, return_inverse=True)
    cell = who.astype(np.int64) * n_types + code
    used, slot = np.unique(cell, return_inverse=True)
    sums = [np.zeros(len(used), np.int64) for _ in values]
    for out, v in zip(sums, values):
        # bincount adds in floating point, exact up to 2**53; larger values go through integer scatter.
        if len(v) and float(np.abs(v).max()) * len(v) < 2**53:
            out += np.bincount(slot, weights=v, minlength=len(used)).astype(np.int64)
        else:
            np.add.at(out, slot, v)
    top = np.full(len(used), _NEVER)
    np.maximum.at(top, slot, latest)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[used // n_types]),
            pa.array((used % n_types).astype(np.int32)),
            *[pa.array(s) for s in sums],
            pa.array(top, mask=top == _NEVER),
        ],
        names=["entity", "type", "n", "flags", "total", "latest"],
    )


def _ints(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


class _Block:
    """Dense cells of up to ``BLOCK`` entities, filled from rows sorted by entity."""

    def __init__(self, n_types: int) -> None:
        self.n_types = n_types
        self.ids: list[int] = []
        self.sums = [np.zeros(BLOCK * n_types, np.int64) for _ in range(3)]
        self.latest = np.full(BLOCK * n_types, _NEVER)

    def room_for(self, ids: np.ndarray, at: int) -> int:
        """End of the rows from ``at`` on that this block still takes."""
        going_on = bool(self.ids) and self.ids[-1] == ids[at]
        starts = at + 1 + np.flatnonzero(np.diff(ids[at:]))
        room = BLOCK - len(self.ids) + going_on
        return at if room == 0 else len(ids) if len(starts) < room else int(starts[room - 1])

    def add(self, ids: np.ndarray, kind: np.ndarray, values: list[np.ndarray], latest: np.ndarray) -> None:
        new = np.diff(ids, prepend=ids[0]) != 0
        new[0] = not self.ids or self.ids[-1] != ids[0]
        cell = (len(self.ids) - 1 + np.cumsum(new)) * self.n_types + kind
        self.ids += ids[new].tolist()
        lo, hi = int(cell.min()), int(cell.max()) + 1
        for grid, v in zip(self.sums, values):
            if float(np.abs(v).max()) * len(v) < 2**53:
                grid[lo:hi] += np.bincount(cell - lo, weights=v, minlength=hi - lo).astype(np.int64)
            else:
                np.add.at(grid, cell, v)
        np.maximum.at(self.latest, cell, latest)

    def columns(self, names: list[str]) -> pa.RecordBatch:
        shape, rows = (BLOCK, self.n_types), len(self.ids)
        sums, latest = [g.reshape(shape)[:rows] for g in self.sums], self.latest.reshape(shape)[:rows]
        arrays = [pa.array(self.ids, pa.int64())]
        for k in range(self.n_types):
            arrays += [pa.array(np.ascontiguousarray(g[:, k])) for g in sums]
            top = np.ascontiguousarray(latest[:, k])
            arrays.append(pa.array(top, mask=top == _NEVER))
        top = latest.max(axis=1)
        arrays += [*[pa.array(g.sum(axis=1)) for g in sums], pa.array(top, mask=top == _NEVER)]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def entity_features(
    events: DataFrame,
    entity: str,
    event_type: str,
    types: list[str],
    flag: str,
    amount: str,
    latest: str,
    nothing: str = "unspecified",
) -> DataFrame:
    """One row per ``entity`` with, for each of ``types``, ``nothing`` and over all (``all``):
    ``n__T`` rows, ``flags__T`` rows with ``flag`` = 1, ``total__T`` sum of ``amount``, ``latest__T``
    greatest ``latest`` (null if there is none); all columns int64.

    ``events`` holds each event once (repeated rows dropped before).  A null
    entity is left out.  A null, empty or unlisted type counts as ``nothing``;
    null flags, amounts and times add nothing but the row still counts.  Other
    columns are ignored, so names that clash with the features do no harm.
    """
    if nothing in types or "all" in types:
        raise ValueError("a type has the name kept for the unspecified type or the total")
    ship(events.sparkSession)
    c = F.col
    names = [*types, nothing]
    n_types = len(names)
    slim = events.select(
        c(f"`{entity}`").cast("long").alias("entity"),
        c(f"`{event_type}`").cast("string").alias("type"),
        c(f"`{flag}`").cast("long").alias("flag"),
        c(f"`{amount}`").cast("long").alias("amount"),
        c(f"`{latest}`").cast("long").alias("latest"),
    ).filter("entity IS NOT NULL")

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = pa.array(types, pa.string())
        held, rows = [], 0
        def fold() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            code = pc.fill_null(pc.index_in(t["type"].cast(pa.string()), lookup), n_types - 1) if types else pa.array(np.full(len(t), 0))
            code = code.to_numpy().astype(np.int64)
            values = [np.ones(len(t), np.int64), (_ints(t["flag"], 0) == 1).astype(np.int64), _ints(t["amount"], 0)]
            return _fold(_ints(t["entity"], 0), code, values, _ints(t["latest"], _NEVER), n_types)
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FOLD_ROWS:
                yield fold()
                held, rows = [], 0
        if rows:
            yield fold()

    features = ["n", "flags", "total", "latest"]
    columns = ["entity"] + [f"{f}__{t}" for t in [*names, "all"] for f in features]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in columns])

    def reduce_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(n_types)
        for batch in batches:
            ids = _ints(batch.column(0), 0)
            kind, values = _ints(batch.column(1), 0), [_ints(batch.column(k), 0) for k in (2, 3, 4)]
            latest = _ints(batch.column(5), _NEVER)
            at = 0
            while at < len(ids):
                end = block.room_for(ids, at)
                if end == at:
                    yield block.columns(columns)
                    block = _Block(n_types)
                    continue
                block.add(ids[at:end], kind[at:end], [v[at:end] for v in values], latest[at:end])
                at = end
        if len(block.ids):
            yield block.columns(columns)

    sums = [F.sum(f).alias(f) for f in features[:3]]
    partial = slim.mapInArrow(map_side, _PARTIAL).groupBy("entity", "type").agg(*sums, F.max("latest").alias("latest"))
    grouped = partial.repartition("entity").sortWithinPartitions("entity")
    out = grouped.mapInArrow(reduce_side, schema)
    return out.withColumnRenamed("entity", entity)
