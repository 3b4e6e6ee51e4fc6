"""References to records that do not exist.

Tables and foreign keys form a graph.  A row is a *direct* orphan through a
field whose key has no live parent row; a row whose parent row is itself an
orphan is an *inherited* orphan.  The cascade iterates semi-joins down the
graph until a round finds nothing new.

Every join first reduces the child side to its distinct keys with their counts
(map-side combined), so the parent lookup never sees the raw skew; the way back
to the rows splits off the hot keys, of which there are at most 200.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.materialize import cut
from larkspur.plans.skew import hot_keys, semi_join_split


@dataclass(frozen=True)
class Reference:
    """``child.field`` points to ``parent``; values in ``nobody`` refer to no record."""

    child: str
    field: str
    parent: str
    nobody: tuple = ()


def live_keys(log: DataFrame, key: str, order: list[str], op: str, deleted: str = "delete") -> DataFrame:
    """Keys (as text, column ``key``) whose latest row of a log by ``order`` is no delete.

    The latest row is found by ``max_by`` (map-side combined), not by a window
    over a key's whole history.
    """
    rank = F.struct(*[F.col(c) for c in order])
    last = log.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(
        F.max_by(F.lower(F.btrim(op)), rank).alias("op")
    )
    return last.filter(~F.coalesce(F.col("op") == deleted, F.lit(False))).select("key")


def plain_keys(table: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``table`` as text, column ``key``."""
    return table.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()


def _refs(rows: DataFrame, ref: Reference, row_key: str, period: str | None) -> DataFrame:
    out = rows.select(
        F.col(f"`{row_key}`").cast("string").alias("row_key"),
        F.col(f"`{ref.field}`").cast("string").alias("key"),
        (F.col(f"`{period}`").cast("string") if period else F.lit(None).cast("string")).alias("period"),
    ).filter("key IS NOT NULL")
    return out.filter(~F.col("key").isin([str(v) for v in ref.nobody])) if ref.nobody else out


def _label(found: DataFrame, ref: Reference, kind: str) -> DataFrame:
    return found.select(
        F.lit(ref.child).alias("source_table"),
        F.lit(ref.field).alias("ref_field"),
        "row_key",
        F.col("key").alias("missing_key"),
        "period",
        F.lit(kind).alias("kind"),
    )


def orphans(
    tables: Mapping[str, DataFrame],
    row_keys: Mapping[str, str],
    parents: Mapping[str, DataFrame],
    refs: Iterable[Reference],
    periods: Mapping[str, str] | None = None,
    max_rounds: int = 100,
) -> DataFrame:
    """All dangling references: ``source_table, ref_field, row_key, missing_key, period, kind``.

    ``tables`` are the child tables, ``row_keys`` names each table's key column,
    ``parents`` gives each parent's live keys (column ``key``, text), ``periods``
    names a column to report by.  ``kind`` is ``direct`` or ``inherited``.

    One fixpoint: the records that are referred to but missing or deleted are
    the first orphaned records; a round semi-joins the children of the last
    round's orphaned records down the foreign-key graph and makes them orphaned
    records in turn, until a round brings nothing new.

    A null or ``nobody`` value refers to nothing and is never an orphan; repeated
    rows give one row; it does not matter whether the target came before or
    after the reference.  Empty tables give no rows.  A row that refers to a
    missing record in one field and to an orphan in another is reported for both.
    A cycle ends when a round brings no new orphan; a chain longer than
    ``max_rounds`` is an error, not a cut.
    """
    refs, periods = list(refs), dict(periods or {})
    if not refs:
        raise ValueError("no references given")
    # Only children of tables that can hold orphans themselves take part in later rounds.
    down = [r for r in refs if r.parent in row_keys and any(o.child == r.parent for o in refs)]
    found: DataFrame | None = None
    front: DataFrame | None = None
    same = ["source_table", "ref_field", "row_key", "missing_key"]
    for no in range(max_rounds + 1):
        new: DataFrame | None = None
        for ref in refs if front is None else down:
            rows = _refs(tables[ref.child], ref, row_keys[ref.child], periods.get(ref.child))
            # Keys with their counts first, so that the lookup of the records meets each key once.
            counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            if front is None:
                counts = counts.join(parents[ref.parent], "key", "left_anti")
            else:
                gone = front.filter(F.col("source_table") == ref.parent).select(F.col("row_key").alias("key")).distinct()
                counts = counts.join(gone, "key", "left_semi")
            # The orphaned records' keys, written once: the hot keys, their split and the semi-join all read them.
            counts = cut(counts)
            hit = semi_join_split(rows, "key", counts.select("key"), hot_keys(counts, "key", "n"))
            hit = _label(hit.distinct(), ref, "direct" if front is None else "inherited")
            new = hit if new is None else new.unionByName(hit)
        if found is None and not down:
            return new
        front = cut(new if found is None else new.join(found.select(*same), same, "left_anti"))
        if found is not None and front.isEmpty():
            return found
        found = front if found is None else found.unionByName(front)
    raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, period and kind: ``n_refs`` and ``n_keys`` (distinct missing keys)."""
    per_key = found.groupBy("source_table", "ref_field", "period", "kind", "missing_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("source_table", "ref_field", "period", "kind").agg(
        F.sum("n").alias("n_refs"), F.count("missing_key").alias("n_keys")
    )
