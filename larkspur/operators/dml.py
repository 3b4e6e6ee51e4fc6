"""Writes as functions from tables to tables.

A table is an immutable DataFrame; a write returns the next version.  Key
comparisons are joins, so a write scales with the data like any query.  Null
keys never match (as in SQL).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _aligned(new: DataFrame, like: DataFrame) -> DataFrame:
    """``new`` with the columns and types of ``like``; missing columns are null."""
    kinds = dict(like.dtypes)
    return new.select(*[(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns])


def last_per_key(new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (or all values, for a fixed choice)."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.distinct()
    row = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    best = new.groupBy(*keys).agg(F.max(row).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(_aligned(new, old))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Add the rows whose key is not there yet, one per key."""
    fresh = last_per_key(new, keys, order).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(_aligned(fresh, old))


def replace_into(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` take the place of rows with their key."""
    last = _aligned(last_per_key(new, keys, order), old)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], assign: Mapping[str, str], where: str | None = None) -> DataFrame:
    """Insert new keys; for present ones set ``assign`` (SQL text over the row's columns and ``excluded.c``)."""
    last = _aligned(last_per_key(new, keys), old)
    match = None
    for k in keys:
        c = F.col(f"target.{k}") == F.col(f"excluded.{k}")
        match = c if match is None else match & c
    both = old.withColumn("_t", F.lit(True)).alias("target").join(last.withColumn("_n", F.lit(True)).alias("excluded"), match, "full")
    hit = F.col("target._t").isNotNull() & F.col("excluded._n").isNotNull()
    if where:
        hit = hit & F.coalesce(F.expr(_qualify(where, old.columns)), F.lit(False))
    out = []
    for c in old.columns:
        value = F.when(F.col("target._t").isNull(), F.col(f"excluded.{c}"))
        if c in assign:
            value = value.when(hit, F.expr(_qualify(assign[c], old.columns)))
        out.append(value.otherwise(F.col(f"target.{c}")).cast(dict(old.dtypes)[c]).alias(c))
    return both.select(*out)


def _qualify(expression: str, columns: Sequence[str]) -> str:
    """Bare column names of an expression as columns of the target row."""
    from larkspur.plans.rewrite import Token, lex, text

    names = {c.lower() for c in columns}
    tokens = lex(expression)
    out = []
    for k, t in enumerate(tokens):
        bare = t.kind == "word" and t.low in names and not (k and tokens[k - 1].text == ".") and not (k + 1 < len(tokens) and tokens[k + 1].text in ".(")
        out.append(Token("word", f"target.{t.text}") if bare else t)
    return text(out)


def update(old: DataFrame, assign: Mapping[str, str | Column], where: str | Column | None = None) -> DataFrame:
    """All assignments see the row as it was; a null condition leaves the row alone."""
    hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    kinds = dict(old.dtypes)
    out = []
    for c in old.columns:
        if c in assign:
            value = F.expr(assign[c]) if isinstance(assign[c], str) else assign[c]
            out.append(F.when(hit, value).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return old.select(*out)


def affected(old: DataFrame, where: str | Column | None) -> DataFrame:
    """The rows that a condition of a write hits."""
    return old if where is None else old.filter(where)


def delete(old: DataFrame, where: str | Column | None = None) -> DataFrame:
    """A row is kept where the condition is false or null."""
    if where is None:
        return old.limit(0)
    return old.filter(~F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False)))


def delete_using(old: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Delete the rows that have a partner in ``other``."""
    return old.join(other, on if isinstance(on, Column) else list(on), "left_anti")


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_set: Mapping[str, str] | None = None,
    delete_when: str | None = None,
    insert_values: Mapping[str, str] | None = None,
) -> DataFrame:
    """MERGE on equal ``keys``; expressions name columns as ``t.c`` and ``s.c``.

    A matched row for which ``delete_when`` holds is deleted, any other matched
    row takes ``update_set``; a source row without partner is inserted with
    ``insert_values``.  Several source rows of one key count as one (the greatest).
    """
    source = last_per_key(source, keys)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        c = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = c if on is None else on & c
    both = t.join(s, on, "full" if insert_values is not None else "left")
    there, partner = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
    if delete_when is not None:
        both = both.filter(~(there & partner & F.coalesce(F.expr(delete_when), F.lit(False))))
    out, kinds = [], dict(target.dtypes)
    for c in target.columns:
        value = F.when(~there, F.expr(insert_values[c]) if insert_values and c in insert_values else F.lit(None).cast(kinds[c]))
        if update_set and c in update_set:
            value = value.when(partner, F.expr(update_set[c]))
        out.append(value.otherwise(F.col(f"t.{c}")).cast(kinds[c]).alias(c))
    return both.select(*out)


# --- constraints ---


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (rows with a null in the key are distinct from all others)."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a CHECK is false (null passes)."""
    return df.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def fk_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias("_p"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_p"), "left_anti")


def cascade_delete(child: DataFrame, column: str, gone: DataFrame, gone_column: str) -> DataFrame:
    keys = gone.select(F.col(gone_column).alias("_p"))
    return child.join(keys, F.col(column) == F.col("_p"), "left_anti")


def cascade_set_null(child: DataFrame, column: str, gone: DataFrame, gone_column: str) -> DataFrame:
    keys = gone.select(F.col(gone_column).alias("_p")).distinct()
    x = child.join(keys, F.col(column) == F.col("_p"), "left")
    return x.select(*[F.when(F.col("_p").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns])


def number_rows(new: DataFrame, column: str, start: int, order: Sequence[str] | None = None) -> DataFrame:
    """Fill the nulls of an auto-increment ``column`` from ``start`` + 1 on, in the order of ``order``.

    Positions come from per-partition counts (two passes, no global sort into one
    task): rows are range-partitioned by the order, counted per partition, and
    numbered within.
    """
    from pyspark.sql import Window

    order = list(order or [c for c in new.columns if c != column])
    empty = new.filter(F.col(column).isNull()).drop(column)
    spread = empty.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    from larkspur.plans.materialize import cut

    spread = cut(spread)
    counts = sorted((r["_p"], r["n"]) for r in spread.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    base, offsets = start, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(base)]
        base += n
    if not offsets:
        return new
    shift = F.element_at(F.create_map(*offsets), F.col("_p"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    numbered = spread.withColumn(column, (shift + local).cast("long")).drop("_p")
    return new.filter(F.col(column).isNotNull()).unionByName(numbered.select(*new.columns))
