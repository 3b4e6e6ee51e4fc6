"""Relational helpers beyond the built-in DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- grouping ---


def group_concat(c: Column, sep: str = ",", order: Column | None = None) -> Column:
    """Aggregate: non-null values as text, joined in the order of ``order`` (the value itself by default)."""
    text = c.cast("string")
    cells = F.collect_list(F.when(c.isNotNull(), F.struct((order if order is not None else text).alias("o"), text.alias("v"))))
    return F.array_join(F.transform(F.array_sort(cells), lambda x: x.v), sep)


def count_distinct_with_null(c: Column) -> Column:
    """COUNT(DISTINCT) that counts null as one value."""
    return F.count_distinct(F.struct(c))


def first_by(value: Column, order: Column) -> Column:
    """Aggregate: the value of the row with the least ``order`` (a deterministic 'first row')."""
    return F.min_by(value, order)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per ``keys`` in ``order`` (give a unique tie-breaker).

    A map-side combined ``min_by``-like aggregate is not enough for mixed sort
    directions, so this is a window with a pushed-down group limit.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# --- windows ---


def with_groups_frame(df: DataFrame, name: str, aggregate: Column, partition: Sequence[str], order: Sequence[Column], start: int, end: int) -> DataFrame:
    """Append ``name``: ``aggregate`` over a GROUPS frame, counted in peer groups relative to the current one.

    ``start`` and ``end`` are offsets in groups (``Window.unboundedPreceding`` and
    ``unboundedFollowing`` allowed).  Peer groups are numbered by ``dense_rank``;
    a RANGE frame over that number is the GROUPS frame.
    """
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    frame = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(start, end)
    return df.withColumn("_peer", rank).withColumn(name, aggregate.over(frame)).drop("_peer")


# --- joins ---


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common column names, which appear once; without any it is the cross product."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def range_join(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, bin_width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``lo <= at < hi`` (and equal ``keys``) by an equi-join on bins of ``bin_width``.

    A range is replicated to the bins it touches; choose the width near the
    typical range length.  Null bounds match nothing.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / F.lit(float(bin_width))))
    first, last = F.floor(F.col(lo) / F.lit(float(bin_width))), F.floor(F.col(hi) / F.lit(float(bin_width)))
    r = ranges.filter(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(first, last)))
    joined = p.join(r, [*keys, "_bin"])
    return joined.filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value_cols: Sequence[str], right_at: str | None = None, bucket: Column | None = None) -> DataFrame:
    """For each left row the right row of its ``key`` with the greatest time not after ``at``.

    Both sides are stacked and carried forward by a window; with ``bucket`` (an
    expression over the time column, named ``_at`` here) the window runs per (key,
    bucket) and only one state per bucket is carried over, which keeps a hot key
    from ending in one task.  Left rows without a match get nulls.
    """
    right_at = right_at or at
    cols = [f"_r_{c}" for c in value_cols]
    side_r = right.select(
        F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"),
        F.struct(F.col(right_at).alias("_r_at"), *[F.col(c).alias(f"_r_{c}") for c in value_cols]).alias("_state"),
        *[F.lit(None).cast(dict(left.dtypes)[c]).alias(f"_l_{c}") for c in left.columns],
    )
    empty = F.lit(None).cast(dict(side_r.dtypes)["_state"])
    side_l = left.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_side"), empty.alias("_state"), *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    x = side_r.unionByName(side_l).withColumn("_bucket", bucket if bucket is not None else F.lit(0))
    w = Window.partitionBy(key, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_own", F.last("_state", True).over(w))
    if bucket is not None:
        ends = x.groupBy(key, "_bucket").agg(F.max_by("_own", F.struct("_at", "_side")).alias("_end"))
        ends = ends.withColumn("_carry", F.last("_end", True).over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        x = x.join(ends.drop("_end"), [key, "_bucket"]).withColumn("_own", F.coalesce("_own", "_carry"))
    x = x.filter("_side = 1")
    return x.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], F.col("_own._r_at").alias(f"matched_{right_at}"), *[F.col(f"_own.{n}").alias(c) for n, c in zip(cols, value_cols)])
