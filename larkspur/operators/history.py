"""Versions of changing attributes with their period of validity.

Gaps and islands: ``lag`` on the attributes' hash (and, behind it, on the
attributes themselves) marks the rows that change something, the running sum of
the marks numbers the islands, an island's least time opens its period and the
start of the next one closes it.

A key may hold a large share of all rows, so rows lie together per (key, time
bucket) and all of this runs there.  What a bucket has to tell the others is one
row: its last state.  Only those rows meet in a window over the whole key (their
number is bounded by the calendar), and one join brings back what holds at a
bucket's begin.  All attributes travel together, so a history takes one such
pass, whatever the number of attributes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def _settled(log: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """One row per (key, time): of the greatest ``_newest``, and in each column the greatest value among its ties.

    Both steps combine by hashing: ties and repeated rows on the map side, then
    the newest where the rows of a (key, bucket) lie anyway.
    """
    greatest = [F.max("_gone").alias("_gone"), *[F.max(F.col(f"`{a}`")).alias(a) for a in attrs]]
    ties = log.groupBy("_k", "_bucket", "_at", "_newest").agg(*greatest)
    newest = [F.max_by(F.col(f"`{c}`"), "_newest").alias(c) for c in ("_gone", *attrs)]
    return ties.repartition("_k", "_bucket").groupBy("_k", "_bucket", "_at").agg(*newest)


def version_starts(
    log: DataFrame,
    key: str,
    at: str,
    attrs: Sequence[str],
    bucket: Column,
    newest: Column,
    ends_at: Column | None = None,
    fill: bool = False,
    skip_empty: bool = False,
) -> DataFrame:
    """Rows at which a version begins or the entity ends: ``_k, _bucket, _at, attrs, _gone``.

    ``log`` may come in any order, late, corrected and repeated.  Of the rows of
    one (key, ``at``) the one with the greatest ``newest`` counts (not null);
    where several tie, the greatest value of each column.  ``ends_at`` marks rows
    that end the entity (a delete); an end after an end, or before anything,
    changes nothing.  With ``fill`` a null attribute was not recorded and keeps
    its last value (none survives an end); without, null is a value like others.
    The key's first row begins a version even if all its attributes are null,
    but with ``skip_empty`` rows that have only nulls take no part.  Rows with a
    null key, time or ``newest`` take no part.
    """
    c = F.col
    ended = F.coalesce(ends_at, F.lit(False)) if ends_at is not None else F.lit(False)
    x = log.select(
        c(f"`{key}`").alias("_k"), c(f"`{at}`").alias("_at"), bucket.alias("_bucket"), newest.alias("_newest"), ended.alias("_gone"), *[c(f"`{a}`") for a in attrs]
    )
    x = _settled(x.filter("_k IS NOT NULL AND _at IS NOT NULL AND _newest IS NOT NULL"), attrs)
    recorded = {a: ~c("_gone") & c(f"`{a}`").isNotNull() if fill else ~c("_gone") for a in attrs}
    if skip_empty:
        x = x.filter(" OR ".join(["_gone", *[f"`{a}` IS NOT NULL" for a in attrs]]))

    # What a bucket leaves behind: the last value of each attribute with its time, the last end, the last row.
    left = [F.max("_at").alias("_last"), F.max(F.when(c("_gone"), c("_at"))).alias("_end")]
    for i, a in enumerate(attrs):
        when = F.when(recorded[a], c("_at"))
        left += [F.max(when).alias(f"_t{i}"), F.max_by(c(f"`{a}`"), when).alias(f"_v{i}")]
    ends = x.groupBy("_k", "_bucket").agg(*left)
    past = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(*_BEFORE)

    def value(i: int) -> Column:
        # A struct, so that a settled null differs from a value of an earlier bucket that still holds.
        alive = c(f"_t{i}").isNotNull() & (c("_end").isNull() | (c(f"_t{i}") > c("_end")))
        return F.when(alive, F.struct(c(f"_v{i}").alias("v"))).when(c("_end").isNotNull(), F.struct(F.when(F.lit(False), c(f"_v{i}")).alias("v")))

    carried = [F.last(value(i), True).over(past).alias(f"_c{i}") for i in range(len(attrs))]
    ends = ends.select("_k", "_bucket", F.last(F.coalesce(c("_end") == c("_last"), F.lit(False))).over(past).alias("_was"), *carried)

    x = x.join(ends.hint("shuffle_hash"), ["_k", "_bucket"])
    local = Window.partitionBy("_k", "_bucket").orderBy("_at")
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(*_BEFORE)
    own, prior = [], []
    for i, a in enumerate(attrs):
        cell = F.when(c("_gone") | recorded[a], F.struct(F.when(~c("_gone"), c(f"`{a}`")).alias("v")))
        own.append(F.coalesce(F.last(cell, True).over(upto), c(f"_c{i}"))["v"].alias(a))
        prior.append(F.coalesce(F.last(cell, True).over(before), c(f"_c{i}"))["v"].alias(f"_p{i}"))
    x = x.select("_k", "_bucket", "_at", "_gone", F.coalesce(F.lag("_gone").over(local), c("_was")).alias("_was"), *own, *prior)
    now, then = F.struct(*[c(f"`{a}`").alias(f"_p{i}") for i, a in enumerate(attrs)]), F.struct(*[f"_p{i}" for i in range(len(attrs))])
    differs = (F.xxhash64(now) != F.xxhash64(then)) | ~now.eqNullSafe(then)
    changed = F.when(c("_was").isNull(), ~c("_gone")).when(c("_was") != c("_gone"), True).otherwise(~c("_gone") & differs)
    x = x.withColumn("_no", F.sum(F.when(changed, 1).otherwise(0)).over(upto)).filter("_no > 0")
    # The rows of an island share their state, so it may be part of the grouping; island 0 began in an earlier bucket.
    return x.groupBy("_k", "_bucket", "_no", "_gone", *[c(f"`{a}`") for a in attrs]).agg(F.min("_at").alias("_at")).drop("_no")


def versions(
    log: DataFrame,
    key: str,
    at: str,
    attrs: Sequence[str],
    bucket: Column,
    newest: Column,
    ends_at: Column | None = None,
    fill: bool = False,
    skip_empty: bool = False,
) -> DataFrame:
    """Versions ``key, version_no (from 1 per key), attrs, valid_from, valid_to, is_current``.

    See ``version_starts`` for the arguments and what begins a version.
    ``valid_to`` is the start of the next version or the row that ends the
    entity, null for the current version; no version covers the time from an end
    to the next version.
    """
    c = F.col
    x = version_starts(log, key, at, attrs, bucket, newest, ends_at, fill, skip_empty)
    inner = Window.partitionBy("_k", "_bucket").orderBy("_at")
    firsts = x.groupBy("_k", "_bucket").agg(F.min("_at").alias("_first"), F.count_if(~c("_gone")).alias("_n"))
    after = Window.partitionBy("_k").orderBy("_bucket")
    firsts = firsts.select("_k", "_bucket", F.lead("_first").over(after).alias("_next"), F.coalesce(F.sum("_n").over(after.rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    no = F.sum(F.when(c("_gone"), 0).otherwise(1)).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_no", no).withColumn("_own", F.lead("_at").over(inner)).filter(~c("_gone")).join(firsts, ["_k", "_bucket"])
    to = F.coalesce("_own", "_next")
    return x.select(
        c("_k").alias(key),
        (c("_base") + c("_no")).cast("long").alias("version_no"),
        *[c(f"`{a}`") for a in attrs],
        c("_at").alias("valid_from"),
        to.alias("valid_to"),
        to.isNull().alias("is_current"),
    )
