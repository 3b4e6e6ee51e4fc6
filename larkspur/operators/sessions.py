"""Sessions from events by a distributed sweep line.

Every interval ``[start, end]`` adds one at its start and subtracts one at its
end plus the gap; a session closes where the running sum returns to zero.

The sweep runs twice.  First per (entity, time bucket), which splits an entity
that holds a large share of all rows over as many tasks as it has buckets.
What remains is at most ``bucket / gap + 1`` partial sessions per bucket, so
the second sweep per entity is bounded by the length of the calendar and not by
the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(df: DataFrame, keys: list[str], start: str, end: str, weight: str, gap_us: int) -> DataFrame:
    """Merge intervals of one key whose distance is at most ``gap_us`` (inclusive).

    Returns ``keys``, ``start``, ``end`` and ``weight`` (summed).
    """
    c = F.col
    marks = df.select(
        *keys,
        F.explode(
            F.array(
                F.struct(c(start).alias("at"), F.lit(1).alias("delta"), c(start).alias("start"), c(end).alias("end"), c(weight).alias("w")),
                F.struct((c(end) + gap_us).alias("at"), F.lit(-1).alias("delta"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("w")),
            )
        ).alias("m"),
    ).select(*keys, "m.*")
    # An opening mark at the very end of the gap still belongs to the session, so it sorts first.
    line = Window.partitionBy(*keys).orderBy(c("at"), c("delta").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("open", F.sum("delta").over(line)).filter(c("delta") == 1)
    opened = F.sum(F.when(c("open") == 1, 1).otherwise(0)).over(line)
    return (
        marks.withColumn("no", opened)
        .groupBy(*keys, "no")
        .agg(F.min("start").alias(start), F.max("end").alias(end), F.sum("w").alias(weight))
        .drop("no")
    )


def sessions(events: DataFrame, entity: str, at_us: str, gap_seconds: int = 1800, bucket_seconds: int = 14_400) -> DataFrame:
    """``entity, start_us, end_us, duration_us, n_events`` of every longest run of events of one
    entity in which consecutive events lie at most ``gap_seconds`` apart.

    ``events`` has one row per event (drop repeated rows first); other columns
    are ignored.  Rows with a null entity or time take no part; a lone event is
    a session with start = end; events of the same microsecond count each.
    """
    if gap_seconds < 0 or bucket_seconds <= 0:
        raise ValueError("gap_seconds must not be negative and bucket_seconds must be positive")
    gap = gap_seconds * 1_000_000
    c = F.col
    x = events.select(c(f"`{entity}`").alias("entity"), c(f"`{at_us}`").alias("start_us")).filter("entity IS NOT NULL AND start_us IS NOT NULL")
    x = x.withColumn("bucket", F.floor(c("start_us") / float(bucket_seconds * 1_000_000)))
    # Events of one microsecond become one weighted interval before the shuffle.
    x = x.groupBy("entity", "bucket", "start_us").agg(F.count(F.lit(1)).alias("n_events")).withColumn("end_us", c("start_us"))
    part = sweep(x, ["entity", "bucket"], "start_us", "end_us", "n_events", gap)
    whole = sweep(part.drop("bucket"), ["entity"], "start_us", "end_us", "n_events", gap)
    return whole.select(
        c("entity").alias(entity), "start_us", "end_us", (c("end_us") - c("start_us")).alias("duration_us"), "n_events"
    )
