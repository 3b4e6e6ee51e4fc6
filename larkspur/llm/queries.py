"""Queries p2, p8, p9 and p10 and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.digest import centroid_rows, centroids, certified, digest_rows, estimates, merge_digests, percentiles
from larkspur.llm.leakage import leaked_items
from larkspur.llm.packing import pack, token_counts
from larkspur.llm.subjects import subject_areas
from larkspur.plans.materialize import cut
from larkspur.plans.skew import row_hash
from larkspur.sources.tables import table

#: Percentiles reported per weapon class.
QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Tokens of a container.
CAPACITY = 2048
#: Events of one arrival block: stands for a day's or a file's share of the log.
ARRIVAL_BLOCK = 100_000


def _distances(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """``weapon, distance, n`` (and ``extra``): measured distances of distinct events, equal ones counted together."""
    raw = table(spark, d, "kill_events")
    weapon = F.lower(F.regexp_replace("killer_weapon", r"^\s+|\s+$", ""))
    block = F.floor(F.coalesce("id", F.lit(0)) / F.lit(float(ARRIVAL_BLOCK)))
    # Repeated rows drop out by what is needed of them and a hash of the whole row, so only five narrow columns travel.
    kills = raw.withColumn("row_hash", row_hash(raw)).filter("distance >= 0").select(
        "id", "row_hash", block.alias("block"), F.when(F.coalesce(weapon, F.lit("")) == "", F.lit("unspecified")).otherwise(weapon).alias("weapon"), "distance"
    )
    # Written once: both the clustering and the counting pass read the combined counts.
    return cut(kills.distinct().groupBy("weapon", "distance", *extra).agg(F.count(F.lit(1)).alias("n")))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the measured distance per weapon class with their certified rank error."""
    out = percentiles(_distances(spark, d), "weapon", "distance", QS, weight="n")
    return out.withColumnRenamed("grp", "weapon")


def _block_digests(counted: DataFrame) -> DataFrame:
    """Stored digests of every arrival block and weapon class, under the key ``block|weapon``."""
    parts = counted.withColumn("key", F.concat_ws("|", F.col("block").cast("string"), "weapon"))
    return digest_rows(merge_digests(centroids(parts, "key", "distance", weight="n")))


def _merged(stored: DataFrame) -> DataFrame:
    """One digest per weapon class, merged from the blocks' stored ones."""
    again = centroid_rows(stored).withColumn("grp", F.expr("substr(grp, instr(grp, '|') + 1)"))
    return digest_rows(merge_digests(again))


def _with_points(stored: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    points = certified(counted, key, "distance", cut(estimates(stored, QS)), QS, "n")
    points = points.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("q", "estimate", "rank_error"))).alias("points"))
    return stored.join(points, "grp")


def p2_digests(spark: SparkSession, d: str) -> DataFrame:
    """One mergeable digest per arrival block and weapon class and, with a null block, the merged one of each class over
    all blocks, with percentiles and their certified rank errors.

    ``points`` lists quantile, estimate and rank error; ``means`` and ``weights`` are
    the centroids, from which any blocks can be merged.
    """
    counted = _distances(spark, d, "block")
    stored = cut(_block_digests(counted))
    keyed = counted.withColumn("key", F.concat_ws("|", F.col("block").cast("string"), "weapon"))
    blocks = _with_points(stored, keyed, "key").withColumn("bar", F.instr("grp", "|"))
    blocks = blocks.withColumns({"block": F.expr("CAST(substr(grp, 1, bar - 1) AS bigint)"), "weapon": F.expr("substr(grp, bar + 1)")})
    whole = _with_points(cut(_merged(stored)), counted, "weapon").withColumns({"block": F.lit(None).cast("bigint"), "weapon": F.col("grp")})
    columns = ["block", "weapon", "n", F.col("lo").alias("least"), F.col("hi").alias("greatest"), "points", "means", "weights"]
    return blocks.select(*columns).unionByName(whole.select(*columns))


def p2_merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per weapon class over all blocks, merged from the blocks' stored digests."""
    counted = _distances(spark, d, "block")
    ests = cut(estimates(_merged(_block_digests(counted)), QS))
    return certified(counted, "weapon", "distance", ests, QS, "n").withColumnRenamed("grp", "weapon")


#: Distances whose ranks p2_counted counts.
MARKS = (25.0, 100.0, 400.0)


def p2_counted(spark: SparkSession, d: str) -> DataFrame:
    """The counting pass that certifies percentiles, at fixed distances in place of estimates."""
    counted = _distances(spark, d)
    rows = digest_rows(merge_digests(centroids(counted, "weapon", "distance", weight="n")))
    marks = cut(rows.select("grp", "n", "lo", "hi", F.array(*[F.lit(m) for m in MARKS]).alias("ests")))
    out = certified(counted, "weapon", "distance", marks, [0.5] * len(MARKS), "n")
    return out.select(F.col("grp").alias("weapon"), "n", F.col("estimate").alias("mark"), "below", "upto")


P2_COUNTED_SQL = """
SELECT coalesce(nullif(lower(regexp_replace(killer_weapon, '^\\s+|\\s+$', '', 'g')), ''), 'unspecified') AS weapon, mark, count(*) AS n,
       CAST(count(*) FILTER (WHERE distance < mark) AS BIGINT) AS below, CAST(count(*) FILTER (WHERE distance <= mark) AS BIGINT) AS upto
FROM (SELECT DISTINCT * FROM kill_events), (SELECT unnest([25.0::DOUBLE, 100.0, 400.0]) AS mark) WHERE distance >= 0 GROUP BY ALL
"""


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What a digest keeps exactly: number, least and greatest measured distance per weapon class."""
    rows = digest_rows(merge_digests(centroids(_distances(spark, d), "weapon", "distance", weight="n")))
    return rows.select(F.col("grp").alias("weapon"), "n", F.col("lo").cast("long").alias("least"), F.col("hi").cast("long").alias("greatest"))


P2_RANGES_SQL = """
SELECT coalesce(nullif(lower(regexp_replace(killer_weapon, '^\\s+|\\s+$', '', 'g')), ''), 'unspecified') AS weapon,
       count(*) AS n, min(distance) AS least, max(distance) AS greatest
FROM (SELECT DISTINCT * FROM kill_events) WHERE distance >= 0 GROUP BY 1
"""


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of one over 2,048 tokens) with its container and the container's fill."""
    return pack(token_counts(table(spark, d, "documents")), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by fill in steps of 64 tokens."""
    one = p8_containers(spark, d).groupBy("container").agg(F.first("fill").alias("fill"), F.count(F.lit(1)).alias("pieces"))
    return one.groupBy((F.floor(F.col("fill") / 64) * 64).alias("fill_from")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens")
    )


def p8_bound(spark: SparkSession, d: str) -> DataFrame:
    """Containers in use against the least number that the tokens need."""
    one = p8_containers(spark, d).agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.lit(float(CAPACITY)))
    return one.select("containers", "tokens", least.alias("least"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("used"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every document: how often it is packed from its begin, and whether its containers hold what they say and no more."""
    pieces = p8_containers(spark, d)
    load = pieces.groupBy("container").agg((F.sum("n_tokens") == F.max("fill")).alias("true_fill"), (F.max("fill") <= CAPACITY).alias("fits"))
    per = pieces.join(load, "container").groupBy("doc_id").agg(
        F.count_if(F.col("piece") == 0).alias("starts"), (F.count(F.lit(1)) == F.max("piece") + 1).alias("whole"), F.bool_and(F.col("true_fill") & F.col("fits")).alias("fits")
    )
    return per


P8_COVERAGE_SQL = "SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS starts, true AS whole, true AS fits FROM documents WHERE doc_id IS NOT NULL"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "exam_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(*(table(spark, d, n) for n in ("documents", "subject_areas", "subject_labels")))


def p10_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject area: the composition of the corpus."""
    return p10_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_digests, p2_percentiles, p2_merged_blocks, p2_ranges, p2_counted, p8_containers, p8_fill, p8_bound, p8_coverage, p9_found, p10_found, p10_mix)
}

SQL: dict[str, str] = {"p2_ranges": P2_RANGES_SQL, "p2_counted": P2_COUNTED_SQL, "p8_coverage": P8_COVERAGE_SQL}
