"""Mergeable percentile digests with a certified rank error.

A digest is a list of centroids (mean, weight) sorted by mean.  Sorted values
are clustered under the size function ``k(q) = delta * (asin(2q - 1) / pi + 1/2)``:
a cluster may span at most one unit of ``k``, which makes clusters small near
both ends and at most ``delta + 1`` in number.  Digests merge by clustering the
union of their centroids again, so partitions, files and days combine in any
order.  A second pass counts, for every estimate, the values below and up to it
and so certifies the true rank error, whatever the clustering did.

Skew: every partition folds its own rows first, so a group that holds a third
of all rows leaves a partition as at most ``delta + 1`` centroids; these merge
in two levels, salted by the partition they come from.  All groups of a
partition are clustered at once, as they stream by in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.materialize import cut
from larkspur.plans.ship import ship

#: Up to so many groups, the estimates are broadcast to the counting pass; beyond, they join by shuffle.
BROADCAST_GROUPS = 50_000
#: Rows held by a task before they are clustered.
FOLD_ROWS = 500_000
_SALTS = 64
_CENTROIDS = "mean double, weight long, lo double, hi double"


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: int) -> tuple[np.ndarray, ...]:
    """Cluster the centroids of all groups at once; returns the same five arrays, sorted by group and mean."""
    if not len(mean):
        return group, mean, weight, lo, hi
    order = np.lexsort((mean, group))
    group, mean, weight, lo, hi = (x[order] for x in (group, mean, weight, lo, hi))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    upto = np.cumsum(weight)
    before = np.repeat(upto[starts] - weight[starts], sizes)
    total = np.repeat(upto[starts + sizes - 1] - (upto[starts] - weight[starts]), sizes)
    q = (upto - before - weight / 2.0) / total
    k = np.floor(delta * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
    # Equal values stay together where they meet: splitting them would tell nothing.
    at = np.flatnonzero(new)
    w = np.add.reduceat(weight, at)
    m = np.add.reduceat(mean * (weight / np.repeat(w, np.diff(np.append(at, len(mean))))), at)
    low, high = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    return group[at], np.clip(m, low, high), w, low, high


def _emit(keys: list[pa.Array], group: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, names: list[str]) -> pa.RecordBatch:
    at = pa.array(group)
    return pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], *map(pa.array, (mean, weight, lo, hi))], names=[*names, "mean", "weight", "lo", "hi"])


def stated_bound(q: float, n: int, delta: int = 400, levels: int = 4) -> float:
    """Rank error that an estimate should stay under: a cluster spans ``pi / delta * sqrt(q (1 - q))`` of the ranks at
    ``q`` (and at the ends no more than ``(pi / delta) ** 2``), every level of merging adds as much, and a rank is a whole number.
    """
    unit = np.pi / delta
    return float(levels * (unit * np.sqrt(q * (1 - q)) + unit**2) + 1 / max(1, n))


def centroids(df: DataFrame, group: str, value: str, delta: int = 400, weight: str | None = None) -> DataFrame:
    """Per-partition centroids ``grp, mean, weight, lo, hi``: the map side of a digest, without a shuffle.

    Null and NaN values and null groups take no part.
    """
    ship(df.sparkSession)
    c = F.col
    slim = df.select(
        c(f"`{group}`").cast("string").alias("grp"),
        c(f"`{value}`").cast("double").alias("v"),
        (c(f"`{weight}`") if weight else F.lit(1)).cast("long").alias("w"),
    ).filter("grp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND w > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        names: list[str] = []
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            local = np.array([codes.setdefault(n, len(codes)) for n in part.dictionary.to_pylist()], np.int64)
            names += list(codes)[len(names) :]
            if not len(local):
                continue
            g = local[part.indices.to_numpy(zero_copy_only=False)]
            v = batch.column(1).to_numpy(zero_copy_only=False)
            held.append((g, v, batch.column(2).to_numpy(zero_copy_only=False), v, v))
            rows += len(v)
            if rows > FOLD_ROWS:
                held = [cluster(*(np.concatenate(x) for x in zip(*held)), delta)]
                rows = len(held[0][0])
        if held:
            yield _emit([pa.array(names, pa.string())], *cluster(*(np.concatenate(x) for x in zip(*held)), delta), ["grp"])

    return slim.mapInArrow(run, "grp string, " + _CENTROIDS)


def _recluster(df: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """Cluster the centroids of each group; a task holds ``FOLD_ROWS`` rows, a batch and what is left of one group."""
    names = ["mean", "weight", "lo", "hi"]

    def fold(held: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables(held).combine_chunks()
        # Groups lie together, so a new one begins where a key changes.
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in keys:
            c = t[k].combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        x = [t[n].combine_chunks().to_numpy(zero_copy_only=False) for n in names]
        group, *out = cluster(np.cumsum(new) - 1, *x, delta)
        heads = [t[k].combine_chunks().take(pa.array(np.flatnonzero(new))) for k in keys]
        return pa.Table.from_batches([_emit(heads, group, *out, keys)]), group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows > FOLD_ROWS:
                out, group = fold(held)
                # The last group may go on.
                end = int(np.searchsorted(group, group[-1]))
                yield from out.slice(0, end).to_batches()
                held = [out.slice(end)]
                rows = len(held[0])
        if held:
            yield from fold(held)[0].to_batches()

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, {_CENTROIDS}")


def merge_digests(parts: DataFrame, delta: int = 400) -> DataFrame:
    """One digest per ``grp`` from centroid rows of any number of partitions, files or days.

    Two levels: a task meets at most ``delta + 1`` centroids from each of 1/64 of
    the sources, then of 64 merged digests.
    """
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    return _recluster(_recluster(salted, ["grp", "salt"], delta).drop("salt"), ["grp"], delta)


def digest_rows(merged: DataFrame) -> DataFrame:
    """Storable form: one row per group with ``n, lo, hi, means, weights`` (sorted by mean)."""
    cells = F.array_sort(F.collect_list(F.struct("mean", "weight", "lo", "hi")))
    x = merged.groupBy("grp").agg(F.sum("weight").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), cells.alias("c"))
    return x.select("grp", "n", "lo", "hi", F.col("c.mean").alias("means"), F.col("c.weight").alias("weights"))


def centroid_rows(stored: DataFrame) -> DataFrame:
    """Centroid rows of stored digests, to be merged with others."""
    x = stored.select("grp", "lo", "hi", F.posexplode(F.arrays_zip("means", "weights")).alias("i", "c"), F.size("means").alias("k"))
    return x.select(
        "grp",
        F.col("c.means").alias("mean"),
        F.col("c.weights").alias("weight"),
        F.when(F.col("i") == 0, F.col("lo")).otherwise(F.col("c.means")).alias("lo"),
        F.when(F.col("i") == F.col("k") - 1, F.col("hi")).otherwise(F.col("c.means")).alias("hi"),
    )


def estimates(stored: DataFrame, qs: Sequence[float]) -> DataFrame:
    """``grp, n, lo, hi, ests`` (one estimate per entry of ``qs``), interpolated between centroid middles."""
    ship(stored.sparkSession)
    points = np.asarray(qs, float)
    if len(points) == 0 or points.min() < 0 or points.max() > 1:
        raise ValueError("quantiles must lie between 0 and 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, lo, hi, means, weights in zip(*[b.column(i).to_pylist() for i in (1, 2, 3, 4, 5)]):
                w = np.asarray(weights, float)
                middle = np.cumsum(w) - w / 2
                out.append(np.interp(points * n, np.r_[0, middle, n], np.r_[lo, means, hi]).tolist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(out, pa.list_(pa.float64()))], names=["grp", "n", "lo", "hi", "ests"])

    return stored.mapInArrow(run, "grp string, n long, lo double, hi double, ests array<double>")


def certified(df: DataFrame, group: str, value: str, ests: DataFrame, qs: Sequence[float], weight: str | None = None) -> DataFrame:
    """``grp, n, q, estimate, below, upto, rank_error`` from an exact counting pass over ``df``.

    ``below`` and ``upto`` are the numbers of values under and not over the
    estimate; ``rank_error`` is the distance of ``q`` from that rank interval as
    a share of ``n``, so the estimate is an exact quantile of some rank within it.
    ``ests`` must be settled (``cut``): it is counted to choose the join.
    """
    c = F.col
    values = df.select(
        c(f"`{group}`").cast("string").alias("grp"),
        c(f"`{value}`").cast("double").alias("v"),
        (c(f"`{weight}`") if weight else F.lit(1)).cast("long").alias("w"),
    ).filter("grp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND w > 0")
    side = ests.select("grp", "ests")
    joined = values.join(F.broadcast(side) if ests.count() <= BROADCAST_GROUPS else side, "grp")
    sums = []
    for i in range(len(qs)):
        sums += [
            F.sum(F.when(c("v") < c("ests")[i], c("w")).otherwise(0)).alias(f"b{i}"),
            F.sum(F.when(c("v") <= c("ests")[i], c("w")).otherwise(0)).alias(f"u{i}"),
        ]
    counted = joined.groupBy("grp").agg(*sums).join(ests, "grp")
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), c("ests")[i].alias("estimate"), c(f"b{i}").alias("below"), c(f"u{i}").alias("upto")) for i, q in enumerate(qs)])
    x = counted.select("grp", "n", F.inline(rows))
    error = F.greatest(F.lit(0.0), c("below") / c("n") - c("q"), c("q") - c("upto") / c("n"))
    return x.withColumn("rank_error", error)


def percentiles(df: DataFrame, group: str, value: str, qs: Sequence[float], delta: int = 400, weight: str | None = None) -> DataFrame:
    """Percentiles per group with their certified rank error; see ``certified`` for the columns."""
    stored = digest_rows(merge_digests(centroids(df, group, value, delta, weight), delta))
    ests = cut(estimates(stored, qs))
    return certified(df, group, value, ests, qs, weight)
