import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import digest
from larkspur.plans.materialize import cut

QS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def frame(spark):
    rng = random.Random(4)
    data = [("hot", rng.lognormvariate(3, 2)) for _ in range(20_000)] + [("ties", float(rng.choice([1, 1, 1, 2, 900]))) for _ in range(3000)]
    data += [("one", 7.0), (None, 1.0), ("none", None), ("nan", float("nan")), ("neg", -5.0), ("neg", 5.0)]
    return spark.createDataFrame(data, "g string, v double").repartition(9), data


def test_certified_error_is_true_and_small(spark):
    df, data = frame(spark)
    out = digest.percentiles(df, "g", "v", QS).collect()
    assert {r.grp for r in out} == {"hot", "ties", "one", "neg"}
    for r in out:
        own = np.sort([v for g, v in data if g == r.grp])
        assert (r.n, r.below, r.upto) == (len(own), (own < r.estimate).sum(), (own <= r.estimate).sum())
        assert r.rank_error == max(0.0, r.below / r.n - r.q, r.q - r.upto / r.n)
        assert r.rank_error <= (0.005 if r.grp == "hot" else 0.51)
        assert own[0] <= r.estimate <= own[-1]


def test_merging_is_like_one_digest(spark):
    df, data = frame(spark)
    days = df.withColumn("day", F.pmod(F.hash("v"), F.lit(5)))
    stored = [digest.digest_rows(digest.merge_digests(digest.centroids(days.filter(F.col("day") == k), "g", "v"))) for k in range(5)]
    parts = None
    for s in stored:
        rows = digest.centroid_rows(s)
        parts = rows if parts is None else parts.unionByName(rows)
    merged = digest.digest_rows(digest.merge_digests(parts))
    whole = {r.grp: r for r in digest.digest_rows(digest.merge_digests(digest.centroids(df, "g", "v"))).collect()}
    for r in merged.collect():
        assert (r.n, r.lo, r.hi) == (whole[r.grp].n, whole[r.grp].lo, whole[r.grp].hi) and len(r.means) <= 402
    ests = cut(digest.estimates(merged, QS))
    worst = digest.certified(df, "g", "v", ests, QS).filter("grp = 'hot'").agg(F.max("rank_error")).first()[0]
    assert worst <= 0.005


def test_weights_and_empty(spark):
    df, _ = frame(spark)
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    a = {(r.grp, r.q): r.n for r in digest.percentiles(counted, "g", "v", (0.5,), weight="n").collect()}
    assert a["ties", 0.5] == 3000
    assert digest.percentiles(df.limit(0), "g", "v", (0.5,)).count() == 0


def test_estimates_stay_under_the_stated_bound(spark):
    df, data = frame(spark)
    for r in digest.percentiles(df.filter("g = 'hot'"), "g", "v", QS).collect():
        assert r.rank_error <= digest.stated_bound(r.q, r.n)


def test_many_groups_merge_as_they_stream_by(spark, monkeypatch):
    monkeypatch.setattr(digest, "FOLD_ROWS", 300)
    df = spark.range(60_000).select(F.concat(F.lit("g"), F.col("id") % 37).alias("g"), (F.col("id") / 37).alias("v")).repartition(11)
    out = digest.percentiles(df, "g", "v", (0.25, 0.5), delta=50).collect()
    assert len(out) == 74 and all(r.n in (1621, 1622) and r.rank_error <= digest.stated_bound(r.q, r.n, 50, 8) for r in out)
