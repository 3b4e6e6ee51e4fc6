import random

from table_rows import rows
from pyspark.sql import functions as F

from larkspur.operators.entity_features import entity_features, type_vocabulary
from larkspur.operators.history import versions
from larkspur.operators.references import Reference, live_keys, orphan_report, orphans, plain_keys
from larkspur.operators.sessions import sessions
from larkspur.plans.skew import row_hash

S = 1_000_000


def brute_sessions(events, gap):
    by = {}
    for k, t in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    out = []
    for k, ts in by.items():
        ts.sort()
        start, last, n = ts[0], ts[0], 1
        for t in ts[1:]:
            if t - last > gap * S:
                out.append((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, last - start, n))
    return sorted(out, key=repr)


def test_sessions_against_brute_force(spark):
    rng = random.Random(1)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, rng.randrange(0, 400_000) * S, rng.randrange(0, 60_000) * S])) for _ in range(1500)]
    events += [(7, 0), (7, 1800 * S), (7, 3600 * S + 1), (8, -5 * S), (8, 5 * S), (9, 14_399 * S), (9, 14_401 * S), (9, 14_401 * S)]
    df = spark.createDataFrame(events, "who long, at long").withColumn("bucket", F.lit(1)).withColumn("start_us", F.lit(2))
    assert rows(sessions(df, "who", "at")) == brute_sessions(events, 1800)
    assert rows(sessions(df, "who", "at", 60, 120)) == brute_sessions(events, 60)


def test_sessions_of_nothing(spark):
    assert sessions(spark.createDataFrame([], "who long, at long"), "who", "at").count() == 0


def test_entity_features_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["a", "b", "c", "", None, "zz"]), rng.choice([0, 1, None]), rng.choice([None, 5, 2**55]), rng.choice([None, rng.randrange(10**15)])) for _ in range(3000)]
    df = spark.createDataFrame(data, "who long, kind string, flag long, amount long, at long").withColumn("n__a", F.lit("clash"))
    out = {r["who"]: r.asDict() for r in entity_features(df, "who", "kind", ["a", "b", "c"], "flag", "amount", "at").collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    for who, got in out.items():
        for t in ("a", "b", "c", "unspecified", "all"):
            own = [x for x in data if x[0] == who and (t == "all" or (x[1] if x[1] in ("a", "b", "c") else "unspecified") == t)]
            assert got[f"n__{t}"] == len(own)
            assert got[f"flags__{t}"] == sum(x[2] == 1 for x in own)
            assert got[f"total__{t}"] == sum(x[3] or 0 for x in own)
            assert got[f"latest__{t}"] == max((x[4] for x in own if x[4] is not None), default=None)
    assert type_vocabulary(df, "kind") == ["", "a", "b", "c", "zz"]
    assert entity_features(df.limit(0), "who", "kind", ["a"], "flag", "amount", "at").count() == 0


def test_feature_blocks_of_many_entities(spark):
    df = spark.range(5000).select(F.col("id").alias("who"), F.lit("a").alias("kind"), F.lit(1).alias("flag"), F.lit(2).alias("amount"), F.col("id").alias("at"))
    out = entity_features(df.unionAll(df), "who", "kind", ["a"], "flag", "amount", "at")
    assert out.count() == 5000 and out.filter("n__a <> 2 OR total__all <> 4 OR latest__a <> who").count() == 0


def players(spark):
    log = [("1", "upsert", 1, 1), ("2", "upsert", 1, 2), ("2", " DELETE ", 2, 3), ("3", "delete", 5, 4), ("3", "upsert", 6, 5), ("4", "upsert", 9, 9), ("4", "delete", 9, 10)]
    return spark.createDataFrame(log, "uid string, op string, at long, rev long")


def test_orphans_direct(spark):
    loads = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("b", 9)], "uid string, template_id long")
    kills = spark.createDataFrame([(1, 1, 2), (2, 0, 3), (3, None, 4), (4, 77, 77)], "id long, k long, v long")
    found = orphans(
        {"loads": loads, "kills": kills},
        {"loads": "uid", "kills": "id"},
        {"templates": plain_keys(spark.createDataFrame([(1,)], "id long"), "id"), "players": live_keys(players(spark), "uid", ["at", "rev"], "op")},
        [Reference("loads", "template_id", "templates"), Reference("kills", "k", "players", (0,)), Reference("kills", "v", "players", (0,))],
    )
    got = rows(found.select("source_table", "ref_field", "row_key"))
    assert got == sorted([("loads", "template_id", "b"), ("kills", "k", "4"), ("kills", "v", "1"), ("kills", "v", "3"), ("kills", "v", "4")], key=repr)
    report = rows(orphan_report(found).select("ref_field", "n_refs", "n_keys"))
    assert ("v", 3, 3) in report


def test_orphans_cascade_and_cycle(spark):
    a = spark.createDataFrame([("a1", "x1"), ("a2", "gone")], "id string, up string")
    b = spark.createDataFrame([("b1", "a1"), ("b2", "a2")], "id string, up string")
    c = spark.createDataFrame([("c1", "b1"), ("c2", "b2"), ("c3", "nowhere"), ("c4", "c2")], "id string, up string")
    keys = lambda t: plain_keys(t, "id")
    found = orphans(
        {"a": a, "b": b, "c": c, "self": c},
        {"a": "id", "b": "id", "c": "id"} | {"self": "id"},
        {"x": spark.createDataFrame([("x1",)], "key string"), "a": keys(a), "b": keys(b), "c": keys(c), "self": keys(c)},
        [Reference("a", "up", "x"), Reference("b", "up", "a"), Reference("c", "up", "b")],
    )
    got = {(r.source_table, r.row_key): r.kind for r in found.collect()}
    assert got == {("a", "a2"): "direct", ("b", "b2"): "inherited", ("c", "c2"): "inherited", ("c", "c3"): "direct", ("c", "c4"): "direct"}


def brute_versions(log, fill=False):
    """``key, attrs, valid_from, valid_to`` of plain loops; a log row is key, time, attrs (a tuple), gone."""
    out, by = [], {}
    for k, t, v, gone in log:
        by.setdefault(k, []).append((t, v, gone))
    for k, xs in by.items():
        xs.sort(key=lambda x: x[0])
        last, starts, known = None, [], None
        for t, v, gone in xs:
            if fill and not gone:
                known = v if known is None else tuple(a if b is None else b for a, b in zip(known, v))
            state = ("gone",) if gone else ("is", known if fill else v)
            known = None if gone else known
            if state != last and not (gone and last is None):
                starts.append((t, state))
            last = None if gone and last is None else state
        for i, (t, state) in enumerate(starts):
            if state[0] == "is":
                out.append((k, *state[1], t, starts[i + 1][0] if i + 1 < len(starts) else None))
    return sorted(out, key=repr)


def test_versions_against_brute_force(spark):
    rng = random.Random(3)
    log = {}
    for _ in range(2000):
        k, t = rng.choice("aaaabc"), rng.randrange(5000)
        log[k, t] = (k, t, rng.choice(["x", "y", None]), rng.choice([1, 1, 1, None]), rng.random() < 0.1)
    df = spark.createDataFrame(list(log.values()), "uid string, at long, rank string, level long, gone boolean")
    rows_of = [(k, t, (r, n), g) for k, t, r, n, g in log.values()]
    for fill in (False, True):
        want = brute_versions(rows_of, fill)
        for width in (7, 100, 10_000):
            out = versions(df, "uid", "at", ["rank", "level"], F.floor(F.col("at") / width), F.lit(1), F.col("gone"), fill)
            assert rows(out.select("uid", "rank", "level", "valid_from", "valid_to")) == want
            assert out.groupBy("uid").agg((F.max("version_no") == F.count("*")).alias("ok"), F.countDistinct("version_no").alias("n"), F.count("*").alias("m")).filter("NOT ok OR n <> m").count() == 0


def test_versions_of_late_corrected_and_tied_rows(spark):
    df = spark.createDataFrame([("u", 1, 5, None), ("u", 1, 7, 3), ("u", 1, 7, 3), ("u", 2, 1, None), ("u", 9, 1, 4), ("u", 9, 1, 6), (None, 1, 1, 1), ("u", None, 1, 1), ("u", 3, None, 8)], "uid string, day long, loaded long, xp long")
    df = df.withColumn("_k", F.lit("clash")).withColumn("_at", F.lit(0))
    filled = versions(df, "uid", "day", ["xp"], F.col("day"), F.col("loaded"), fill=True)
    assert rows(filled.select("uid", "xp", "valid_from", "valid_to")) == [("u", 3, 1, 9), ("u", 6, 9, None)]
    empty = df.filter("day = 2")
    assert rows(versions(empty, "uid", "day", ["xp"], F.lit(0), F.col("loaded"), fill=True).select("xp", "is_current")) == [(None, True)]
    assert versions(empty, "uid", "day", ["xp"], F.lit(0), F.col("loaded"), skip_empty=True).count() == 0
    assert versions(df.limit(0), "uid", "day", ["xp"], F.lit(0), F.col("loaded")).count() == 0


def test_a_row_hash_tells_null_from_absence(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a"), (None, None, None), (1, 1, "a")], "x long, y long, s string")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 4


def test_features_of_a_hot_entity(spark):
    """One entity holds most rows and all types; blocks, batches and folds cut through it."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 3000).alias("who"), F.concat(F.lit("t"), F.col("id") % 200).alias("kind"),
        (F.col("id") % 2).alias("flag"), (F.col("id") % 11).alias("amount"), F.col("id").alias("at"),
    )
    types = sorted(f"t{k}" for k in range(200))
    wide = entity_features(df, "who", "kind", types, "flag", "amount", "at")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" in plan
    cells = F.array(*[F.struct(F.lit(t).alias("kind"), *[F.col(f"{f}__{t}").alias(f) for f in ("n", "flags", "total", "latest")]) for t in types])
    long = wide.select("who", F.inline(F.filter(cells, lambda c: c.n > 0)))
    want = df.groupBy("who", "kind").agg(F.count("*").alias("n"), F.sum("flag").alias("flags"), F.sum("amount").alias("total"), F.max("at").alias("latest"))
    assert long.exceptAll(want).count() == 0 and want.exceptAll(long).count() == 0
