"""Queries of writes, constraints, rules, the expression language and joins beyond SQL, with oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import exprs, script
from larkspur.operators import boards, dml, fuzzy, relational
from larkspur.operators.recursion import recursive_distinct
from larkspur.sources.tables import table
from larkspur.streaming import windows


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """New versions of all large parts and as many parts that are not there yet."""
    x = _parts(spark, d).filter("p_size > 40")
    return x.withColumn("p_size", F.col("p_size") + 100).unionAll(x.withColumn("p_partkey", F.col("p_partkey") + 1_000_000))


_OLD = "old AS (SELECT p_partkey, p_name, p_size FROM part)"
_NEW = "new AS (SELECT p_partkey, p_name, p_size + 100 AS p_size FROM old WHERE p_size > 40 UNION ALL SELECT p_partkey + 1000000, p_name, p_size FROM old WHERE p_size > 40)"


def insert_select(spark, d):
    return dml.insert(_parts(spark, d), _changes(spark, d).filter("p_partkey >= 1000000"))


def insert_ignore(spark, d):
    return dml.insert_ignore(_parts(spark, d), _changes(spark, d), ["p_partkey"])


def replace_into(spark, d):
    return dml.replace_into(_parts(spark, d), _changes(spark, d), ["p_partkey"])


def upsert_update(spark, d):
    return dml.upsert(_parts(spark, d), _changes(spark, d), ["p_partkey"], {"p_size": "p_size * 2 + excluded.p_size"})


def update_where(spark, d):
    return dml.update(_parts(spark, d), {"p_size": "p_size + 1", "p_name": "upper(p_name)"}, "p_size > 25")


def delete_where(spark, d):
    return dml.delete(_parts(spark, d), "p_size > 25 OR nullif(p_size, 3) IS NULL")


def delete_using(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return dml.delete_using(_parts(spark, d), supplier, ["p_partkey"])


def merge_all(spark, d):
    return dml.merge(
        _parts(spark, d), _changes(spark, d), ["p_partkey"], {"p_size": "s.p_size"}, "t.p_size < 45", {"p_partkey": "s.p_partkey", "p_name": "'new'", "p_size": "s.p_size"}
    )


def returning_update(spark, d):
    hit = dml.affected(_parts(spark, d), "p_size = 7")
    return dml.update(hit, {"p_size": "p_size * 10"}).select("p_partkey", "p_size")


def unique_violations(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return dml.duplicate_keys(x, ["l_orderkey", "l_linenumber"])


def null_violations(spark, d):
    return dml.null_violations(table(spark, d, "kill_events"), ["killer_uid", "killer_weapon"]).select("id").distinct()


def check_violations(spark, d):
    return dml.check_violations(table(spark, d, "part"), "p_size BETWEEN 5 AND 45").select("p_partkey")


def fk_violations(spark, d):
    return dml.fk_violations(table(spark, d, "player_loadouts"), "template_id", table(spark, d, "loadout_templates"), "id").select("uid", "template_id").distinct()


def fk_cascade_delete(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 3")
    return dml.cascade_delete(table(spark, d, "orders"), "o_custkey", gone, "c_custkey").select("o_orderkey")


def fk_set_null(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 3")
    x = dml.cascade_set_null(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")
    return x.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


def auto_increment(spark, d):
    x = table(spark, d, "supplier").select(F.lit(None).cast("long").alias("id"), "s_suppkey")
    return dml.number_rows(x, "id", 500, ["s_suppkey"])


def recursive_reach(spark, d):
    """Nations reachable from nation 0 by two arithmetic edges (a cyclic graph)."""
    n = table(spark, d, "nation").select("n_nationkey")
    edges = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b")).unionAll(n.select("n_nationkey", (F.col("n_nationkey") * 7) % 25))
    seed = n.filter("n_nationkey = 1").select(F.col("n_nationkey").alias("k"))
    return recursive_distinct(seed, lambda front: front.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k")))


def fuzzy_join(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    other = names.select(F.concat(F.col("p_name"), F.lit("s")).alias("t"))
    return fuzzy.fuzzy_join(names, "p_name", "p_name", other, "t", "t", 0.5).select("left_key", "right_key", F.round("score", 6).alias("score"))


def range_join(spark, d):
    bands = spark.createDataFrame([(k, k * 10_000.0, k * 10_000.0 + 15_000.0) for k in range(40)], "band long, lo double, hi double")
    x = relational.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "lo", "hi", 10_000)
    return x.select("o_orderkey", "band")


def asof_join(spark, d):
    """For each purchase the user's last view before or at it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    bought = e.filter("event_type = 'purchase'").drop("event_type")
    x = relational.asof_join(bought, views, "user_id", "ts", ["view_id"], bucket=F.date_trunc("day", "_at"))
    return x.select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


def first_value_per_key(spark, d):
    x = relational.distinct_on(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return x.select("o_custkey", "o_orderkey")


def groups_frame_api(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return relational.with_groups_frame(x, "n", F.count(F.lit(1)), ["p_brand"], [F.col("p_size").desc()], -2, 0).select("p_partkey", "n")


def count_distinct_null(spark, d):
    x = table(spark, d, "kill_events").groupBy("server_id")
    return x.agg(relational.count_distinct_with_null(F.col("killer_uid")).alias("n"))


def glob_match(spark, d):
    return table(spark, d, "part").filter(exprs.glob_match(F.col("p_name"), "*r?ng")).select("p_partkey", "p_name")


def two_valued_logic(spark, d):
    k = table(spark, d, "kill_events")
    return k.filter(exprs.ne2(F.col("killer_uid"), F.col("victim_uid")) & ~exprs.lt2(F.col("distance"), F.lit(50))).select("id").distinct()


def date_modifiers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", exprs.shift(F.col("ts"), "+3 days", "-2 hours", "+1 month").alias("t"))


def date_percent_format(spark, d):
    return table(spark, d, "events").select("event_id", exprs.date_format_percent(F.col("ts"), "%d.%m.%Y at %H:%M:%S").alias("f"))


def char_codes(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", exprs.char_codes(F.col("n_nationkey") + 65, F.lit(8364)).alias("c"))


def sqf_math(spark, d):
    e = "sqrt (abs (_x - 25)) + (sin (rad _x)) * 2 + (_x min 10) * (_x max 3) - floor (_x / 4) % 3"
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return x.select("p_partkey", F.round(script.column(e, {"_x": F.col("x")}), 6).alias("v"))


def sqf_string(spark, d):
    x = table(spark, d, "part")
    up, at = script.column("toUpper _n", {"_n": F.col("p_name")}), script.column("_n find 'ring'", {"_n": F.col("p_name")})
    return x.select("p_partkey", up.alias("u"), at.cast("long").alias("at"))


def sqf_array(spark, d):
    v = {"_v": F.col("embedding")}
    x = table(spark, d, "embeddings")
    return x.select("vec_id", F.round(script.column("vectorMagnitude _v", v), 4).alias("m"), F.round(script.column("_v select 2", v).cast("double"), 5).alias("e2"), script.column("count _v", v).cast("long").alias("n"))


def sqf_eval_column(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("1 + 2 * "), F.col("n_nationkey").cast("string")).alias("e"))
    return x.select("n_nationkey", script.evaluate_column(F.col("e")).cast("double").alias("v"))


def highest_rank(spark, d):
    ranks = ["private", "corporal", "sergeant", "lieutenant", "captain", "major", "colonel"]
    x = table(spark, d, "players").withColumn("rank", F.lower(F.regexp_replace("rank", r"^\s+|\s+$", ""))).filter("rank <> ''")
    return boards.highest_of(x, "uid", "rank", ranks)


def _rules(spark):
    rules = [
        (1, 1, 10, "all", None, "mul", "2"), (2, 1, 5, "wildcard", "*ring", "add", "3"), (3, 1, 5, "exact", "steel bolt,blue gear", "set", "7"),
        (4, 1, 1, "regex", "^small", "clamp", "10|40"), (5, 0, 99, "all", None, "set", "0"),
    ]
    return spark.createDataFrame(rules, "id long, active int, priority int, match_type string, match_value string, operator string, value string")


def patch_rules_apply(spark, d):
    x = boards.patched(_parts(spark, d), "p_partkey", "p_name", "p_size", _rules(spark))
    return x.select("p_partkey", F.col("patched").cast("double").alias("v"), "n_rules")


def value_operators(spark, d):
    x = _parts(spark, d)
    v = F.col("p_size").cast("string")
    one = lambda op, arg: boards.apply_operator(v, F.lit(op), F.lit(arg)).cast("double")
    return x.select("p_partkey", one("add", "2.5").alias("a"), one("div", "0").alias("z"), one("mod", "7").alias("m"), one("clamp", "10|20").alias("c"), one("negate", "").alias("n"))


def events_deduplicated(spark, d):
    return windows.deduplicated(table(spark, d, "events"), "ts", ["user_id", "event_type"], "1 day").groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"))


def approx_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg((F.abs(F.approx_count_distinct("user_id", 0.01) / F.count_distinct("user_id") - 1) < 0.05).alias("close"))


_SIM = "(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"
_TG = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: substr('  ' || lower({0}) || '  ', i, 3)))"

SQL: dict[str, str] = {
    "insert_select": "SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey + 1000000, p_name, p_size FROM part WHERE p_size > 40",
    "insert_ignore": f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE p_partkey NOT IN (SELECT p_partkey FROM old)",
    "replace_into": f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE p_partkey NOT IN (SELECT p_partkey FROM new) UNION ALL SELECT * FROM new",
    "upsert_update": f"WITH {_OLD}, {_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.p_name, n.p_name) AS p_name, CASE WHEN n.p_partkey IS NULL THEN o.p_size WHEN o.p_partkey IS NULL THEN n.p_size ELSE o.p_size * 2 + n.p_size END AS p_size FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey",
    "update_where": "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size FROM part",
    "delete_where": "SELECT p_partkey, p_name, p_size FROM part WHERE NOT (p_size > 25 OR p_size = 3)",
    "delete_using": "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    "merge_all": f"WITH {_OLD}, {_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'new' ELSE o.p_name END AS p_name, coalesce(n.p_size, o.p_size) AS p_size FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey WHERE NOT (o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL AND o.p_size < 45)",
    "returning_update": "SELECT p_partkey, p_size * 10 AS p_size FROM part WHERE p_size = 7",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "null_violations": "SELECT DISTINCT id FROM kill_events WHERE killer_uid IS NULL OR killer_weapon IS NULL",
    "check_violations": "SELECT p_partkey FROM part WHERE NOT p_size BETWEEN 5 AND 45",
    "fk_violations": "SELECT DISTINCT uid, template_id FROM player_loadouts WHERE template_id IS NOT NULL AND template_id NOT IN (SELECT id FROM loadout_templates)",
    "fk_cascade_delete": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "fk_set_null": "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN -1 ELSE o_custkey END AS o_custkey FROM orders",
    "auto_increment": "SELECT 500 + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey FROM supplier",
    "recursive_reach": "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT e.b FROM r JOIN (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7) % 25 FROM nation) e ON r.k = e.a) SELECT k FROM r",
    "fuzzy_join": f"WITH n AS (SELECT DISTINCT p_name AS a FROM part), s AS (SELECT a, b, {_SIM.format(x=_TG.format('a'), y=_TG.format('b'))} AS score FROM n, (SELECT a || 's' AS b FROM n)) SELECT a AS left_key, b AS right_key, round(score, 6) AS score FROM s WHERE score >= 0.5",
    "range_join": "SELECT o_orderkey, range AS band FROM orders JOIN range(0, 40) ON o_totalprice >= range * 10000 AND o_totalprice < range * 10000 + 15000",
    "asof_join": "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) SELECT p.event_id, coalesce(v.view_id, -1) AS view_id FROM events p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'",
    "first_value_per_key": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "groups_frame_api": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part",
    "count_distinct_null": "SELECT server_id, count(DISTINCT killer_uid) + CAST(count(*) > count(killer_uid) AS BIGINT) AS n FROM kill_events GROUP BY server_id",
    "glob_match": "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*r?ng'",
    "two_valued_logic": "SELECT DISTINCT id FROM kill_events WHERE NOT coalesce(killer_uid = victim_uid, false) AND NOT coalesce(distance < 50, false)",
    "date_modifiers": "SELECT event_id, ts + INTERVAL '3' DAY - INTERVAL '2' HOUR + INTERVAL '1' MONTH AS t FROM events",
    "date_percent_format": "SELECT event_id, strftime(ts, '%d.%m.%Y at %H:%M:%S') AS f FROM events",
    "char_codes": "SELECT n_nationkey, chr(n_nationkey + 65) || chr(8364) AS c FROM nation",
    "sqf_math": "SELECT p_partkey, round(sqrt(abs(p_size - 25)) + sin(radians(p_size)) * 2 + least(p_size, 10) * greatest(p_size, 3) - floor(p_size / 4) % 3, 6) AS v FROM part",
    "sqf_string": "SELECT p_partkey, upper(p_name) AS u, CAST(instr(p_name, 'ring') - 1 AS BIGINT) AS at FROM part",
    "sqf_array": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS m, round(CAST(embedding[3] AS DOUBLE), 5) AS e2, CAST(len(embedding) AS BIGINT) AS n FROM embeddings",
    "sqf_eval_column": "SELECT n_nationkey, CAST(1 + 2 * n_nationkey AS DOUBLE) AS v FROM nation",
    "highest_rank": "WITH r AS (SELECT uid, lower(regexp_replace(rank, '^\\s+|\\s+$', '', 'g')) AS rank FROM players) SELECT uid, arg_max(rank, list_position(['private', 'corporal', 'sergeant', 'lieutenant', 'captain', 'major', 'colonel'], rank)) AS highest FROM r WHERE rank <> '' GROUP BY uid",
    "patch_rules_apply": "WITH a AS (SELECT p_partkey, p_name, p_size * 2.0 AS v FROM part), b AS (SELECT *, CASE WHEN p_name LIKE '%ring' THEN v + 3 ELSE v END AS w FROM a), c AS (SELECT *, CASE WHEN p_name IN ('steel bolt', 'blue gear') THEN 7.0 ELSE w END AS x FROM b) SELECT p_partkey, CAST(CASE WHEN p_name LIKE 'small%' THEN least(greatest(x, 10), 40) ELSE x END AS DOUBLE) AS v, 1 + CAST(p_name LIKE '%ring' AS BIGINT) + CAST(p_name IN ('steel bolt', 'blue gear') AS BIGINT) + CAST(p_name LIKE 'small%' AS BIGINT) AS n_rules FROM c",
    "value_operators": "SELECT p_partkey, CAST(p_size + 2.5 AS DOUBLE) AS a, 0.0::DOUBLE AS z, CAST(p_size % 7 AS DOUBLE) AS m, CAST(least(greatest(p_size, 10), 20) AS DOUBLE) AS c, CAST(-p_size AS DOUBLE) AS n FROM part",
    "events_deduplicated": "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "approx_users": "SELECT event_type, true AS close FROM events GROUP BY event_type",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in SQL}
