"""Queries p1 and p3 to p7: general operators over the game tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.entity_features import entity_features, type_vocabulary
from larkspur.operators.history import version_starts, versions
from larkspur.operators.references import Reference, live_keys, orphan_report, orphans, plain_keys
from larkspur.operators.sessions import sessions
from larkspur.operators.shredding import gear_items
from larkspur.operators.timestamps import instants, with_utc_micros
from larkspur.plans.skew import row_hash
from larkspur.sources.tables import table

#: Inactivity that ends a sitting.
GAP_SECONDS = 1800
#: The four text fields of mixed timestamps: table, key, field.
STAMPED = [
    ("kill_events", "id", "ts"),
    ("session_stats", "uid", "last_seen"),
    ("server_commands", "id", "created_at"),
    ("player_blobs", "player_uid", "saved_at"),
]
#: The three text fields of gear trees: table, key, field.
GEAR = [
    ("loadout_templates", "id", "loadout_data"),
    ("player_loadouts", "uid", "custom_data"),
    ("player_blobs", "player_uid", "blob"),
]


def _weapon() -> Column:
    return F.lower(F.regexp_replace("killer_weapon", r"^\s+|\s+$", ""))


def _named_killer() -> Column:
    return F.col("killer_uid").isNotNull() & (F.col("killer_uid") != 0)


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per killer (0, the machine, included): per weapon class and over all, kills, headshots, summed distance, latest time."""
    raw = table(spark, d, "kill_events")
    types = [t for t in type_vocabulary(raw.select(_weapon().alias("w")).distinct(), "w") if t]
    # Repeated rows drop out by what is needed of them and a hash of the whole row, so only seven narrow columns travel.
    kills = raw.withColumn("row_hash", row_hash(raw)).filter("killer_uid IS NOT NULL")
    kills = with_utc_micros(kills, "ts", "utc_us", table(spark, d, "game_servers"))
    metres = F.when(F.col("distance") >= 0, F.col("distance")).alias("distance")
    kills = kills.select("id", "row_hash", "killer_uid", _weapon().alias("killer_weapon"), "headshot", metres, "utc_us").distinct()
    return entity_features(kills, "killer_uid", "killer_weapon", types, "headshot", "distance", "utc_us")


def p1_type_totals(spark: SparkSession, d: str) -> DataFrame:
    """The features of p1 that need no clock, back in long form (one row per killer but 0 and class with kills)."""
    wide = p1_features(spark, d).filter(_named_killer())
    types = [c[3:] for c in wide.columns if c.startswith("n__")]
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("weapon"), *[F.col(f"`{f}__{t}`").alias(f) for f in ("n", "flags", "total")])
            for t in types
        ]
    )
    long = wide.select("killer_uid", F.inline(F.filter(cells, lambda s: s.n > 0)))
    return long.select("killer_uid", "weapon", "n", F.col("flags").alias("headshots"), F.col("total").alias("metres"))


P1_TYPE_TOTALS_SQL = """
WITH k AS (SELECT DISTINCT * FROM kill_events),
w AS (SELECT killer_uid, coalesce(nullif(lower(regexp_replace(killer_weapon, '^\\s+|\\s+$', '', 'g')), ''), 'unspecified') AS weapon,
             headshot, CASE WHEN distance >= 0 THEN distance END AS metres
      FROM k WHERE killer_uid <> 0)
SELECT killer_uid, coalesce(weapon, 'all') AS weapon, count(*) AS n,
       CAST(count(*) FILTER (WHERE headshot = 1) AS BIGINT) AS headshots, CAST(coalesce(sum(metres), 0) AS BIGINT) AS metres
FROM w GROUP BY GROUPING SETS ((killer_uid, weapon), (killer_uid))
"""


def p1_event_features(spark: SparkSession, d: str) -> DataFrame:
    """The operator of p1 over another log (events of users), back in long form with the latest times."""
    log = table(spark, d, "events").select("user_id", "event_type", F.lit(1).alias("flag"), F.floor("value").alias("whole"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    types = type_vocabulary(log, "event_type")
    wide = entity_features(log, "user_id", "event_type", types, "flag", "whole", "at")
    cells = F.array(*[F.struct(F.lit(t).alias("event_type"), *[F.col(f"`{f}__{t}`").alias(f) for f in ("n", "flags", "total", "latest")]) for t in [*types, "all"]])
    return wide.select("user_id", F.inline(F.filter(cells, lambda s: s.n > 0)))


P1_EVENT_FEATURES_SQL = """
SELECT user_id, coalesce(event_type, 'all') AS event_type, count(*) AS n, count(*) AS flags, CAST(sum(floor(value)) AS BIGINT) AS total, max(epoch_us(ts)) AS latest
FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))
"""


def _timed_kills(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "kill_events")
    kills = raw.select("id", "ts", "killer_uid", "server_id", row_hash(raw).alias("row_hash")).filter(_named_killer())
    timed = with_utc_micros(kills, "ts", "utc_us", table(spark, d, "game_servers")).filter("utc_us IS NOT NULL")
    return timed.select("killer_uid", "utc_us", "id", "row_hash").distinct()


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sittings of every killer with start, end, duration and number of kills."""
    return sessions(_timed_kills(spark, d), "killer_uid", "utc_us", GAP_SECONDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sessions(spark, d).select("killer_uid", "start_us", "end_us")


def p3_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The operator of p3 over another log: visits of users, ended by six hours without an event."""
    log = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sessions(log, "user_id", "at", 6 * 3600, 86_400)


P3_EVENT_SESSIONS_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600000000 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS no FROM n)
SELECT user_id, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events FROM g GROUP BY user_id, no
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [(name, table(spark, d, name), key, field) for name, key, field in STAMPED]
    return instants(fields, table(spark, d, "game_servers"))


#: References of problem 5.
REFERENCES = [
    Reference("player_loadouts", "template_id", "loadout_templates"),
    Reference("kill_events", "killer_uid", "players", (0,)),
    Reference("kill_events", "victim_uid", "players", (0,)),
]
#: References further down: a stored blob goes with its player's loadout, a player's statistics with the player.
CHAINED = [Reference("player_blobs", "player_uid", "player_loadouts"), Reference("session_stats", "uid", "players", (0,))]


#: Servers of p4_event_times: id, zone, date order.
_CLOCKS = [(0, "UTC", "dmy"), (1, "Asia/Kolkata", "dmy"), (2, "Europe/Berlin", "dmy"), (3, "America/New_York", "mdy")]


def p4_event_times(spark: SparkSession, d: str) -> DataFrame:
    """The operator of p4 over the events' times, written in six ways on four servers' clocks."""
    written = F.when(F.col("event_id") % 6 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    forms = ("dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss '+0530'", "d MMM yyyy, h:mm:ss a")
    for k, form in enumerate(forms, 1):
        written = written.when(F.col("event_id") % 6 == k, F.date_format("ts", form))
    written = written.otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    log = table(spark, d, "events").select("event_id", written.alias("text"), F.floor(F.col("event_id") / 6).cast("long").alias("k"))
    servers = spark.createDataFrame(_CLOCKS, "server_id long, zone string, date_order string")
    log = log.withColumn("server_id", F.pmod("k", F.lit(len(_CLOCKS))))
    return with_utc_micros(log, "text", "utc_us", servers).select("event_id", "utc_us")


# All events lie in winter, so each clock has one offset.
P4_EVENT_TIMES_SQL = """
WITH e AS (SELECT event_id, event_id % 6 AS form, (event_id // 6) % 4 AS server, epoch_us(ts) AS t FROM events),
o AS (SELECT *, CASE server WHEN 1 THEN 19800 WHEN 2 THEN 3600 WHEN 3 THEN -18000 ELSE 0 END * 1000000::BIGINT AS off FROM e)
SELECT event_id, CAST(CASE form WHEN 0 THEN t - off WHEN 2 THEN t - t % 1000000 WHEN 3 THEN t - t % 1000000 - 19800000000 WHEN 5 THEN t - t % 1000 ELSE t - t % 1000000 - off END AS BIGINT) AS utc_us FROM o
"""


def _references(spark: SparkSession, d: str, refs: list[Reference]) -> DataFrame:
    t = {n: table(spark, d, n) for n in {"players", "loadout_templates", *(r.child for r in refs)}}
    t["kill_events"] = t["kill_events"].withColumn("period", F.floor(F.col("id") / 100_000))
    t["player_loadouts"] = t["player_loadouts"].withColumn("period", F.substring("saved_at", 1, 7))
    keys = {"player_loadouts": "uid", "kill_events": "id", "player_blobs": "player_uid", "session_stats": "uid"}
    live = {
        "loadout_templates": plain_keys(t["loadout_templates"], "id"),
        "players": live_keys(t["players"], "uid", ["updated_at", "rev"], "op"),
        "player_loadouts": plain_keys(t["player_loadouts"], "uid"),
    }
    children = {r.child for r in refs}
    return orphans({n: t[n] for n in children}, {n: keys[n] for n in children}, live, refs, {n: "period" for n in ("player_loadouts", "kill_events")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d, REFERENCES).select("source_table", "ref_field", "row_key")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, field, period (month of saving; arrival block of 100,000 events) and kind, over the whole chain."""
    return orphan_report(_references(spark, d, REFERENCES + CHAINED))


P5_REPORT_SQL = """
WITH RECURSIVE last AS (SELECT uid, arg_max(lower(trim(op)), (updated_at, rev)) AS op FROM players WHERE uid IS NOT NULL GROUP BY uid),
live AS (
  SELECT 'players' AS parent, uid AS k FROM last WHERE op IS DISTINCT FROM 'delete'
  UNION ALL SELECT DISTINCT 'loadout_templates', CAST(id AS VARCHAR) FROM loadout_templates
  UNION ALL SELECT DISTINCT 'player_loadouts', uid FROM player_loadouts WHERE uid IS NOT NULL),
refs AS (
  SELECT 'kill_events' AS source_table, 'killer_uid' AS ref_field, 'players' AS parent, CAST(id AS VARCHAR) AS row_key, CAST(killer_uid AS VARCHAR) AS k, CAST(id // 100000 AS VARCHAR) AS period FROM kill_events WHERE killer_uid <> 0
  UNION SELECT 'kill_events', 'victim_uid', 'players', CAST(id AS VARCHAR), CAST(victim_uid AS VARCHAR), CAST(id // 100000 AS VARCHAR) FROM kill_events WHERE victim_uid <> 0
  UNION SELECT 'player_loadouts', 'template_id', 'loadout_templates', uid, CAST(template_id AS VARCHAR), substr(saved_at, 1, 7) FROM player_loadouts WHERE template_id IS NOT NULL
  UNION SELECT 'player_blobs', 'player_uid', 'player_loadouts', player_uid, player_uid, NULL FROM player_blobs WHERE player_uid IS NOT NULL
  UNION SELECT 'session_stats', 'uid', 'players', CAST(uid AS VARCHAR), CAST(uid AS VARCHAR), NULL FROM session_stats WHERE uid <> 0),
orphan AS (
  SELECT r.*, 'direct' AS kind FROM refs r ANTI JOIN live l ON r.parent = l.parent AND r.k = l.k
  UNION SELECT r.*, 'inherited' FROM refs r JOIN orphan o ON r.parent = o.source_table AND r.k = o.row_key)
SELECT source_table, ref_field, period, kind, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM orphan GROUP BY ALL
"""
P5_FOUND_SQL = """
WITH last AS (SELECT uid, arg_max(lower(trim(op)), (updated_at, rev)) AS op FROM players WHERE uid IS NOT NULL GROUP BY uid),
alive AS (SELECT uid FROM last WHERE op IS DISTINCT FROM 'delete'),
refs AS (
  SELECT 'kill_events' AS source_table, 'killer_uid' AS ref_field, CAST(id AS VARCHAR) AS row_key, CAST(killer_uid AS VARCHAR) AS k FROM kill_events WHERE killer_uid <> 0
  UNION SELECT 'kill_events', 'victim_uid', CAST(id AS VARCHAR), CAST(victim_uid AS VARCHAR) FROM kill_events WHERE victim_uid <> 0)
SELECT source_table, ref_field, row_key FROM refs WHERE NOT EXISTS (SELECT 1 FROM alive WHERE uid = k)
UNION
SELECT 'player_loadouts', 'template_id', uid FROM player_loadouts
WHERE template_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loadout_templates t WHERE t.id = template_id)
"""


def _rank_log(spark: SparkSession, d: str, rank: str = "rank") -> dict:
    """Arguments of ``versions`` for players.rank; ``rank`` is what to compare, given the plain rank."""
    players = table(spark, d, "players").withColumns(
        {
            "rank": F.nullif(F.lower(F.regexp_replace("rank", r"^\s+|\s+$", "")), F.lit("")),
            "gone": F.coalesce(F.lower(F.regexp_replace("op", r"^\s+|\s+$", "")) == "delete", F.lit(False)),
            "at_us": F.unix_micros("updated_at"),
        }
    )
    day = F.floor(F.col("at_us") / 86_400_000_000.0)
    # Of rows of one instant only the highest rev counts, recorded or not.
    return {
        "log": players.withColumn("rank", F.expr(rank)), "key": "uid", "at": "at_us", "attrs": ["rank"], "bucket": day, "newest": F.col("rev"),
        "ends_at": F.col("gone"), "skip_empty": True,
    }


def _progress_log(spark: SparkSession, d: str) -> dict:
    """Arguments of ``versions`` for progression.(level, xp)."""
    snaps = table(spark, d, "progression").withColumn("at_us", F.unix_date("snap_date").cast("long") * 86_400_000_000)
    # One row per uid and day counts, so a year is a bucket of bounded size.
    return {
        "log": snaps, "key": "uid", "at": "at_us", "attrs": ["level", "xp"], "bucket": F.year("snap_date"), "newest": F.unix_micros("loaded_at"), "fill": True,
    }


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    """Rank versions of players and (level, xp) versions of progression with their validity."""
    ranks = versions(**_rank_log(spark, d)).select(
        F.lit("players").alias("source_table"), "uid", "version_no", "rank", F.lit(None).cast("long").alias("level"),
        F.lit(None).cast("long").alias("xp"), "valid_from", "valid_to", "is_current",
    )
    steps = versions(**_progress_log(spark, d)).select(
        F.lit("progression").alias("source_table"), "uid", "version_no", F.lit(None).cast("string").alias("rank"), "level", "xp",
        "valid_from", "valid_to", "is_current",
    )
    return ranks.unionByName(steps).withColumnsRenamed({"valid_from": "valid_from_us", "valid_to": "valid_to_us"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Start of every version in whole seconds; versions that begin within one second give one row."""
    out = None
    # Only starts are asked for, so the hash of the rank stands for it.
    for name, log in (("players", _rank_log(spark, d, "if(rank IS NULL, NULL, xxhash64(rank))")), ("progression", _progress_log(spark, d))):
        starts = version_starts(**log).filter("NOT _gone")
        # A second lies in one bucket, so rows of one second meet where the buckets lie anyway.
        starts = starts.select("_k", "_bucket", F.expr("CAST(floor(_at / 1000000.0D) AS bigint)").alias("valid_from_s")).distinct()
        part = starts.select(F.lit(name).alias("source_table"), F.col("_k").alias("uid"), "valid_from_s")
        out = part if out is None else out.unionByName(part)
    return out


_P6_CTES = """
WITH pl AS (
  SELECT uid, updated_at, arg_max(struct_pack(r := nullif(lower(regexp_replace(rank, '^\\s+|\\s+$', '', 'g')), ''), gone := lower(trim(op)) = 'delete'), rev) AS v
  FROM players WHERE uid IS NOT NULL AND updated_at IS NOT NULL GROUP BY uid, updated_at),
ev AS (SELECT uid, updated_at, CASE WHEN v.gone THEN '' ELSE v.r END AS s FROM pl WHERE v.gone OR v.r IS NOT NULL),
ch AS (SELECT *, lag(s) OVER (PARTITION BY uid ORDER BY updated_at) AS b FROM ev),
pr AS (SELECT uid, snap_date, arg_max(struct_pack(l := level, x := xp), loaded_at) AS v FROM progression WHERE uid IS NOT NULL AND snap_date IS NOT NULL GROUP BY uid, snap_date),
f AS (SELECT uid, snap_date, last_value(v.l IGNORE NULLS) OVER w AS l, last_value(v.x IGNORE NULLS) OVER w AS x, row_number() OVER w AS n
      FROM pr WINDOW w AS (PARTITION BY uid ORDER BY snap_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, lag(l) OVER (PARTITION BY uid ORDER BY snap_date) AS bl, lag(x) OVER (PARTITION BY uid ORDER BY snap_date) AS bx FROM f)
"""

P6_FOUND_SQL = _P6_CTES + """
SELECT DISTINCT 'players' AS source_table, uid, CAST(floor(epoch_us(updated_at) / 1000000.0) AS BIGINT) AS valid_from_s FROM ch WHERE s <> '' AND s IS DISTINCT FROM b
UNION ALL
SELECT 'progression', uid, CAST(epoch_us(CAST(snap_date AS TIMESTAMP)) // 1000000 AS BIGINT) FROM g WHERE n = 1 OR l IS DISTINCT FROM bl OR x IS DISTINCT FROM bx
"""

P6_VERSIONS_SQL = _P6_CTES + """,
pv AS (SELECT uid, s, epoch_us(updated_at) AS t, epoch_us(lead(updated_at) OVER w) AS nxt, CAST(sum(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS no
       FROM ch WHERE s IS DISTINCT FROM b AND NOT (s = '' AND b IS NULL) WINDOW w AS (PARTITION BY uid ORDER BY updated_at)),
gv AS (SELECT uid, l, x, epoch_us(CAST(snap_date AS TIMESTAMP)) AS t, epoch_us(CAST(lead(snap_date) OVER w AS TIMESTAMP)) AS nxt, row_number() OVER w AS no
       FROM g WHERE n = 1 OR l IS DISTINCT FROM bl OR x IS DISTINCT FROM bx WINDOW w AS (PARTITION BY uid ORDER BY snap_date))
SELECT 'players' AS source_table, uid, no AS version_no, s AS rank, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS xp, t AS valid_from_us, nxt AS valid_to_us, nxt IS NULL AS is_current FROM pv WHERE s <> ''
UNION ALL SELECT 'progression', uid, no, NULL, l, x, t, nxt, nxt IS NULL FROM gv
"""


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per gear item of all three tables with owner, path, parent path, class and count."""
    out = None
    for name, key, field in GEAR:
        part = gear_items(table(spark, d, name), name, key, field)
        out = part if out is None else out.unionByName(part)
    return out


def p7_order_items(spark: SparkSession, d: str) -> DataFrame:
    """The operator of p7 over nested texts made of whole orders: an item per line with its supplier inside."""
    line = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            F.concat(F.lit("part-"), "l_partkey").alias("class"), F.col("l_quantity").cast("long").alias("count"),
            F.array(F.struct(F.concat(F.lit("supplier-"), "l_suppkey").alias("class"))).alias("contents"),
        ).alias("x"),
    )
    texts = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("gear"))
    return gear_items(texts.select("l_orderkey", F.to_json(F.struct("gear")).alias("text")), "orders", "l_orderkey", "text")


P7_ORDER_ITEMS_SQL = """
WITH l AS (SELECT *, 'gear.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) AS path FROM lineitem)
SELECT 'orders' AS source_table, CAST(l_orderkey AS VARCHAR) AS row_key, path AS item_path, NULL AS parent_path, 1 AS depth, 'part-' || l_partkey AS class, CAST(trunc(l_quantity) AS BIGINT) AS count FROM l
UNION ALL SELECT 'orders', CAST(l_orderkey AS VARCHAR), path || '.contents.0', path, 2, 'supplier-' || l_suppkey, NULL FROM l
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_items(spark, d).select("source_table", "row_key", "item_path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_features, p1_type_totals, p1_event_features, p3_found, p3_sessions, p3_event_sessions, p4_found, p4_event_times, p5_found, p5_report, p6_found, p6_versions, p7_found, p7_items, p7_order_items)
}

SQL = {"p1_type_totals": P1_TYPE_TOTALS_SQL, "p1_event_features": P1_EVENT_FEATURES_SQL, "p3_event_sessions": P3_EVENT_SESSIONS_SQL, "p4_event_times": P4_EVENT_TIMES_SQL, "p7_order_items": P7_ORDER_ITEMS_SQL, "p5_found": P5_FOUND_SQL, "p5_report": P5_REPORT_SQL, "p6_found": P6_FOUND_SQL, "p6_versions": P6_VERSIONS_SQL}
