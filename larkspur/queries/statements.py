"""Queries that run statements through a session: dialect functions, writes, definitions, transactions, triggers, formats and streams.

Each starts from the project's own tables, runs its statements and returns a
table that DuckDB can state as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import script
from larkspur.operators import boards, dml
from larkspur.plans.catalog import ConstraintError, Column, TableMeta
from larkspur.plans.materialize import cut, shared_dir
from larkspur.plans.session import Session
from larkspur.queries.relational import _sim
from larkspur.sources import store, text
from larkspur.sources.tables import table
from larkspur.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_STEEL = "'steel ring'"


def _query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its oracle."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _session(spark: SparkSession, d: str, *names: str, profile: str = "ansi", **keys: tuple[str, ...]) -> Session:
    """A session over the named tables; ``keys`` gives primary keys."""
    s = Session(spark, profile)
    for name in names:
        df = table(spark, d, name)
        columns = tuple(Column(f.name, f.dataType) for f in df.schema.fields)
        s.register(name, df, TableMeta(columns, primary=keys.get(name, ())))
    return s


def _said(name: str, sql: str, oracle: str, *tables: str, profile: str = "ansi", **keys: tuple[str, ...]) -> None:
    """Register a query that is one SELECT in the dialect."""
    QUERIES[name] = lambda spark, d: _session(spark, d, *tables, profile=profile, **keys).sql(sql)
    SQL[name] = oracle


# --- functions of the dialect ---

_said(
    "datetime_modifiers",
    "SELECT event_id, datetime(ts, '+3 days', '-2 hours', '+1 month') AS t, date(ts, 'start of month') AS d, time(ts, '+90 minutes') AS c FROM events",
    "SELECT event_id, strftime(ts + INTERVAL 3 DAY - INTERVAL 2 HOUR + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS t, strftime(date_trunc('month', ts), '%Y-%m-%d') AS d, strftime(ts + INTERVAL 90 MINUTE, '%H:%M:%S') AS c FROM events",
    "events",
)
_said(
    "datetime_fixed_months",
    "SELECT event_id, datetime(ts, '+1 month', '-1 year', '2 weeks') AS t FROM events",
    "SELECT event_id, strftime(ts + INTERVAL 30 DAY - INTERVAL 365 DAY + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S') AS t FROM events",
    "events", profile="compat",
)
_said(
    "datetime_now",
    "SELECT count(*) AS n, min(length(datetime('now', '-1 day'))) AS long FROM events WHERE ts < datetime('now', '-7 days') AND date('now') > '2024-01-01' AND length(time('now')) = 8",
    "SELECT count(*) AS n, 19 AS long FROM events WHERE ts < now() - INTERVAL 7 DAY",
    "events",
)
_said("strftime_text", "SELECT event_id, strftime('%Y/%m/%d at %H-%M-%S %%', ts) AS f FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d at %H-%M-%S %%') AS f FROM events", "events")
_said("char_function", "SELECT n_nationkey, CHAR(72, n_nationkey + 65, 8364, 128512) AS c FROM nation", "SELECT n_nationkey, 'H' || chr(n_nationkey + 65) || chr(8364) || chr(128512) AS c FROM nation", "nation")
_said(
    "typeof_values",
    "SELECT DISTINCT typeof(killer_uid) AS u, typeof(killer_weapon) AS w, typeof(killer_uid / 2) AS h, typeof(headshot = 1) AS b FROM kill_events",
    "SELECT DISTINCT CASE WHEN killer_uid IS NULL THEN 'null' ELSE 'integer' END AS u, CASE WHEN killer_weapon IS NULL THEN 'null' ELSE 'text' END AS w, CASE WHEN killer_uid IS NULL THEN 'null' ELSE 'real' END AS h, CASE WHEN headshot IS NULL THEN 'null' ELSE 'integer' END AS b FROM kill_events",
    "kill_events",
)
_said("sqf_eval_function", "SELECT n_nationkey, CAST(SQF_EVAL('(1 + 2) * ' || n_nationkey || ' max 7') AS DOUBLE) AS v FROM nation", "SELECT n_nationkey, CAST(greatest(3 * n_nationkey, 7) AS DOUBLE) AS v FROM nation", "nation")
_said("random_integers", "SELECT count(DISTINCT r) AS n, count(*) AS rows FROM (SELECT RANDOM() AS r FROM orders)", "SELECT count(*) AS n, count(*) AS rows FROM orders", "orders")
_said("trim_sets", "SELECT p_partkey, LTRIM(p_name, 'aeiosb') AS l, RTRIM(p_name, 'gntr') AS r, LTRIM(p_name) AS p FROM part", "SELECT p_partkey, ltrim(p_name, 'aeiosb') AS l, rtrim(p_name, 'gntr') AS r, ltrim(p_name) AS p FROM part", "part")
_said(
    "first_row_of_group",
    "SELECT o_custkey, o_orderkey, o_totalprice AS price, count(*) AS n FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS price, count(*) AS n FROM orders GROUP BY o_custkey",
    "orders", profile="compat", orders=("o_orderkey",),
)
_said("clock_identifiers", "SELECT event_id FROM events WHERE ts < CURRENT_TIMESTAMP AND CAST(ts AS DATE) < CURRENT_DATE AND NOW() > ts AND CURDATE() > DATE '2024-01-01'", "SELECT event_id FROM events WHERE ts < now() AND CAST(ts AS DATE) < current_date", "events")
_said("reserved_words", "SELECT `user`, `date` FROM (SELECT n_name AS `user`, n_nationkey AS `date` FROM nation) WHERE `date` > 3", 'SELECT n_name AS "user", n_nationkey AS "date" FROM nation WHERE n_nationkey > 3', "nation")
_said("array_literals", "SELECT n_nationkey, ARRAY[n_nationkey, 7, 9][0] AS first, size(ARRAY['a', n_name]) AS n FROM nation", "SELECT n_nationkey, n_nationkey AS first, 2 AS n FROM nation", "nation")
_said("words_in_literals", "SELECT n_nationkey, 'a into b returning c where; d' AS s FROM nation -- where\nWHERE n_name <> 'x using y' /* limit 1 */", "SELECT n_nationkey, 'a into b returning c where; d' AS s FROM nation", "nation")
_said("numbers_and_comments", "SELECT p_partkey, p_size * 1.5e2 AS v, CAST(.5 AS DOUBLE) AS h /* c */ FROM part -- end", "SELECT p_partkey, p_size * 150.0::DOUBLE AS v, 0.5::DOUBLE AS h FROM part", "part")
_said("glob_regexp", "SELECT p_partkey FROM part WHERE p_name REGEXP '*r?n*'", "SELECT p_partkey FROM part WHERE p_name GLOB '*r?n*'", "part", profile="compat")

# --- forms that the engine takes beyond the reference's dialect ---

_said(
    "pivot",
    "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority",
    "orders",
)
_said("unpivot", "SELECT * FROM (SELECT p_partkey, p_size, CAST(p_retailprice AS BIGINT) AS price FROM part) UNPIVOT (v FOR what IN (p_size, price))", "SELECT p_partkey, 'p_size' AS what, p_size AS v FROM part UNION ALL SELECT p_partkey, 'price', CAST(trunc(p_retailprice) AS BIGINT) FROM part", "part")
_said("lateral_join", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000) t", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000", "customer", "orders")
_said("table_sample", "SELECT n = total AS whole FROM (SELECT count(*) AS n FROM orders TABLESAMPLE (100 PERCENT)) CROSS JOIN (SELECT count(*) AS total FROM orders)", "SELECT true AS whole", "orders")
_said("union_by_name", "SELECT a, b, CAST(n AS BIGINT) AS n FROM (SELECT a, b, count(*) AS n FROM (SELECT s_nationkey AS a, s_name AS b FROM supplier) GROUP BY a, b) UNION ALL SELECT 1, 'x', 2", "SELECT s_nationkey AS a, s_name AS b, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 1, 'x', 2", "supplier")
_said(
    "named_window_nth",
    "SELECT event_id, nth_value(event_type, 2) OVER w AS second, last_value(value) IGNORE NULLS OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "SELECT event_id, nth_value(event_type, 2) OVER w AS second, last_value(value IGNORE NULLS) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "events",
)
_said("ignore_nulls", "SELECT id, lag(killer_uid) IGNORE NULLS OVER (PARTITION BY server_id ORDER BY id, ts, victim_uid, killer_uid) AS before FROM (SELECT DISTINCT id, server_id, killer_uid, victim_uid, ts FROM kill_events WHERE id IS NOT NULL)", "SELECT id, lag(killer_uid IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY id, ts NULLS FIRST, victim_uid NULLS FIRST, killer_uid NULLS FIRST) AS before FROM (SELECT DISTINCT id, server_id, killer_uid, victim_uid, ts FROM kill_events WHERE id IS NOT NULL)", "kill_events")
_said("order_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL", "orders")


@_query("SELECT a, s, n FROM (SELECT s_nationkey AS a, s_name AS s, NULL::BIGINT AS n FROM supplier UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation)")
def union_missing_columns(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), F.col("s_name").alias("s"))
    b = table(spark, d, "nation").select(F.col("n_regionkey").alias("n"), F.col("n_nationkey").alias("a"))
    return a.unionByName(b, allowMissingColumns=True).select("a", "s", "n")


@_query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS DOUBLE) AS spread, CAST(median(p_size) AS DOUBLE) AS middle FROM part GROUP BY p_brand")
def user_aggregates(spark, d):
    s = _session(spark, d, "part")
    s.register_aggregate("fn_spread", lambda v: float(v.max() - v.min()), "double")
    s.register_aggregate("fn_middle", lambda v: float(v.median()), "double")
    return s.sql("SELECT p_brand, fn_spread(p_size) AS spread, fn_middle(p_size) AS middle FROM part GROUP BY p_brand")


@_query("SELECT n_nationkey, range AS k, range * range AS sq FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey % 4)) AS range)")
def user_table_function(spark, d):
    s = _session(spark, d, "nation")
    s.register_table_function("fn_squares", lambda n: ((k, k * k) for k in range(n)), "k BIGINT, sq BIGINT")
    return s.sql("SELECT n_nationkey, t.k, t.sq FROM nation, LATERAL fn_squares(n_nationkey % 4) t")


@_query("SELECT n_nationkey, n_nationkey / 2.0 + 1 AS h, upper(n_name) || '!' AS loud FROM nation")
def registered_functions(spark, d):
    s = _session(spark, d, "nation")
    s.register_function("fn_half", ["x DOUBLE"], "x / 2 + 1")
    s.register_python("fn_loud", lambda x: x.str.upper() + "!", "string")
    return s.sql("SELECT n_nationkey, fn_half(n_nationkey) AS h, fn_loud(n_name) AS loud FROM nation")


@_query("SELECT 'scan' AS what, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'statements', 3")
def hooks_and_slow_log(spark, d):
    s, seen, done = _session(spark, d, "nation"), [], []
    s.pre_hooks.append(seen.append)
    s.post_hooks.append(lambda sql, df: done.append(sql))
    n = s.sql("SELECT count(*) AS n FROM nation").first().n
    s.sql("SET mode = 'x'")
    s.sql("SELECT 1")
    assert seen == done and {q for q, _ in s.slow_log} <= set(seen)
    return spark.createDataFrame([("scan", n), ("statements", len(seen))], "what string, n bigint")


# --- tables and writes ---


def _parts(spark: SparkSession, d: str) -> Session:
    s = _session(spark, d, "part")
    s.sql("CREATE TABLE stock (id INT PRIMARY KEY, name TEXT NOT NULL, size INT DEFAULT 5, CHECK (size >= 0))")
    s.sql("INSERT INTO stock SELECT p_partkey, p_name, p_size FROM part")
    return s


@_query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part UNION ALL SELECT * FROM (VALUES (-1, 'new; into', 5), (-2, 'it''s', 9), (-3, 'third', 5))")
def insert_values(spark, d):
    s = _parts(spark, d)
    s.run("INSERT INTO stock (id, name) VALUES (-1, 'new; into'); INSERT INTO stock VALUES (-2, 'it''s', 9); INSERT INTO stock (name, id) VALUES ('third', -3)")
    for bad in ("(-1, 'again', 1)", "(-9, NULL, 1)", "(-9, 'x', -1)", "(NULL, 'x', 1)"):
        try:
            s.sql(f"INSERT INTO stock VALUES {bad}")
        except ConstraintError:
            continue
        raise AssertionError(bad)
    return s.sql("SELECT * FROM stock")


@_query("SELECT p_partkey AS id, p_size AS size FROM part")
def insert_or_rollback(spark, d):
    """A duplicate key undoes the whole transaction, also the delete before it."""
    s = _parts(spark, d)
    s.run("BEGIN; DELETE FROM stock WHERE size > 10")
    try:
        s.sql("INSERT OR ROLLBACK INTO stock SELECT p_partkey, p_name, p_size FROM part")
    except ConstraintError:
        pass
    return s.sql("SELECT id, size FROM stock")


@_query("SELECT 0 AS rows, count(*) AS changed FROM part")
def truncate_table(spark, d):
    s = _parts(spark, d)
    n = s.sql("TRUNCATE TABLE stock").first()[0]
    return s.sql("SELECT count(*) AS rows, $1 AS changed FROM stock", [n])


@_query("SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN p_size + 1 ELSE p_size END AS size, CAST(p_partkey AS VARCHAR) AS tag FROM part WHERE p_size <> 7 UNION ALL SELECT -1, 4, 'tag'")
def upsert_statement(spark, d):
    s = _parts(spark, d)
    s.run("DELETE FROM stock WHERE size = 7; INSERT INTO stock VALUES (-1, 'x', 3)")
    s.sql("INSERT INTO stock SELECT id, 'again', size FROM stock ON CONFLICT (id) DO UPDATE SET size = size + 1 WHERE excluded.size < 20")
    return s.sql("SELECT id, size, CASE WHEN id < 0 THEN 'tag' ELSE CAST(id AS STRING) END AS tag FROM stock")


@_query("SELECT p_brand AS brand, count(*) + 1000 AS n, max(p_size) AS top FROM part GROUP BY p_brand")
def progression_upsert(spark, d):
    """Running totals kept by ON CONFLICT with a COALESCE of a scalar subquery."""
    s = _session(spark, d, "part")
    s.run("CREATE TABLE best (brand TEXT PRIMARY KEY, n INT, top INT); INSERT INTO best SELECT p_brand, 1000, 0 FROM part GROUP BY p_brand")
    s.sql("INSERT INTO best SELECT p_brand, count(*), COALESCE((SELECT max(p_size) FROM part WHERE p_size < 0), max(p_size)) FROM part GROUP BY p_brand ON CONFLICT (brand) DO UPDATE SET n = n + excluded.n, top = excluded.top")
    return s.sql("SELECT * FROM best")


@_query("SELECT p_partkey AS id, p_size * 10 AS size FROM part WHERE p_size > 40")
def returning_rows(spark, d):
    return _parts(spark, d).sql("UPDATE stock SET size = size * 10 WHERE size > 40 RETURNING id, size")


@_query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size = 7")
def returning_deleted(spark, d):
    return _parts(spark, d).sql("DELETE FROM stock WHERE size = 7 RETURNING id, name")


@_query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def delete_using_statement(spark, d):
    s = _parts(spark, d)
    s.register("supplier", table(spark, d, "supplier"))
    s.sql("DELETE FROM stock USING supplier WHERE stock.id = s_suppkey AND s_acctbal > 0")
    return s.sql("SELECT id FROM stock")


_MERGED = """
WITH n AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
t AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v, range AS copy FROM customer, range(2))
SELECT k, v, count(*) AS rows FROM (
  SELECT t.k, CASE WHEN n.k IS NULL THEN t.v WHEN n.n > 12 THEN t.v + n.n ELSE 0 END AS v FROM t LEFT JOIN n ON t.k = n.k AND NOT (t.v = 3)
  WHERE n.k IS NULL OR n.n > 12 OR n.top <= 300000) GROUP BY k, v
"""


@_query(_MERGED)
def merge_statement(spark, d):
    """MERGE over a target whose rows all stand twice; clauses act in their order."""
    s = _session(spark, d, "customer", "orders")
    s.run("CREATE TABLE t (k INT, v INT); INSERT INTO t SELECT c_custkey, c_nationkey FROM customer; INSERT INTO t SELECT c_custkey, c_nationkey FROM customer")
    s.sql("""MERGE INTO t USING (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) s ON t.k = s.o_custkey AND t.v <> 3
             WHEN MATCHED AND s.n > 12 THEN UPDATE SET v = t.v + s.n WHEN MATCHED AND s.top > 300000 THEN DELETE WHEN MATCHED THEN UPDATE SET v = 0""")
    return s.sql("SELECT k, v, count(*) AS rows FROM t GROUP BY k, v")


@_query("SELECT c_custkey AS k, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT -1, 5")
def merge_inserts(spark, d):
    s = _session(spark, d, "customer", "orders")
    s.run("CREATE TABLE t (k INT PRIMARY KEY, n INT); INSERT INTO t VALUES (-1, 5), (1, 99)")
    s.sql("MERGE INTO t USING (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) s ON t.k = s.c_custkey WHEN MATCHED THEN UPDATE SET n = s.n WHEN NOT MATCHED THEN INSERT (k, n) VALUES (s.c_custkey, s.n)")
    return s.sql("SELECT * FROM t")


def _family(spark: SparkSession, d: str, rules: str) -> Session:
    s = _session(spark, d, "nation", "customer")
    s.run(f"CREATE TABLE n (id INT PRIMARY KEY, name TEXT); CREATE TABLE c (id INT PRIMARY KEY, n_id INT REFERENCES n(id) {rules})")
    s.run("INSERT INTO n SELECT n_nationkey, n_name FROM nation; INSERT INTO c SELECT c_custkey, c_nationkey FROM customer")
    return s


@_query("SELECT c_custkey AS id, c_nationkey AS n_id FROM customer WHERE c_nationkey >= 5")
def on_delete_cascade(spark, d):
    s = _family(spark, d, "ON DELETE CASCADE")
    s.sql("DELETE FROM n WHERE id < 5")
    return s.sql("SELECT * FROM c")


@_query("SELECT c_custkey AS id, CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS n_id FROM customer")
def on_delete_set_null(spark, d):
    s = _family(spark, d, "ON DELETE SET NULL")
    s.sql("DELETE FROM n WHERE id < 5")
    return s.sql("SELECT * FROM c")


@_query("SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS n_id FROM customer")
def on_update_cascade(spark, d):
    s = _family(spark, d, "ON UPDATE CASCADE")
    s.sql("UPDATE n SET id = id + 100 WHERE id < 5")
    return s.sql("SELECT * FROM c")


@_query("SELECT 'update' AS what, count(*) AS n FROM nation UNION ALL SELECT 'delete', count(*) FROM nation UNION ALL SELECT 'insert', count(*) FROM nation")
def references_restrict(spark, d):
    """Each of three statements that would leave rows without their parent is refused and changes nothing."""
    s, out = _family(spark, d, ""), []
    for what, sql in (("update", "UPDATE n SET id = id + 100"), ("delete", "DELETE FROM n"), ("insert", "INSERT INTO c VALUES (-1, 999)")):
        try:
            s.sql(sql)
        except ConstraintError:
            out.append((what, s.sql("SELECT count(*) AS n FROM n").first().n))
    return spark.createDataFrame(out, "what string, n bigint")


# --- triggers ---


@_query("SELECT p_partkey AS id, p_size AS before, p_size * 2 AS after FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_size, NULL FROM part WHERE p_size < 5 UNION ALL SELECT -1, NULL, 3")
def trigger_old_and_new(spark, d):
    s = _parts(spark, d)
    s.run("""CREATE TABLE log (id INT, before INT, after INT);
             CREATE TRIGGER u AFTER UPDATE ON stock FOR EACH ROW BEGIN INSERT INTO log VALUES (OLD.id, OLD.size, NEW.size); END;
             CREATE TRIGGER x AFTER DELETE ON stock BEGIN INSERT INTO log VALUES (OLD.id, OLD.size, NULL); END;
             CREATE TRIGGER i AFTER INSERT ON stock WHEN NEW.id < 0 BEGIN INSERT INTO log VALUES (NEW.id, OLD.size, NEW.size); END""")
    s.run("UPDATE stock SET size = size * 2 WHERE size > 25; DELETE FROM stock WHERE size < 5; INSERT INTO stock VALUES (-1, 'x', 3)")
    return s.sql("SELECT * FROM log")


@_query("SELECT p_partkey AS id, p_size AS size FROM part UNION ALL SELECT -2, 8")
def trigger_raise(spark, d):
    s = _parts(spark, d)
    s.sql("CREATE TRIGGER guard BEFORE INSERT ON stock BEGIN SELECT CASE WHEN NEW.size > 1000 THEN RAISE(ABORT, 'too large') END; END")
    s.sql("CREATE TRIGGER keep AFTER DELETE ON stock WHEN OLD.size < 10 BEGIN SELECT RAISE(ABORT, 'small parts stay'); END")
    for bad, why in (("INSERT INTO stock VALUES (-1, 'x', 1001), (-3, 'y', 1)", "too large"), ("DELETE FROM stock", "small parts stay")):
        try:
            s.sql(bad)
        except ConstraintError as e:
            assert why in str(e)
    s.sql("INSERT INTO stock VALUES (-2, 'z', 8)")
    return s.sql("SELECT id, size FROM stock")


@_query("SELECT n_nationkey AS id, CAST(count(c_custkey) AS BIGINT) AS members, coalesce(sum(c_custkey), 0) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def trigger_counters(spark, d):
    """A counter that each inserted row raises."""
    s = _session(spark, d, "nation", "customer")
    s.run("""CREATE TABLE n (id INT PRIMARY KEY, members INT DEFAULT 0, total INT DEFAULT 0); INSERT INTO n (id) SELECT n_nationkey FROM nation;
             CREATE TABLE c (id INT PRIMARY KEY, n_id INT);
             CREATE TRIGGER up AFTER INSERT ON c BEGIN UPDATE n SET members = members + 1, total = total + NEW.id WHERE id = NEW.n_id; END""")
    s.sql("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer")
    return s.sql("SELECT * FROM n")


@_query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'gone' ELSE 'here' END AS state FROM part")
def trigger_update_and_delete(spark, d):
    s = _parts(spark, d)
    s.run("""CREATE TABLE states (id INT PRIMARY KEY, state TEXT); INSERT INTO states SELECT id, 'here' FROM stock;
             CREATE TABLE shadow (id INT); INSERT INTO shadow SELECT id FROM stock;
             CREATE TRIGGER a AFTER DELETE ON stock BEGIN UPDATE states SET state = 'gone' WHERE states.id = OLD.id; DELETE FROM shadow WHERE id = OLD.id; END""")
    s.sql("DELETE FROM stock WHERE size > 40")
    return s.sql("SELECT states.id, state FROM states LEFT JOIN shadow ON states.id = shadow.id WHERE (shadow.id IS NULL) = (state = 'gone')")


# --- definitions ---


@_query("SELECT p_partkey, p_name FROM part WHERE p_size > 30")
def view_scan(spark, d):
    s = _session(spark, d, "part")
    s.run("CREATE VIEW big AS SELECT p_partkey, p_name, 'x where y' AS note FROM part WHERE p_size > 40; CREATE OR REPLACE VIEW big AS SELECT p_partkey, p_name FROM part WHERE p_size > 30; CREATE VIEW IF NOT EXISTS big AS SELECT 1 AS one")
    return s.sql("SELECT * FROM big")


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def create_as_and_rename(spark, d):
    s = _session(spark, d, "nation")
    s.run("CREATE TABLE a AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey; RENAME TABLE a TO b; ALTER TABLE b RENAME TO c; CREATE TABLE gone (x INT); DROP TABLE gone; DROP TABLE IF EXISTS gone")
    return s.sql("SELECT * FROM c")


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_name <> ' into x'")
def select_into(spark, d):
    s = _session(spark, d, "nation")
    s.sql("SELECT n_nationkey, n_name INTO copy FROM nation WHERE n_name <> ' into x'")
    return s.sql("SELECT * FROM copy")


@_query("SELECT p_partkey AS id, p_size AS amount, 3 AS extra FROM part")
def alter_table(spark, d):
    s = _parts(spark, d)
    s.run("ALTER TABLE stock ADD COLUMN extra INT DEFAULT 3; ALTER TABLE stock RENAME COLUMN size TO amount; ALTER TABLE stock DROP COLUMN name")
    return s.sql("SELECT * FROM stock")


@_query("SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier UNION ALL SELECT -1, count(*) + 1 FROM supplier")
def auto_increment_column(spark, d):
    s = _session(spark, d, "supplier")
    s.run("CREATE TABLE a (id INTEGER PRIMARY KEY, k INT); INSERT INTO a (k) SELECT s_suppkey FROM supplier; INSERT INTO a (k) VALUES (-1)")
    return s.sql("SELECT k, id FROM a")


@_query("SELECT count(*) + 1 AS id, 1 AS n, count(*) + 1 AS rows FROM supplier")
def row_id_and_changes(spark, d):
    s = _session(spark, d, "supplier")
    s.run("CREATE TABLE a (id INTEGER PRIMARY KEY, k INT); INSERT INTO a (k) SELECT s_suppkey FROM supplier; INSERT INTO a (k) VALUES (-1)")
    return s.sql("SELECT LAST_INSERT_ROWID() AS id, CHANGES() AS n, count(*) AS rows FROM a")


@_query("SELECT range + 7 AS v FROM range(3)")
def sequence_values(spark, d):
    s = Session(spark)
    s.sql("CREATE SEQUENCE q START WITH 7")
    return spark.createDataFrame([(s.nextval("q"),) for _ in range(3)], "v bigint")


@_query("SELECT * FROM (VALUES ('index', 'by_size'), ('key', 'id'), ('not_null', 'name'), ('table', 'part'), ('table', 'stock'), ('variable', 'mode=x; y')) AS v(what, name)")
def show_and_describe(spark, d):
    s = _parts(spark, d)
    s.run("SET mode = 'x; y'; CREATE INDEX by_size ON stock USING BTREE (size)")
    out = [("table", r.name) for r in s.sql("SHOW TABLES").collect()]
    rows = s.sql("DESCRIBE stock").collect()
    out += [("key", r.name) for r in rows if r.primary_key] + [("not_null", r.name) for r in rows if r.not_null]
    out += [("variable", f"{r.name}={r.value}") for r in s.sql("SHOW VARIABLES").collect()] + [("index", i[0]) for i in s.state.meta["stock"].indexes]
    return spark.createDataFrame(out, "what string, name string")


@_query("SELECT 'nation' AS table, count(*) AS row_count, 3 AS column_count FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region")
def analyze_counts(spark, d):
    return _session(spark, d, "nation", "region").sql("ANALYZE")


@_query("SELECT * FROM (VALUES ('GroupBy'), ('Filter'), ('OrderBy'), ('Limit'), ('SeqScan')) AS v(operator)")
def explain_operators(spark, d):
    s = _session(spark, d, "part")
    plan = json.loads(s.sql("EXPLAIN JSON SELECT p_brand, count(*) AS n FROM part WHERE p_size > 5 GROUP BY p_brand ORDER BY n, p_brand LIMIT 3").first().plan)
    wanted = ("GroupBy", "Filter", "OrderBy", "Limit", "SeqScan")
    return spark.createDataFrame([(n,) for n in dict.fromkeys(plan) if n in wanted], "operator string")


@_query("SELECT count(*) AS n, 4.5::DOUBLE AS half FROM part WHERE p_size >= 5 AND p_size < 20")
def prepared_and_call(spark, d):
    s = _session(spark, d, "part")
    s.run("PREPARE p AS SELECT count(*) AS n FROM part WHERE p_size >= $1 AND p_size < $2; VACUUM; REINDEX")
    s.register_function("fn_div", ["x DOUBLE", "y DOUBLE"], "x / y")
    half = s.sql("CALL fn_div(9, 2)").first()[0]
    return s.sql("EXECUTE p(5, 20)").withColumn("half", F.lit(half))


@_query(f"SELECT p_partkey AS id, p_name AS name FROM part WHERE {_sim('p_name', _STEEL)} >= 0.3")
def search_table(spark, d):
    """A full-text table, searched by similarity."""
    s = _session(spark, d, "part")
    s.run("CREATE VIRTUAL TABLE names USING fts5(id, name); INSERT INTO names SELECT CAST(p_partkey AS STRING), p_name FROM part")
    return s.sql("SELECT CAST(id AS BIGINT) AS id, name FROM names WHERE name %% 'steel ring'")


# --- transactions ---


@_query("SELECT p_partkey AS id FROM part WHERE p_size > 10 UNION ALL SELECT -2")
def transactions(spark, d):
    s = _parts(spark, d)
    s.run("BEGIN; INSERT INTO stock VALUES (-1, 'x', 1); DROP TABLE part; ROLLBACK; BEGIN; DELETE FROM stock WHERE size <= 10; INSERT INTO stock VALUES (-2, 'y', 20); COMMIT; ROLLBACK")
    return s.sql("SELECT id FROM stock WHERE EXISTS (SELECT 1 FROM part)")


@_query("SELECT p_partkey AS id FROM part WHERE p_size <> 3")
def savepoints(spark, d):
    s = _parts(spark, d)
    s.run("BEGIN; DELETE FROM stock WHERE size = 3; SAVEPOINT one; DELETE FROM stock; SAVEPOINT two; CREATE TABLE z (a INT); ROLLBACK TO one; SAVEPOINT three; RELEASE three; COMMIT")
    return s.sql("SELECT id FROM stock")


# --- formats, stores, cursors ---


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey > 5 THEN c_mktsegment || ', \"x\"' END AS note FROM customer")
def csv_round_trip(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_acctbal", "CASE WHEN c_nationkey > 5 THEN c_mktsegment || ', \"x\"' END AS note")
    at = _folder(spark, "csv")
    text.write_csv(df, at)
    return text.read_csv(spark, at, df.schema)


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark, d):
    doc = json.dumps(text.json_document("nation", table(spark, d, "nation"), primary=["n_nationkey"]))
    return text.from_json_document(spark, doc)[1]


@_query("SELECT p_partkey AS id, p_name AS name, p_size AS size, p_size > 9 AS big FROM part")
def copy_lines(spark, d):
    """COPY FROM STDIN of rows that were written as lines; COPY TO counts them."""
    lines = table(spark, d, "part").selectExpr("concat_ws('|', p_partkey, p_name, p_size, p_size > 9) AS line")
    s = Session(spark)
    s.sql("CREATE TABLE c (id INT, name TEXT, size INT, big BOOLEAN)")
    data = "# id|name|size|big\n" + "\n".join(r.line for r in lines.toLocalIterator())
    n = s.copy_from("c", data, "|")
    assert n == s.sql("COPY c TO 'file'").first()[0]
    return s.sql("SELECT * FROM c")


@_query("SELECT n_nationkey AS id, n_name || '''s' AS name FROM nation")
def dump_and_run(spark, d):
    """The SQL dump of a session, run in another."""
    s = _session(spark, d, "nation")
    s.run("CREATE TABLE a (id INT PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x'); INSERT INTO a SELECT n_nationkey, n_name || '''s' FROM nation WHERE n_nationkey < 3; CREATE INDEX i ON a (name); CREATE VIEW v AS SELECT id, name FROM a; DROP TABLE nation")
    rest = table(spark, d, "nation").filter("n_nationkey >= 3").selectExpr("n_nationkey AS id", "n_name || \"'s\" AS name")
    again = Session(spark)
    again.run("\n".join(store.dump(s)))
    return again.sql("SELECT id, name FROM v").unionByName(rest)


@_query("SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size < 30")
def save_and_load(spark, d):
    s, at = _parts(spark, d), _folder(spark, "store")
    s.sql("CREATE VIEW small AS SELECT id, size FROM stock WHERE size < 30")
    store.save(s, at)
    s.sql("DELETE FROM stock")
    store.save(s, at)
    again = Session(spark)
    store.load(again, at + ".bak")
    return again.sql("SELECT * FROM small")


@_query("SELECT n_nationkey, n_name FROM nation")
def export_files(spark, d):
    df, at = table(spark, d, "nation").select("n_nationkey", "n_name"), _folder(spark, "export")
    out = [spark.read.schema(df.schema).format(k).load(store.export(df, at, f"to/{k}", k)) for k in ("json", "parquet")]
    return reduce(DataFrame.union, out).distinct()


@_query("SELECT n_nationkey, n_name, count(*) AS n FROM nation, range(2) GROUP BY n_nationkey, n_name")
def other_readers(spark, d):
    """ORC and JSON folders as tables of a session."""
    df, at = table(spark, d, "nation").select("n_nationkey", "n_name"), _folder(spark, "orc")
    df.write.orc(at)
    df.write.json(at + "-json")
    s = Session(spark)
    s.register("a", spark.read.orc(at))
    s.register("b", spark.read.schema(df.schema).json(at + "-json"))
    return s.sql("SELECT n_nationkey, n_name, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY n_nationkey, n_name")


@_query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // ((SELECT count(*) FROM customer) // 3 + 1)) AS page FROM customer")
def cursor_pages(spark, d):
    """All customers in three pages of a cursor."""
    s = _session(spark, d, "customer")
    size = s.table("customer").count() // 3 + 1
    s.cursor("c", "SELECT c_custkey FROM customer ORDER BY c_custkey", size)
    pages = [s.fetch("c").withColumn("page", F.lit(k).cast("long")) for k in range(3)]
    s.close("c")
    return reduce(DataFrame.unionByName, pages)


@_query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def rows_as_maps(spark, d):
    """Rows that a host program gets as maps and as lists."""
    s = _session(spark, d, "nation")
    maps = list(s.select_maps("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < $1", [10]))
    lists = list(s.select_arrays("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10"))
    return spark.createDataFrame([(m["k"], m["name"]) for m in maps] + [tuple(x) for x in lists], "k bigint, name string")


@_query("SELECT n_nationkey AS k, '[' || n_nationkey || ', \"' || n_name || '\", null, [true]]' AS json FROM nation")
def array_notation(spark, d):
    x = table(spark, d, "nation").selectExpr("n_nationkey AS k", "concat('[', n_nationkey, ',\"', n_name, '\",nil,[TRUE]]') AS t")
    return text.literal_to_json(x, "t", "json").select("k", "json")


@_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def synchronised_tables(spark, d):
    a, b = _session(spark, d, "nation", "region"), Session(spark)
    store.copy_tables(a, b)
    return b.table("nation").select("n_nationkey", "n_name").union(b.table("region").select("r_regionkey", "r_name"))


# --- streams, each run to its end and read back ---


def _stream(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    events, at = table(spark, d, "events"), _folder(spark, name)
    events.repartition(6, "event_id").write.parquet(f"{at}/in")
    return windows.event_stream(spark, f"{at}/in", events.schema, files_per_trigger=2), at


@_query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, d):
    stream, at = _stream(spark, d, "ingest")
    windows.buffered_append(stream, f"{at}/out", f"{at}/state").awaitTermination(300)
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


@_query("SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stream_fan_out(spark, d):
    """Each micro-batch is merged into a table of running counts."""
    stream, at = _stream(spark, d, "fan")
    counts = [spark.createDataFrame([], "k bigint, n bigint")]

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        counts[0] = cut(dml.upsert(counts[0], new, ["k"], {"n": "n + excluded.n"}))

    windows.fan_out(stream, merge, f"{at}/state").awaitTermination(300)
    return counts[0]


@_query("SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark, d):
    stream, at = _stream(spark, d, "totals")
    query = windows.running_totals(stream, "ts", "user_id", "value").writeStream.outputMode("update").format("memory").queryName("larkspur_totals")
    query.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start().awaitTermination(300)
    out = spark.table("larkspur_totals").groupBy("key").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return out.select("key", "x.n", F.round("x.total", 4).alias("total"))


@_query("SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def snapshot_counts(spark, d):
    """What a sampler that looks every minute would have counted."""
    x = windows.tumbling(table(spark, d, "events"), "ts", "60 seconds", [], [F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")])
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("minute"), "n", "users")


@_query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def rolling_retention(spark, d):
    """A time-to-live: rows a week older than the newest are deleted."""
    s = _session(spark, d, "events")
    s.sql("DELETE FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL '7' DAY")
    return s.sql("SELECT event_id, ts FROM events")


# --- rules and the expression language ---


@_query("SELECT * FROM (VALUES ('exact', 'all', 'Car', 'fuel', 'set', '0.5', 1), ('exact', 'all', 'Tank', 'armour', 'set', '9', 0)) AS v(match_type, source, target_type, property, operator, value, active)")
def live_patches(spark, d):
    s = Session(spark)
    boards.live_patch(s, "Car", "fuel", "0.5")
    boards.live_patch(s, "Tank", "armour", "9")
    boards.live_patch(s, "query", "UPDATE patch_rules SET active = 0 WHERE target_type = 'Tank'")
    return boards.live_patch(s, "list").select("match_type", F.lit("all").alias("source"), "target_type", "property", "operator", "value", "active")


@_query("SELECT p_partkey, CAST(CASE WHEN p_name LIKE '%ring' THEN p_size + 1000 WHEN p_name LIKE '%bolt' THEN p_size + 10 ELSE p_size END AS DOUBLE) AS v FROM part")
def rules_by_type(spark, d):
    """Rules for a kind hold for all kinds below it."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    names = parts.select("p_name").distinct()
    last = F.element_at(F.split("p_name", " "), -1)
    tree = names.select(F.col("p_name").alias("kind"), last.alias("parent")).unionAll(spark.createDataFrame([("ring", "round"), ("round", "thing"), ("thing", "round"), ("bolt", "long")], "kind string, parent string"))
    rules = spark.createDataFrame([(1, 1, 5, "type_of", "round", "add", "1000"), (2, 1, 4, "type_of", "long,nothing", "add", "10")], "id long, active int, priority int, match_type string, match_value string, operator string, value string")
    return boards.patched(parts, "p_partkey", "p_name", "p_size", rules, parents=tree).select("p_partkey", F.col("patched").cast("double").alias("v"))


@_query("""SELECT p_partkey, CAST(p_size + 2.5 AS DOUBLE) AS inc, CAST(p_size - 3 AS DOUBLE) AS sub, CAST(p_size * 4 AS DOUBLE) AS mul, CAST(p_size / 8.0 AS DOUBLE) AS div, 0.0::DOUBLE AS by_zero,
           CAST(p_size % 7 AS DOUBLE) AS mod, p_name || '!' AS cat, coalesce(p_name, 'x') AS deflt, round(p_retailprice, 1) AS rnd, CAST(least(greatest(p_size, 10), 20) AS DOUBLE) AS clamp, CAST(-p_size AS DOUBLE) AS negate,
           replace(p_name, 'ring', 'loop') AS repl, '<' || p_name || '>' AS frm, 'new' AS st, CASE WHEN p_size = 1 THEN 'false' ELSE 'true' END AS tog FROM part""")
def value_operators_all(spark, d):
    x = table(spark, d, "part")
    n, s, r = F.col("p_size").cast("string"), F.col("p_name"), F.col("p_retailprice").cast("string")
    one = lambda v, op, arg: boards.apply_operator(v, F.lit(op), F.lit(arg))
    num = lambda op, arg, v=n: one(v, op, arg).cast("double")
    return x.select(
        "p_partkey", num("inc", "2.5").alias("inc"), num("sub", "3").alias("sub"), num("mul", "4").alias("mul"), num("div", "8").alias("div"), num("div", "0").alias("by_zero"), num("mod", "7").alias("mod"),
        one(s, "cat", "!").alias("cat"), one(s, "default", "x").alias("deflt"), num("round", "1", r).alias("rnd"), num("clamp", "10|20").alias("clamp"), num("negate", "").alias("negate"),
        one(s, "replace", "ring|loop").alias("repl"), one(s, "format", "<%1>").alias("frm"), one(s, "set", "new").alias("st"), one(n, "toggle", "").alias("tog"),
    )


_X = "CAST(p_size AS DOUBLE)"
#: Expressions of the embedded language over _x (a number from 1 to 50), with their SQL.
_MATH = {
    "sqrt": ("sqrt _x", "sqrt({x})"), "sin": ("sin _x", "sin({x})"), "cos": ("cos _x", "cos({x})"), "tan": ("tan (_x / 60)", "tan({x} / 60)"), "abs": ("abs (3 - _x)", "abs(3 - {x})"),
    "exp": ("exp (_x / 10)", "exp({x} / 10)"), "ln": ("ln _x", "ln({x})"), "log": ("log _x", "log10({x})"), "log10": ("log10 _x", "log10({x})"), "asin": ("asin (1 / _x)", "asin(1 / {x})"),
    "acos": ("acos (1 / _x)", "acos(1 / {x})"), "atan": ("atan _x", "atan({x})"), "deg": ("deg _x", "degrees({x})"), "rad": ("rad _x", "radians({x})"), "cosec": ("cosec _x", "1 / sin({x})"),
    "sec": ("sec _x", "1 / cos({x})"), "cot": ("cot _x", "1 / tan({x})"), "round": ("round (_x / 3)", "round({x} / 3)"), "floor": ("floor (_x / -3)", "floor({x} / -3)"), "ceil": ("ceil (_x / -3)", "ceil({x} / -3)"),
    "trunc": ("trunc (_x / -3)", "trunc({x} / -3)"), "sign": ("sign (7 - _x)", "sign(7 - {x})"), "mins": ("_x min 9", "least({x}, 9)"), "maxs": ("9 max _x", "greatest(9, {x})"), "atan2": ("_x atan2 3", "atan2({x}, 3)"),
    "clamp": ("_x clamp [5, 20]", "least(greatest({x}, 5), 20)"), "rest": ("(_x + 0.5) % 7", "({x} + 0.5) % 7"), "power": ("2 ^ (_x / 10)", "power(2, {x} / 10)"), "zero": ("(_x / 0) max 1", "1"), "prec": ("1 + _x * 2 - -3", "1 + {x} * 2 + 3"),
}


@_query("SELECT p_partkey, " + ", ".join(f"round(CAST({sql.format(x=_X)} AS DOUBLE), 5) AS {n}" for n, (_, sql) in _MATH.items()) + " FROM part")
def sqf_math_all(spark, d):
    x = {"_x": F.col("p_size").cast("double")}
    return table(spark, d, "part").select("p_partkey", *[F.round(script.column(e, x).cast("double"), 5).alias(n) for n, (e, _) in _MATH.items()])


@_query("""SELECT p_partkey, p_name || '' AS s, upper(p_name) AS u, lower(p_name) AS l, 'STRING' AS kind, 'SCALAR' AS number, 'ARRAY' AS list, 'BOOL' AS truth, CAST(coalesce(TRY_CAST(trim(p_name) AS DOUBLE), 0) AS DOUBLE) AS p,
           CAST(p_size AS DOUBLE) AS q, trim(p_name) AS t, CAST(instr(p_name, 'ring') - 1 AS BIGINT) AS at, replace(p_name, 'ring', 'loop') AS r, CAST(3 AS BIGINT) AS n FROM part""")
def sqf_string_all(spark, d):
    v = {"_n": F.col("p_name"), "_k": F.col("p_size").cast("string"), "_pad": F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))}
    said = {
        "s": "str _n", "u": "toUpper _n", "l": "toLower _n", "kind": "typeName _n", "number": "typeName 1", "list": "typeName [1]", "truth": "typeName (1 == 1)", "p": "parseNumber _n", "q": "parseNumber _k", "t": "trim _pad",
        "at": "_n find 'ring'", "r": "_n replace ['ring', 'loop']", "n": "count 'abc'",
    }
    kinds = {"at": "long", "n": "long"}
    return table(spark, d, "part").select("p_partkey", *[script.column(e, v).cast(kinds[n]).alias(n) if n in kinds else script.column(e, v).alias(n) for n, e in said.items()])


@_query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS none, p_size IN (3, 7) AS there, CAST(4 AS BIGINT) AS pushed, CAST(9 AS DOUBLE) AS last, CAST(2 AS BIGINT) AS fewer,
           sqrt(p_size * p_size + 25.0) AS far, false AS nil, p_size = 7 AS same, p_size > 5 AND NOT p_size > 9 OR p_size = 1 AS logic, CAST(p_size AS DOUBLE) AS shown, true AS unknown, CAST(p_size + 1 AS DOUBLE) AS host, CAST(p_size AS DOUBLE) AS setter, true AS nular FROM part""")
def sqf_array_all(spark, d):
    v = {"_x": F.col("p_size").cast("double")}
    said = {
        "first": "[_x, 5, 6] select 0", "none": "[_x, 5, 6] select 9", "there": "_x in [3, 7]", "pushed": "count ([_x, 5, 6] pushBack 9)", "last": "([_x, 5, 6] pushBack 9) select 3", "fewer": "count ([_x, 5, 6] deleteAt 0)",
        "far": "vectorMagnitude [_x, 3, 4]", "nil": "isNil _x", "same": "_x isEqualTo 7", "logic": "_x > 5 && !(_x > 9) || _x == 1", "shown": "hint _x", "unknown": "isNil _nothing",
        "host": "diag_log (_x + 1)", "setter": "_x setDamage 3", "nular": "isNil allPlayers",
    }
    kinds = {"pushed": "long", "fewer": "long"}
    return table(spark, d, "part").select("p_partkey", *[script.column(e, v).cast(kinds[n]).alias(n) if n in kinds else script.column(e, v).alias(n) for n, e in said.items()])


@_query("SELECT p_partkey, " + ", ".join(f"round(CAST({sql.format(x=_X)} AS DOUBLE), 5) AS {n}" for n, (_, sql) in _MATH.items() if n not in ("zero",)) + " FROM part")
def sqf_eval_all(spark, d):
    """The same expressions from a text column, one text per number, evaluated in batches."""
    x = table(spark, d, "part")
    of = lambda e: F.replace(F.lit(e), F.lit("_x"), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")))
    return x.select("p_partkey", *[F.round(script.evaluate_column(of(e)).cast("double"), 5).alias(n) for n, (e, _) in _MATH.items() if n not in ("zero",)])
