"""Queries of the SQL surface; each runs through the session dialect and has a DuckDB oracle.

An entry is one text when both engines take it, or a pair (dialect text, DuckDB text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.fuzzy import SQL_FUNCTIONS
from larkspur.operators.recursion import lift_row_limit
from larkspur.plans.rewrite import lex, recursive_union, to_spark
from larkspur.plans.skew import row_hash
from larkspur.sources.tables import table

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "kill_events", "session_stats",
    "server_commands", "players", "progression", "loadout_templates", "player_loadouts", "player_blobs", "game_servers", "exam_items", "subject_areas", "subject_labels",
}

#: Trigram similarity of two expressions in DuckDB.
_TG = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: substr('  ' || lower({0}) || '  ', i, 3)))"


def _sim(a: str, b: str) -> str:
    x, y = _TG.format(a), _TG.format(b)
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


TEXTS: dict[str, str | tuple[str, str]] = {
    # scans, projections, predicates
    "scan_filter": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02",
    "pk_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777",
    "range_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_totalprice > 1000",
    "from_less_select": "SELECT 1 + 2 AS three, 'x' || 'y' AS xy",
    "values_source": "SELECT a, b FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(a, b)",
    "derived_table": "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE d.n > 10",
    "project_expr": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem",
    "star_and_expr": "SELECT *, n_nationkey * 2 AS twice FROM nation",
    "unary_not": "SELECT o_orderkey, -o_totalprice AS neg FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 5000)",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders",
    "like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%'",
    "like_contains": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_type NOT LIKE '%E%'",
    "like_single": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000__1_'",
    "similar_to": ("SELECT p_partkey, p_name FROM part WHERE p_name SIMILAR TO '%g'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%g'"),
    "match_ci": ("SELECT p_partkey, p_name FROM part WHERE p_name MATCH 'RING'", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')"),
    "between_in": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')",
    "not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40",
    "null_predicates": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_discount, 0) IS NULL AS free FROM lineitem WHERE nullif(l_tax, 0) IS NOT NULL",
    "null_safe_equal": ("SELECT id, killer_uid <=> victim_uid AS same FROM kill_events", "SELECT id, killer_uid IS NOT DISTINCT FROM victim_uid AS same FROM kill_events"),
    "cast_ops": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_custkey AS DOUBLE) AS d, CAST(o_custkey % 2 AS BOOLEAN) AS b FROM orders",
    "try_cast_text": "SELECT id, TRY_CAST(params AS BIGINT) AS n FROM server_commands",
    "trim_substr": "SELECT p_partkey, trim(LEADING 's' FROM p_name) AS l, trim(TRAILING 'g' FROM p_name) AS t, trim(BOTH 'e' FROM p_name) AS b, substring(p_name FROM 2 FOR 3) AS s FROM part",
    "str_funcs": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS r, CAST(instr(c_name, '#') AS BIGINT) AS i, substr(c_name, 3, 4) AS s, c_name || '/' || c_mktsegment AS j FROM customer",
    "octet_length": ("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes FROM documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents"),
    "math_funcs": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(l_discount - l_tax) AS a, round(sqrt(l_quantity), 6) AS q, l_discount * l_discount AS p, round(power(l_quantity, 2), 2) AS sq, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, CAST(floor(l_extendedprice) AS DOUBLE) AS f, CAST(sign(l_discount - l_tax) AS INT) AS s FROM lineitem",
    "integer_division": ("SELECT o_orderkey, o_custkey DIV 7 AS q, o_custkey % 7 AS r, o_custkey / 7 AS x FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r, o_custkey / 7 AS x FROM orders"),
    "date_parts": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders",
    "date_format": ("SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y-%m-%d %H:%i') AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS f FROM orders"),
    "date_diff": ("SELECT o_orderkey, CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS days FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders"),
    "unix_ts": ("SELECT event_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS s FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"),
    "date_shift_days": "SELECT event_id, ts + INTERVAL '3' DAY AS later, ts - INTERVAL '90' MINUTE AS earlier FROM events",
    "date_shift_months": "SELECT event_id, ts + INTERVAL '1' MONTH AS next_month FROM events",
    "time_filter": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
    "coalesce_ifnull": "SELECT id, coalesce(killer_uid, victim_uid, -1) AS who, ifnull(killer_weapon, 'none') AS w, nullif(distance, -1) AS d FROM kill_events",
    "typeof_tag": ("SELECT DISTINCT TYPEOF(l_quantity) AS q, TYPEOF(l_orderkey) AS k FROM lineitem", "SELECT DISTINCT CASE typeof(l_quantity) WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'real' ELSE 'text' END AS q, CASE typeof(l_orderkey) WHEN 'BIGINT' THEN 'integer' ELSE 'text' END AS k FROM lineitem"),
    "json_field": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "array_access": ("SELECT vec_id, round(CAST(embedding[0] AS DOUBLE), 5) AS x0, CAST(size(embedding) AS BIGINT) AS n FROM embeddings", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS x0, CAST(len(embedding) AS BIGINT) AS n FROM embeddings"),
    "array_explode": ("SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT label, explode(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY label", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT label, unnest(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY label"),
    "series": ("SELECT id AS n, id * id AS sq FROM range(1, 101)", "SELECT range AS n, range * range AS sq FROM range(1, 101)"),
    # joins
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
    "theta_join": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "right_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "full_join": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey - 50",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "comma_join": "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey",
    "natural_join": "SELECT * FROM (SELECT o_orderkey AS k, o_custkey FROM orders) a NATURAL JOIN (SELECT l_orderkey AS k, l_partkey, l_suppkey, l_linenumber FROM lineitem) b",
    "natural_left_join": "SELECT * FROM (SELECT p_partkey AS k, p_name FROM part) a NATURAL LEFT JOIN (SELECT s_suppkey AS k, s_name FROM supplier) b",
    "using_join": "SELECT k, o_totalprice, l_quantity, l_partkey, l_suppkey, l_linenumber FROM (SELECT o_orderkey AS k, o_totalprice FROM orders) a JOIN (SELECT l_orderkey AS k, l_quantity, l_partkey, l_suppkey, l_linenumber FROM lineitem) b USING (k)",
    "self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "three_way_join": "SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS customers FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name",
    "join_on_scalar_subq": "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)",
    "join_on_in_subq": "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "join_on_exists": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0)", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0)"),
    "join_derived": "SELECT c.c_custkey, t.n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey",
    "join_group_having_order": "SELECT n.n_name, CAST(count(*) AS BIGINT) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 20 ORDER BY n DESC, n_name LIMIT 10",
    "semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    # subqueries
    "scalar_subq": "SELECT o_orderkey, o_totalprice - (SELECT min(o_totalprice) FROM orders) AS over FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "corr_scalar_agg": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "in_subq": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "tuple_in": "SELECT o_orderkey FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey)",
    "nested_subq": "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)))",
    # aggregation
    "group_count": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_expr_alias": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY y",
    "group_dedup": "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey",
    "first_of_group": ("SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey"),
    "global_agg": "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem",
    "global_agg_empty": "SELECT CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0",
    "having_agg": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000",
    "having_global": "SELECT CAST(count(*) AS BIGINT) AS n FROM orders HAVING count(*) > 10",
    "having_alias": "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand HAVING n > 5",
    "count_distinct": "SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS types, CAST(count(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand",
    "count_expr_nulls": "SELECT server_id, CAST(count(*) AS BIGINT) AS n, CAST(count(killer_uid) AS BIGINT) AS known FROM kill_events GROUP BY server_id",
    "sum_avg_min_max": "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment",
    "group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name, '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_filter": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s FROM orders GROUP BY o_orderpriority",
    "agg_expr_ratio": "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS r, -max(l_quantity) AS m, sum(nullif(l_tax, l_tax)) IS NULL AS no_tax FROM lineitem GROUP BY l_returnflag",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "group_by_all": "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL",
    # windows
    "row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r FROM part",
    "dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r FROM part",
    "lag_default": "SELECT event_id, lag(value, 1, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "lead": "SELECT event_id, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events",
    "first_value": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events",
    "last_value_full": "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events",
    "running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events",
    "moving_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events",
    "range_sum": "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM part",
    "groups_sum": "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part",
    "window_total": "SELECT n_nationkey, CAST(sum(n_nationkey) OVER () AS BIGINT) AS total, min(n_name) OVER (PARTITION BY n_regionkey) AS first_name FROM nation",
    "ntile_nth": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS c FROM supplier",
    "qualify_top": "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3",
    # order, limit
    "order_multi_nulls": "SELECT id, killer_uid, distance FROM kill_events ORDER BY killer_uid ASC NULLS LAST, distance DESC NULLS FIRST, id",
    "order_expr_position": "SELECT p_partkey, p_size * 2 AS s FROM part ORDER BY 2 DESC, 1",
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 5 ROWS ONLY FOR UPDATE", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5"),
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    # set operations
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "except_distinct": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "intersect_distinct": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "nested_setops": "(SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000 INTERSECT SELECT n_nationkey FROM nation)",
    # CTEs
    "cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b(k, total) AS (SELECT o_custkey, t FROM a WHERE t > 500000) SELECT k, round(total, 2) AS total FROM b",
    "cte_materialized": "WITH a AS MATERIALIZED (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT x.n_regionkey, y.n FROM a x JOIN a y ON x.n_regionkey = y.n_regionkey",
    "recursive_numbers": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "recursive_tree": ("WITH RECURSIVE tr(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 10 UNION ALL SELECT p.p_partkey, tr.depth + 1 FROM part p JOIN tr ON p.p_partkey DIV 10 = tr.k WHERE p.p_partkey >= 10) SELECT k, depth FROM tr", "WITH RECURSIVE tr(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 10 UNION ALL SELECT p.p_partkey, tr.depth + 1 FROM part p JOIN tr ON p.p_partkey // 10 = tr.k WHERE p.p_partkey >= 10) SELECT k, depth FROM tr"),
    "recursive_cycle_distinct": "WITH RECURSIVE walk(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (w.k * 2) % 25 FROM walk w) SELECT k FROM walk",
    # fuzzy
    "fuzzy_match": ("SELECT p_partkey, p_name FROM part WHERE p_name %% 'steel ring'", f"SELECT p_partkey, p_name FROM part WHERE {_sim('p_name', "'steel ring'")} >= 0.3"),
    "fuzzy_threshold": ("SELECT DISTINCT p_name FROM part WHERE fuzzy_match(p_name, 'ring', 0.2)", f"SELECT DISTINCT p_name FROM part WHERE {_sim('p_name', "'ring'")} >= 0.2"),
    "fts_score": ("SELECT DISTINCT p_name, round(fts_score(p_name, 'bolt'), 6) AS score FROM part", f"SELECT DISTINCT p_name, round({_sim('p_name', "'bolt'")}, 6) AS score FROM part"),
    # workload
    "leaderboard_top10": "SELECT s.s_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(l.l_quantity) AS DOUBLE) AS q FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_quantity > 5 GROUP BY s.s_name HAVING count(*) > 1 ORDER BY n DESC, s_name LIMIT 10",
    "weapon_top10": "SELECT lower(trim(killer_weapon)) AS weapon, CAST(count(*) AS BIGINT) AS kills FROM (SELECT DISTINCT * FROM kill_events) WHERE killer_weapon IS NOT NULL GROUP BY 1 ORDER BY kills DESC, weapon LIMIT 10",
    "headshot_leaders": "SELECT killer_uid, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT * FROM kill_events) WHERE headshot = 1 AND killer_uid <> 0 GROUP BY killer_uid ORDER BY n DESC, killer_uid LIMIT 10",
    "kill_death": (
        "WITH e AS (SELECT DISTINCT killer_uid, victim_uid, id, row_hash FROM kill_events_hashed), r AS (SELECT stack(2, killer_uid, 1, victim_uid, 0) AS (uid, kill) FROM e) SELECT uid, count_if(kill = 1) AS kills, count_if(kill = 0) AS deaths FROM r WHERE uid <> 0 GROUP BY uid",
        "WITH e AS (SELECT DISTINCT * FROM kill_events), k AS (SELECT killer_uid AS uid, count(*) AS kills FROM e WHERE killer_uid <> 0 GROUP BY killer_uid), d AS (SELECT victim_uid AS uid, count(*) AS deaths FROM e WHERE victim_uid <> 0 GROUP BY victim_uid) SELECT coalesce(k.uid, d.uid) AS uid, coalesce(kills, 0) AS kills, coalesce(deaths, 0) AS deaths FROM k FULL OUTER JOIN d ON k.uid = d.uid",
    ),
    "stats_differences": (
        "WITH e AS (SELECT DISTINCT killer_uid, id, row_hash FROM kill_events_hashed), k AS (SELECT killer_uid AS uid, count(*) AS kills FROM e GROUP BY killer_uid), s AS (SELECT DISTINCT uid, kills, row_hash FROM session_stats_hashed) SELECT s.uid, s.kills AS stated, coalesce(k.kills, 0) AS counted FROM s LEFT JOIN k ON s.uid = k.uid WHERE s.kills IS NULL OR s.kills <> coalesce(k.kills, 0)",
        "WITH e AS (SELECT DISTINCT * FROM kill_events), k AS (SELECT killer_uid AS uid, count(*) AS kills FROM e GROUP BY killer_uid), s AS (SELECT DISTINCT * FROM session_stats) SELECT s.uid, s.kills AS stated, coalesce(k.kills, 0) AS counted FROM s LEFT JOIN k ON s.uid = k.uid WHERE s.kills IS NULL OR s.kills <> coalesce(k.kills, 0)",
    ),
    "player_ratio": "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases, round(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 6) AS ratio FROM events GROUP BY user_id",
    "templates_per_faction": "SELECT upper(faction) AS faction, CAST(count(*) AS BIGINT) AS n FROM loadout_templates GROUP BY upper(faction)",
    "command_queue": "SELECT DISTINCT id, lower(trim(command)) AS command FROM server_commands WHERE lower(trim(status)) = 'pending' ORDER BY id LIMIT 50",
    "replay_order": "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts, event_id",
    "tumbling_window": ("SELECT CAST(w.start AS TIMESTAMP_NTZ) AS start, event_type, n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 hour') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2)", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sliding_window": ("SELECT CAST(w.start AS TIMESTAMP_NTZ) AS start, n FROM (SELECT window(CAST(ts AS TIMESTAMP), '2 hours', '1 hour') AS w, count(*) AS n FROM events GROUP BY 1)", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' FROM events) GROUP BY start"),
    "session_window": ("SELECT user_id, CAST(w.start AS TIMESTAMP_NTZ) AS start, CAST(w.end AS TIMESTAMP_NTZ) AS ends, n FROM (SELECT user_id, session_window(CAST(ts AS TIMESTAMP), '6 hours') AS w, count(*) AS n FROM events GROUP BY 1, 2)", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS ends, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g"),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        from larkspur.plans.session import Session

        words = {t.low for t in lex(text) if t.kind == "word"}
        for name in sorted(TABLES & words):
            table(spark, d, name).createOrReplaceTempView(name)
        for name in sorted(w for w in words if w.endswith("_hashed")):
            # A row's hash tells repeated rows, so that only the columns in use travel.
            raw = table(spark, d, name.removesuffix("_hashed"))
            raw.withColumn("row_hash", row_hash(raw)).createOrReplaceTempView(name)
        if recursive_union(text):
            return Session(spark).sql(text)
        if "recursive" in words:
            lift_row_limit(spark)
        if "fuzzy" in text or "fts_score" in text or "%%" in text:
            for statement in SQL_FUNCTIONS:
                spark.sql(statement)
        return spark.sql(to_spark(text))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _run(t if isinstance(t, str) else t[0]) for n, t in TEXTS.items()}
SQL: dict[str, str] = {n: t if isinstance(t, str) else t[1] for n, t in TEXTS.items()}
