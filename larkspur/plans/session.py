"""A SQL session: queries through Catalyst, writes as new table versions."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import script
from larkspur.operators import dml
from larkspur.operators.fuzzy import SQL_FUNCTIONS
from larkspur.operators.recursion import lift_row_limit, recursive_distinct
from larkspur.plans import rewrite
from larkspur.plans.catalog import CatalogError, Column, ConstraintError, ForeignKey, State, TableMeta, Trigger, sql_type
from larkspur.plans.materialize import cut
from larkspur.plans.ship import ship

#: Versions of a table after which its lineage is cut.
CUT_EVERY = 8
#: Deepest nesting of triggers.
MAX_TRIGGER_DEPTH = 16
#: Statements slower than this many seconds go to the slow log.
SLOW_SECONDS = 0.01

#: Logical operators by the names that EXPLAIN JSON gives them.
OPERATORS = {
    "LogicalRDD": "SeqScan", "LogicalRelation": "SeqScan", "LocalRelation": "SeqScan", "OneRowRelation": "Values", "Aggregate": "GroupBy", "Sort": "OrderBy", "GlobalLimit": "Limit",
    "LocalLimit": "Limit", "Deduplicate": "Distinct", "WithCTE": "With", "CTERelationDef": "Cte", "CTERelationRef": "CteScan",
}

_NAME = r"(?:`[^`]+`|[\w.]+)"


@dataclass
class Cursor:
    frame: DataFrame
    page: int
    at: int = 0


class Session:
    """Entry point for SQL in the engine's dialect.

    ``profile='compat'`` keeps useful quirks of the dialect (glob ``REGEXP``,
    non-ANSI arithmetic that gives null instead of an error); ``'ansi'`` follows
    the standard.  Triggers, constraints and transactions live on the driver;
    rows never do.
    """

    def __init__(self, spark: SparkSession, profile: str = "ansi") -> None:
        if profile not in ("ansi", "compat"):
            raise ValueError("profile must be 'ansi' or 'compat'")
        self.spark, self.profile = spark, profile
        self.state = State()
        self.saved: list[tuple[str | None, State]] = []
        self.settings: dict[str, str] = {}
        self.prepared: dict[str, tuple[str, int]] = {}
        self.cursors: dict[str, Cursor] = {}
        self.pre_hooks: list[Callable[[str], None]] = []
        self.post_hooks: list[Callable[[str, DataFrame], None]] = []
        self.slow_log: list[tuple[str, float]] = []
        self.changes = 0
        self.last_insert_rowid: int | None = None
        self._depth = 0
        for statement in SQL_FUNCTIONS:
            spark.sql(statement)
        lift_row_limit(spark)
        ship(spark)
        spark.udf.register("sqf_eval", script.evaluator())

    # --- names ---

    def register(self, name: str, df: DataFrame, meta: TableMeta | None = None) -> None:
        """Make ``df`` a table of the session."""
        name = name.lower()
        meta = meta or TableMeta(tuple(Column(f.name, f.dataType) for f in df.schema.fields))
        self.state.meta[name] = meta
        self._store(name, df)

    def table(self, name: str) -> DataFrame:
        try:
            return self.state.tables[name.lower().strip("`")]
        except KeyError:
            raise CatalogError(f"no table {name}") from None

    def _store(self, name: str, df: DataFrame) -> None:
        n = self.state.versions.get(name, 0) + 1
        self.state.versions[name] = n
        if n % CUT_EVERY == 0:
            df = cut(df)
        self.state.tables[name] = df
        df.createOrReplaceTempView(name)

    def _restore(self, state: State) -> None:
        for name in self.state.tables.keys() | self.state.views.keys():
            if name not in state.tables and name not in state.views:
                self.spark.catalog.dropTempView(name)
        self.state = state
        for name, df in state.tables.items():
            df.createOrReplaceTempView(name)
        for name, sql in state.views.items():
            self._query(sql).createOrReplaceTempView(name)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # --- entry points ---

    def sql(self, sql: str, args: list | None = None) -> DataFrame:
        """Run one statement; ``$1 ...`` take their values from ``args``."""
        for hook in self.pre_hooks:
            hook(sql)
        start = time.perf_counter()
        params: dict = {}
        bound = sql
        if args:
            bound, params = rewrite.bind(sql, args)
        # Literals hide their content until the clauses are told apart.
        out = self._dispatch(rewrite.masked(bound).rstrip(";").strip(), params)
        took = time.perf_counter() - start
        if took > SLOW_SECONDS:
            self.slow_log.append((sql, took))
        for hook in self.post_hooks:
            hook(sql, out)
        return out

    def run(self, batch: str, args: list | None = None) -> list[DataFrame]:
        """Run all statements of a batch."""
        return [self.sql(s, args) for s in rewrite.split_statements(batch)]

    def prepare(self, name: str, sql: str) -> None:
        count = max([int(t.text[1:]) for t in rewrite.lex(sql) if t.kind == "param"], default=0)
        self.prepared[name.lower()] = (sql, count)

    def execute(self, name: str, args: list | None = None) -> DataFrame:
        if name.lower() not in self.prepared:
            raise CatalogError(f"no prepared statement {name}")
        sql, count = self.prepared[name.lower()]
        if len(args or []) != count:
            raise ValueError(f"{name} takes {count} values")
        return self.sql(sql, args)

    def cursor(self, name: str, sql: str, page: int = 100) -> None:
        """Open a paging cursor; the query's result is settled once, so pages agree with each other."""
        frame = self.sql(sql)
        order = F.monotonically_increasing_id()
        self.cursors[name.lower()] = Cursor(cut(frame.withColumn("_no", order)), page)

    def fetch(self, name: str, n: int | None = None) -> DataFrame:
        if name.lower() not in self.cursors:
            raise CatalogError(f"no cursor {name}")
        c = self.cursors[name.lower()]
        out = c.frame.orderBy("_no").offset(c.at).limit(n or c.page).drop("_no")
        c.at += n or c.page
        return out

    def close(self, name: str) -> None:
        self.cursors.pop(name.lower(), None)

    def register_function(self, name: str, args: list[str], body: str) -> None:
        """A scalar SQL function, inlined by Catalyst; ``args`` like ``['x DOUBLE']``."""
        returns = ""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(args)}) {returns} RETURN {rewrite.to_spark(body, self.profile)}")

    def register_aggregate(self, name: str, function: Callable, returns: str) -> None:
        """An aggregate over a group's values (a pandas Series to one value); a group must fit one task."""
        def aggregate(values: pd.Series) -> object:
            return function(values)

        aggregate.__annotations__["return"] = object
        self.spark.udf.register(name, F.pandas_udf(aggregate, returns, F.PandasUDFType.GROUPED_AGG))

    def register_table_function(self, name: str, function: Callable[..., Iterator[tuple]], returns: str) -> None:
        """A table function: ``function`` yields rows for its arguments; ``returns`` like ``'n INT, sq INT'``."""
        handler = type(name, (), {"eval": lambda _self, *args: function(*args)})
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def register_python(self, name: str, function: Callable, returns: str) -> None:
        """A vectorised function (Arrow batches), for what SQL cannot say."""
        self.spark.udf.register(name, F.pandas_udf(function, returns))

    # --- dispatch ---

    def _dispatch(self, sql: str, params: dict) -> DataFrame:
        words = [t.low for t in rewrite.lex(sql)[:12] if t.kind == "word"]
        first = words[0] if words else ""
        if first == "with" and (parts := rewrite.recursive_union(sql)):
            return self._recursive(parts)
        if first == "select" and (m := re.match(r"(?is)^(select\s.*?)\sinto\s+(?:table\s+)?(\w+)(\s.*)?$", sql)):
            if not re.search(r"(?is)\bfrom\b", m[1]):
                out = self._query(m[1] + (m[3] or ""), params)
                self.register(m[2], cut(out))
                return out
        if first in ("select", "with", "values", "table", "from", ""):
            return self._query(sql, params)
        handler = getattr(self, f"_do_{first}", None)
        if handler is None:
            raise rewrite.SqlError(f"unsupported statement: {first.upper()}")
        return handler(sql, params)

    def _query(self, sql: str, params: dict | None = None) -> DataFrame:
        row_id = self.last_insert_rowid
        values = {"changes": f"CAST({self.changes} AS BIGINT)", "last_insert_rowid": "CAST(0 AS BIGINT)" if row_id is None else f"CAST({row_id} AS BIGINT)"}
        text = rewrite.to_spark(sql, self.profile, values, {n: m.primary for n, m in self.state.meta.items()})
        if self.profile == "ansi":
            return self.spark.sql(text, args=params or None)
        # Expressions take their overflow and error mode when they are analysed, which is now.
        before = self.spark.conf.get("spark.sql.ansi.enabled")
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            return self.spark.sql(text, args=params or None)
        finally:
            self.spark.conf.set("spark.sql.ansi.enabled", before)

    def _recursive(self, p: rewrite.RecursiveUnion) -> DataFrame:
        seed = self._query(p.seed)
        seed = seed.toDF(*p.columns) if p.columns else seed

        def step(front: DataFrame) -> DataFrame:
            front.createOrReplaceTempView(p.name)
            return self._query(p.step)

        recursive_distinct(seed, step).createOrReplaceTempView(p.name)
        return self._query(p.body)

    def _done(self, n: int) -> DataFrame:
        self.changes = n
        return self._rows([(n,)], "changes bigint")

    # --- writes ---

    def _values(self, name: str, sql: str, params: dict) -> DataFrame:
        """New rows of an INSERT, in the table's columns, with defaults and numbers filled in."""
        meta = self.state.meta[name]
        names = [c.name for c in meta.columns]
        m = re.match(r"(?is)^\s*(\(([^()]*)\))?\s*((?:values|select|with)\b.*)$", sql)
        if not m:
            raise rewrite.SqlError("INSERT needs VALUES or a query")
        given = [c.strip().strip("`").lower() for c in m[2].split(",")] if m[2] else names
        body = m[3]
        if re.match(r"(?is)^default\s+values", body):
            rows = self.spark.range(1).select()
        else:
            source = self._query(("SELECT * FROM (" + body + ")") if body[:6].lower() == "values" else body, params)
            if len(source.columns) != len(given):
                raise rewrite.SqlError(f"{len(given)} columns but {len(source.columns)} values")
            rows = source.toDF(*given)
        out = []
        for c in meta.columns:
            value = F.col(f"`{c.name}`") if c.name in given else (F.expr(rewrite.to_spark(c.default)) if c.default else F.lit(None))
            out.append(value.cast(c.type).alias(c.name))
        rows = rows.select(*out)
        for c in meta.columns:
            if c.auto:
                top = self.table(name).agg(F.max(c.name)).first()[0] or 0
                rows = dml.number_rows(rows, c.name, int(top), [x for x in names if x != c.name] or [c.name])
        return cut(rows)

    def _check(self, name: str, rows: DataFrame, rest: DataFrame) -> None:
        """Refuse the new ``rows`` of a table if they break a constraint; ``rest`` are the rows that stay, which broke none.

        Only the new rows' keys are compared, so a write costs one look at the
        table's keys and no regrouping of them.
        """
        meta = self.state.meta[name]
        must = [c.name for c in meta.columns if c.not_null or c.name in meta.primary]
        faults = {f"NOT NULL constraint of {name} ({c})": F.col(f"`{c}`").isNull() for c in must}
        faults |= {f"CHECK constraint of {name}: {x}": ~F.coalesce(F.expr(rewrite.to_spark(x)), F.lit(True)) for x in meta.checks}
        if faults:
            found = rows.agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f"f{i}") for i, f in enumerate(faults.values())]).first()
            for message, bad in zip(faults, found):
                if bad:
                    raise ConstraintError(message)
        for keys in [*([meta.primary] if meta.primary else []), *meta.unique]:
            new = rows.select(*keys).dropna("any")
            twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            if not twice.unionByName(rest.select(*keys).join(new, list(keys), "left_semi")).isEmpty():
                raise ConstraintError(f"UNIQUE constraint of {name} ({', '.join(keys)})")
        for fk in meta.foreign:
            parent = rest.unionByName(rows) if fk.parent == name else self.table(fk.parent)
            if not dml.fk_violations(rows, fk.column, parent, fk.parent_column).isEmpty():
                raise ConstraintError(f"FOREIGN KEY constraint of {name}.{fk.column} to {fk.parent}")

    def _returning(self, sql: str) -> tuple[str, str | None]:
        m = re.search(r"(?is)\sreturning\s+(.+)$", sql)
        return (sql[: m.start()], m[1]) if m else (sql, None)

    def _project(self, rows: DataFrame, items: str) -> DataFrame:
        rows.createOrReplaceTempView("__returning")
        return self._query(f"SELECT {items} FROM __returning")

    def _finish(self, name: str, rows: DataFrame, after: DataFrame, returning: str | None, events: dict[str, DataFrame]) -> DataFrame:
        """Swap the table version, fire triggers and answer.  ``events`` holds pairs of old and new rows by event.

        A trigger that raises undoes the whole statement.
        """
        before = self.state.copy()
        try:
            for event, pairs in events.items():
                self._fire(name, "before", event, pairs)
            self._store(name, after)
            for event, pairs in events.items():
                self._fire(name, "after", event, pairs)
        except Exception:
            self._restore(before)
            raise
        n = rows.count()
        if returning:
            out = self._project(rows, returning)
            self.changes = n
            return out
        return self._done(n)

    def _do_insert(self, sql: str, params: dict) -> DataFrame:
        sql, returning = self._returning(sql)
        m = re.match(rf"(?is)^insert\s+(?:or\s+(ignore|replace|rollback|abort|fail)\s+|(ignore)\s+)?into\s+({_NAME})\s*(.*)$", sql)
        if not m:
            raise rewrite.SqlError("cannot read INSERT")
        mode, name, rest = (m[1] or m[2] or "").lower(), m[3].lower().strip("`"), m[4]
        conflict = re.search(r"(?is)\son\s+conflict\s*(?:\(([^)]*)\))?\s*do\s+(nothing|update\s+set\s+(.*?)(?:\swhere\s+(.*))?)$", rest)
        rest = rest[: conflict.start()] if conflict else rest
        old, meta = self.table(name), self.state.meta[name]
        rows = self._values(name, rest, params)
        keys = list(meta.primary) or (list(meta.unique[0]) if meta.unique else [])
        if conflict and conflict[1]:
            keys = [c.strip().lower() for c in conflict[1].split(",")]
        if mode == "ignore" or (conflict and conflict[2].lower() == "nothing"):
            rows = cut(dml.last_per_key(rows, keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)) if keys else rows
            rest = old
        elif mode == "replace" and keys:
            rows = cut(dml.last_per_key(rows, keys))
            rest = old.join(rows.select(*keys), keys, "left_anti").select(*old.columns)
        elif conflict:
            where = rewrite.to_spark(conflict[4], self.profile) if conflict[4] else None
            touched = rows.select(*keys).distinct()
            hit = old.join(touched, keys, "left_semi").select(*old.columns)
            rest = old.join(touched, keys, "left_anti").select(*old.columns)
            rows = cut(dml.upsert(hit, rows, keys, self._assignments(conflict[3]), where))
        else:
            rest = old
        after = rest.unionByName(rows)
        try:
            self._check(name, rows, rest)
        except ConstraintError:
            if mode == "rollback" and self.saved:
                self._restore(self.saved[0][1])
                self.saved.clear()
            raise
        auto = next((c.name for c in meta.columns if c.auto), None)
        if auto:
            self.last_insert_rowid = rows.agg(F.max(auto)).first()[0]
        return self._finish(name, rows, after, returning, {"insert": _pairs(None, rows)})

    def _do_replace(self, sql: str, params: dict) -> DataFrame:
        return self._do_insert(re.sub(r"(?is)^replace\s+into", "INSERT OR REPLACE INTO", sql), params)

    def _assignments(self, body: str) -> dict[str, str]:
        out = {}
        for part in rewrite.arguments(rewrite.lex(body)):
            name, _, value = rewrite.text(part).partition("=")
            out[name.strip().lower().strip("`")] = rewrite.to_spark(value.strip(), self.profile)
        return out

    def _split_by(self, name: str, where: str | None, params: dict) -> tuple[DataFrame, DataFrame]:
        """Rows that a condition hits and all others; the condition may hold subqueries."""
        old = self.table(name)
        if where is None:
            return old, old.limit(0)
        hit = self._query(f"SELECT * FROM {name} WHERE {where}", params)
        rest = self._query(f"SELECT * FROM {name} WHERE NOT coalesce(({where}), false)", params)
        return hit, rest

    def _do_update(self, sql: str, params: dict) -> DataFrame:
        sql, returning = self._returning(sql)
        m = re.match(rf"(?is)^update\s+({_NAME})\s+set\s+(.*)$", sql)
        if not m:
            raise rewrite.SqlError("cannot read UPDATE")
        name = m[1].lower().strip("`")
        body, where = _top_level_where(m[2])
        assign = self._assignments(body)
        hit, rest = self._split_by(name, where, params)
        hit.createOrReplaceTempView("__hit")
        kinds = dict(hit.dtypes)
        unknown = set(assign) - set(kinds)
        if unknown:
            raise rewrite.SqlError(f"no column {sorted(unknown)} in {name}")
        new = ", ".join(f"CAST({assign[c]} AS {kinds[c]}) AS `new_{c}`" if c in assign else f"`{c}` AS `new_{c}`" for c in hit.columns)
        both = ", ".join(f"`{c}` AS `old_{c}`" for c in hit.columns)
        pairs = cut(self.spark.sql(f"SELECT {both}, {new} FROM __hit", args=params or None))
        rows = _side(pairs, "new", hit.columns)
        after = rest.unionByName(rows)
        self._check(name, rows, rest)
        before = self.state.copy()
        try:
            self._moved(name, pairs, set(assign), after)
            return self._finish(name, rows, after, returning, {"update": pairs})
        except Exception:
            self._restore(before)
            raise

    def _do_delete(self, sql: str, params: dict) -> DataFrame:
        sql, returning = self._returning(sql)
        m = re.match(rf"(?is)^delete\s+from\s+({_NAME})\s*(?:using\s+(.+?))?(?:\s*where\s+(.+))?$", sql)
        if not m:
            raise rewrite.SqlError("cannot read DELETE")
        name, using, where = m[1].lower().strip("`"), m[2], m[3]
        if using:
            where = f"EXISTS (SELECT 1 FROM {using} WHERE {where or 'true'})"
        hit, rest = self._split_by(name, where, params)
        hit = cut(hit)
        before = self.state.copy()
        try:
            self._children(name, hit, rest)
            return self._finish(name, hit, rest, returning, {"delete": _pairs(hit, None)})
        except Exception:
            self._restore(before)
            raise

    def _moved(self, name: str, pairs: DataFrame, assigned: set[str], after: DataFrame) -> None:
        """Foreign keys that point to keys which an update changes: children follow, lose the reference or forbid it."""
        for child, meta in list(self.state.meta.items()):
            for fk in meta.foreign:
                if fk.parent != name or fk.parent_column not in assigned:
                    continue
                gone = pairs.select(F.col(f"old_{fk.parent_column}").alias("_old"), F.col(f"new_{fk.parent_column}").alias("_new"))
                gone = gone.filter("_old IS NOT NULL AND NOT (_old <=> _new)")
                still = after.select(F.col(fk.parent_column).alias("_old"))
                gone = cut(gone.join(still, "_old", "left_anti").dropDuplicates(["_old"]))
                # A table that refers to itself follows in its new version, which is stored afterwards.
                kids = after if child == name else self.table(child)
                if fk.on_update in ("cascade", "set null"):
                    x = kids.join(gone, kids[fk.column] == gone["_old"], "left")
                    value = F.col("_new") if fk.on_update == "cascade" else F.lit(None)
                    kind = dict(kids.dtypes)[fk.column]
                    new = F.when(F.col("_old").isNotNull(), value.cast(kind)).otherwise(F.col(f"`{fk.column}`"))
                    if child == name:
                        raise ConstraintError(f"ON UPDATE of a reference of {name} to itself is not supported")
                    moved = cut(x.select(F.col("_old").isNotNull().alias("_hit"), *[F.col(f"`{c}`").alias(f"old_{c}") for c in kids.columns], *[(new if c == fk.column else F.col(f"`{c}`")).alias(f"new_{c}") for c in kids.columns]))
                    self._moved(child, moved.filter("_hit"), {fk.column}, _side(moved, "new", kids.columns))
                    self._store(child, _side(moved, "new", kids.columns))
                elif not kids.join(gone, kids[fk.column] == gone["_old"], "left_semi").isEmpty():
                    raise ConstraintError(f"rows of {child} refer to {name}.{fk.parent_column}")

    def _children(self, name: str, old_rows: DataFrame, after: DataFrame) -> None:
        """Foreign keys that point to rows which are about to go."""
        for child, meta in list(self.state.meta.items()):
            for fk in meta.foreign:
                if fk.parent != name:
                    continue
                gone = old_rows.select(fk.parent_column).join(after.select(fk.parent_column), fk.parent_column, "left_anti")
                rule = fk.on_delete
                kids = self.table(child)
                if rule == "cascade":
                    hit = kids.join(gone, kids[fk.column] == gone[fk.parent_column], "left_semi")
                    left = cut(dml.cascade_delete(kids, fk.column, gone, fk.parent_column))
                    self._children(child, cut(hit), left)
                    self._store(child, left)
                elif rule == "set null":
                    self._store(child, cut(dml.cascade_set_null(kids, fk.column, gone, fk.parent_column)))
                elif not kids.join(gone, kids[fk.column] == gone[fk.parent_column], "left_semi").isEmpty():
                    raise ConstraintError(f"rows of {child} refer to {name}.{fk.parent_column}")

    def _do_merge(self, sql: str, params: dict) -> DataFrame:
        sql, returning = self._returning(sql)
        m = re.match(rf"(?is)^merge\s+into\s+({_NAME})(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s+(\(.*?\)|{_NAME})(?:\s+(?:as\s+)?(?!on\b)(\w+))?\s+on\s+(.*?)\s+(when\s.*)$", sql)
        if not m:
            raise rewrite.SqlError("cannot read MERGE")
        name, t, source, s, on, rest = m[1].lower(), m[2] or m[1], m[3], m[4] or m[3], m[5], m[6]
        clauses = re.findall(r"(?is)when\s+(not\s+)?matched\s*(?:and\s+(.*?))?\s*then\s+(.*?)(?=\swhen\s+(?:not\s+)?matched|$)", rest)
        old = self.table(name)
        cols, kinds = old.columns, dict(old.dtypes)
        # Rows may be equal, so each gets a number of its own, written down for the two looks at them.
        cut(old.withColumn("__id", F.monotonically_increasing_id())).createOrReplaceTempView("__merge_target")
        matched = [(c or "true", a.strip()) for n, c, a in clauses if not n]
        fresh = [(c or "true", a.strip()) for n, c, a in clauses if n]

        def first(conditions: list[str]) -> str:
            # The first clause whose condition holds is the one that acts.
            cases = " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(conditions))
            return f"CASE {cases} ELSE -1 END" if cases else "-1"

        act = first([c for c, _ in matched])
        value = {c: f"{t}.`{c}`" for c in cols}
        for i, (_, action) in enumerate(matched):
            if action.lower() != "delete":
                for c, e in self._assignments(re.sub(r"(?is)^update\s+set\s+", "", action)).items():
                    c = c.split(".")[-1]
                    value[c] = f"CASE WHEN ({act}) = {i} THEN {e} ELSE {value[c]} END"
        both = ", ".join([f"{t}.`{c}` AS `old_{c}`" for c in cols] + [f"CAST({value[c]} AS {kinds[c]}) AS `new_{c}`" for c in cols])
        hit = self._query(f"SELECT {t}.__id, {act} AS __act, {both} FROM __merge_target {t} JOIN {source} {s} ON {on}", params)
        # Of several partners of one row the greatest outcome counts, once.
        hit = cut(dml.last_per_key(hit.filter("__act >= 0"), ["__id"]))
        deletes = [i for i, (_, action) in enumerate(matched) if action.lower() == "delete"]
        rest_rows = self.spark.table("__merge_target").join(hit.select("__id"), "__id", "left_anti").select(*cols)
        changed, dropped = hit.filter(~F.col("__act").isin(deletes)), hit.filter(F.col("__act").isin(deletes))
        rows = _side(changed, "new", cols)
        events = {"update": changed.drop("__id", "__act"), "delete": _pairs(_side(dropped, "old", cols), None)}
        if fresh:
            which = first([c for c, _ in fresh])
            given: dict[str, str] = {}
            for i, (_, action) in enumerate(fresh):
                a = re.match(r"(?is)insert\s*(?:\((.*?)\))?\s*values\s*\((.*)\)$", action)
                names = [c.strip().lower().strip("`") for c in a[1].split(",")] if a[1] else cols
                for c, v in zip(names, rewrite.arguments(rewrite.lex(a[2]))):
                    given[c] = f"CASE WHEN ({which}) = {i} THEN {rewrite.text(v)} ELSE {given.get(c, 'NULL')} END"
            items = ", ".join(f"CAST({given.get(c, 'NULL')} AS {kinds[c]}) AS `{c}`" for c in cols)
            new = cut(self._query(f"SELECT {items} FROM {source} {s} WHERE NOT EXISTS (SELECT 1 FROM __merge_target {t} WHERE {on}) AND ({which}) >= 0", params))
            rows = rows.unionByName(new)
            events["insert"] = _pairs(None, new)
        self._check(name, rows, rest_rows)
        before = self.state.copy()
        try:
            if deletes:
                self._children(name, _side(dropped, "old", cols), rest_rows.unionByName(rows))
            self._moved(name, changed, set(cols), rest_rows.unionByName(rows))
            return self._finish(name, rows.unionByName(_side(dropped, "old", cols)), rest_rows.unionByName(rows), returning, events)
        except Exception:
            self._restore(before)
            raise

    def _do_truncate(self, sql: str, params: dict) -> DataFrame:
        m = re.match(rf"(?is)^truncate\s+(?:table\s+)?(if\s+exists\s+)?({_NAME})$", sql)
        name = m[2].lower()
        if name not in self.state.tables and m[1]:
            return self._done(0)
        n = self.table(name).count()
        self._store(name, self.table(name).limit(0))
        return self._done(n)

    def _do_copy(self, sql: str, params: dict) -> DataFrame:
        m = re.match(rf"(?is)^copy\s+({_NAME})\s+to\b", sql)
        if not m:
            raise rewrite.SqlError("use copy_from() for COPY ... FROM STDIN")
        return self._done(self.table(m[1]).count())

    def copy_from(self, name: str, data: str, separator: str = ",") -> int:
        """COPY FROM STDIN: lines of values, ``#`` comments, ``NULL``; types come from the table."""
        from larkspur.sources.text import read_lines

        meta = self.state.meta[name.lower()]
        rows = cut(read_lines(self.spark, data.splitlines(), meta.schema(), separator))
        after = dml.insert(self.table(name), rows)
        self._check(name.lower(), rows, self.table(name))
        self._store(name.lower(), after)
        return rows.count()

    # --- definitions ---

    def _do_create(self, sql: str, params: dict) -> DataFrame:
        low = sql.lower()
        if re.match(r"create\s+trigger", low):
            return self._create_trigger(sql)
        if m := re.match(rf"(?is)^create\s+(or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(if\s+not\s+exists\s+)?({_NAME})\s+as\s+(.*)$", sql):
            name = m[3].lower()
            if name in self.state.views and not m[1]:
                if m[2]:
                    return self._done(0)
                raise CatalogError(f"view {name} exists")
            self._query(m[4]).createOrReplaceTempView(name)
            self.state.views[name] = rewrite.plain(m[4])
            return self._done(0)
        if m := re.match(rf"(?is)^create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(\w+)\s+on\s+({_NAME})\s*(?:using\s+(\w+)\s*)?\(\s*(\w+).*\)(?:\s*using\s+(\w+))?$", sql):
            meta = self.state.meta[m[2].lower()]
            self.state.meta[m[2].lower()] = replace(meta, indexes=(*meta.indexes, (m[1].lower(), m[4].lower(), (m[3] or m[5] or "btree").lower())))
            return self._done(0)
        if m := re.match(r"(?is)^create\s+sequence\s+(?:if\s+not\s+exists\s+)?(\w+)(?:.*?start\s+(?:with\s+)?(-?\d+))?", sql):
            self.state.sequences.setdefault(m[1].lower(), int(m[2] or 1) - 1)
            return self._done(0)
        if m := re.match(rf"(?is)^create\s+virtual\s+table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s+using\s+fts[345]\s*\((.*)\)$", sql):
            cols = [c.strip().split()[0].lower() for c in m[2].split(",")]
            meta = TableMeta(tuple(Column(c, T.StringType()) for c in cols), indexes=tuple((f"{m[1]}_{c}", c, "trigram") for c in cols))
            self.register(m[1], self.spark.createDataFrame([], meta.schema()), meta)
            return self._done(0)
        if m := re.match(rf"(?is)^create\s+(?:temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?({_NAME})\s+as\s+(.*)$", sql):
            if m[2].lower() in self.state.tables and m[1]:
                return self._done(0)
            self.register(m[2], cut(self._query(m[3], params)))
            return self._done(self.table(m[2]).count())
        m = re.match(rf"(?is)^create\s+(?:temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?({_NAME})\s*\((.*)\)[^)]*$", sql)
        if not m:
            raise rewrite.SqlError("cannot read CREATE")
        name = m[2].lower().strip("`")
        if name in self.state.tables:
            if m[1]:
                return self._done(0)
            raise CatalogError(f"table {name} exists")
        meta = parse_columns(m[3])
        self.register(name, self.spark.createDataFrame([], meta.schema()), meta)
        return self._done(0)

    def _create_trigger(self, sql: str) -> DataFrame:
        m = re.match(rf"(?is)^create\s+trigger\s+(?:if\s+not\s+exists\s+)?(\w+)\s+(before|after)\s+(insert|update|delete)\s+on\s+({_NAME})\s+(?:for\s+each\s+row\s+)?(?:when\s+(.*?)\s+)?begin\s+(.*?);?\s*end$", sql)
        if not m:
            raise rewrite.SqlError("cannot read CREATE TRIGGER")
        self.state.triggers[m[1].lower()] = Trigger(m[1].lower(), m[4].lower(), m[2].lower(), m[3].lower(), rewrite.plain(m[6]), m[5] and rewrite.plain(m[5]))
        return self._done(0)

    def _fire(self, name: str, timing: str, event: str, pairs: DataFrame) -> None:
        """Triggers of a table run once per statement over all of its rows.

        The body sees the rows as table ``affected``: every column as ``old_c``
        and ``new_c``, and as ``c`` the new value (the old one for a delete).
        ``NEW.c`` and ``OLD.c`` stand for these; see ``_set_based``.
        """
        for t in [t for t in self.state.triggers.values() if (t.table, t.timing, t.event) == (name, timing, event)]:
            if self._depth >= MAX_TRIGGER_DEPTH:
                raise RecursionError(f"triggers nest deeper than {MAX_TRIGGER_DEPTH}")
            self._depth += 1
            try:
                hit = pairs.filter(F.expr(rewrite.to_spark(_of_pair(t.when)))) if t.when else pairs
                if hit.isEmpty():
                    continue
                columns = [c[4:] for c in pairs.columns if c.startswith("new_")]
                now = "old" if event == "delete" else "new"
                for statement in rewrite.split_statements(t.body):
                    # Set anew for every statement, as triggers of triggers set it too.
                    hit.createOrReplaceTempView("__pairs")
                    hit.select("*", *[F.col(f"`{now}_{c}`").alias(c) for c in columns]).createOrReplaceTempView("affected")
                    self._trigger_statement(statement)
            except PySparkException as e:
                if "USER_RAISED_EXCEPTION" in str(e):
                    said = re.search(r"\[USER_RAISED_EXCEPTION\]\s*(.*?)\s*SQLSTATE", str(e), re.S)
                    raise ConstraintError(f"trigger {t.name}: {said[1] if said else 'raised'}") from None
                raise
            finally:
                self._depth -= 1

    def _trigger_statement(self, statement: str) -> None:
        sums = _increments(statement)
        if sums:
            # ``c = c + x``, row by row, is the sum of ``x`` over all affected rows of a target row.
            table, assign, where = sums
            target = cut(self.table(table).withColumn("__id", F.monotonically_increasing_id()))
            target.createOrReplaceTempView("__sum_target")
            items = ", ".join(f"sum({_of_pair(x)}) AS `__s_{c}`" for c, x in assign.items())
            add = self._query(f"SELECT __id, {items} FROM __sum_target JOIN __pairs ON {_of_pair(where)} GROUP BY __id")
            kinds = dict(target.dtypes)
            both = target.join(cut(add), "__id")
            new = {c: (F.col(c) + F.col(f"__s_{c}")).cast(kinds[c]) if c in assign else F.col(c) for c in self.table(table).columns}
            changed = cut(both.select("__id", *[F.col(c).alias(f"old_{c}") for c in new], *[x.alias(f"new_{c}") for c, x in new.items()]))
            rest = target.join(changed.select("__id"), "__id", "left_anti").drop("__id")
            rows = _side(changed, "new", list(new))
            self._check(table, rows, rest)
            self._finish(table, rows, rest.unionByName(rows), None, {"update": changed.drop("__id")})
            return
        out = self.sql(_set_based(statement))
        if re.match(r"(?i)\s*(select|with)\b", statement):
            out.write.format("noop").mode("overwrite").save()  # a SELECT only matters for what it raises

    def on(self, name: str, table: str, timing: str, event: str, body: str) -> None:
        """A trigger given directly; ``body`` is SQL over the table ``affected``."""
        self.state.triggers[name.lower()] = Trigger(name.lower(), table.lower(), timing, event, body)

    def nextval(self, sequence: str) -> int:
        if sequence.lower() not in self.state.sequences:
            raise CatalogError(f"no sequence {sequence}")
        self.state.sequences[sequence.lower()] += 1
        return self.state.sequences[sequence.lower()]

    def _do_drop(self, sql: str, params: dict) -> DataFrame:
        m = re.match(rf"(?is)^drop\s+(table|view|index|trigger|sequence)\s+(if\s+exists\s+)?({_NAME})", sql)
        kind, name = m[1].lower(), m[3].lower().strip("`")
        there = {"table": self.state.tables, "view": self.state.views, "trigger": self.state.triggers, "sequence": self.state.sequences}.get(kind)
        if kind == "index":
            for t, meta in self.state.meta.items():
                if any(i[0] == name for i in meta.indexes):
                    self.state.meta[t] = replace(meta, indexes=tuple(i for i in meta.indexes if i[0] != name))
                    return self._done(0)
        elif name in there:
            del there[name]
            self.state.meta.pop(name, None) if kind == "table" else None
            if kind in ("table", "view"):
                self.spark.catalog.dropTempView(name)
            return self._done(0)
        if m[2]:
            return self._done(0)
        raise CatalogError(f"no {kind} {name}")

    def _do_alter(self, sql: str, params: dict) -> DataFrame:
        m = re.match(rf"(?is)^alter\s+table\s+({_NAME})\s+(.*)$", sql)
        name, action = m[1].lower(), m[2]
        df, meta = self.table(name), self.state.meta[name]
        if a := re.match(r"(?is)^add\s+(?:column\s+)?(.*)$", action):
            new = parse_columns(a[1])
            for c in new.columns:
                df = df.withColumn(c.name, (F.expr(rewrite.to_spark(c.default)) if c.default else F.lit(None)).cast(c.type))
            meta = replace(meta, columns=(*meta.columns, *new.columns))
        elif a := re.match(r"(?is)^drop\s+(?:column\s+)?(?:if\s+exists\s+)?(\w+)$", action):
            gone = a[1].lower()
            df = df.drop(gone)
            meta = replace(meta, columns=tuple(c for c in meta.columns if c.name != gone), primary=tuple(k for k in meta.primary if k != gone), unique=tuple(u for u in meta.unique if gone not in u))
        elif a := re.match(r"(?is)^rename\s+(?:column\s+)?(\w+)\s+to\s+(\w+)$", action):
            old, new_name = a[1].lower(), a[2].lower()
            swap = lambda k: new_name if k == old else k
            df = df.withColumnRenamed(old, new_name)
            meta = replace(meta, columns=tuple(replace(c, name=swap(c.name)) for c in meta.columns), primary=tuple(map(swap, meta.primary)), unique=tuple(tuple(map(swap, u)) for u in meta.unique))
        elif a := re.match(r"(?is)^rename\s+to\s+(\w+)$", action):
            return self._rename(name, a[1].lower())
        else:
            raise rewrite.SqlError("cannot read ALTER TABLE")
        self.state.meta[name] = meta
        self._store(name, df)
        return self._done(0)

    def _rename(self, name: str, to: str) -> DataFrame:
        df, meta = self.table(name), self.state.meta.pop(name)
        del self.state.tables[name]
        self.spark.catalog.dropTempView(name)
        self.register(to, df, meta)
        return self._done(0)

    def _do_rename(self, sql: str, params: dict) -> DataFrame:
        m = re.match(r"(?is)^rename\s+table\s+(\w+)\s+to\s+(\w+)$", sql)
        return self._rename(m[1].lower(), m[2].lower())

    # --- transactions ---

    def _do_begin(self, sql: str, params: dict) -> DataFrame:
        self.saved.append((None, self.state.copy()))
        return self._done(0)

    _do_start = _do_begin

    def _do_commit(self, sql: str, params: dict) -> DataFrame:
        self.saved.clear()
        return self._done(0)

    _do_end = _do_commit

    def _do_rollback(self, sql: str, params: dict) -> DataFrame:
        m = re.match(r"(?is)^rollback\s+(?:transaction\s+)?to\s+(?:savepoint\s+)?(\w+)$", sql)
        if m:
            at = self._savepoint(m[1])
            self._restore(self.saved[at][1].copy())
            del self.saved[at + 1 :]
        elif self.saved:
            self._restore(self.saved[0][1])
            self.saved.clear()
        return self._done(0)

    def _savepoint(self, name: str) -> int:
        for k in range(len(self.saved) - 1, -1, -1):
            if self.saved[k][0] == name.lower():
                return k
        raise CatalogError(f"no savepoint {name}")

    def _do_savepoint(self, sql: str, params: dict) -> DataFrame:
        self.saved.append((sql.split()[1].lower(), self.state.copy()))
        return self._done(0)

    def _do_release(self, sql: str, params: dict) -> DataFrame:
        del self.saved[self._savepoint(sql.split()[-1]) :]
        return self._done(0)

    # --- settings and inspection ---

    def _do_set(self, sql: str, params: dict) -> DataFrame:
        name, _, value = re.sub(r"(?is)^(set|pragma)\s+", "", sql).partition("=")
        self.settings[name.strip().lower()] = rewrite.plain(value).strip("'")
        return self._done(0)

    _do_pragma = _do_set

    def _do_attach(self, sql: str, params: dict) -> DataFrame:
        return self._done(0)

    _do_comment = _do_vacuum = _do_reindex = _do_attach

    def _do_analyze(self, sql: str, params: dict) -> DataFrame:
        names = sql.split()[1:] or list(self.state.tables)
        return self._rows([(n, self.table(n).count(), len(self.table(n).columns)) for n in names], "table string, row_count bigint, column_count int")

    def _do_show(self, sql: str, params: dict) -> DataFrame:
        low = sql.lower().split()
        if low[1] == "tables":
            return self._rows([(n,) for n in sorted(self.state.tables)], "name string")
        if low[1] == "columns":
            return self._do_describe("describe " + low[-1], params)
        if low[1] == "create":
            return self._rows([(ddl(low[-1], self.state.meta[low[-1]]),)], "sql string")
        return self._rows(sorted(self.settings.items()), "name string, value string")

    def _do_describe(self, sql: str, params: dict) -> DataFrame:
        name = sql.split()[-1].lower()
        self.table(name)
        meta = self.state.meta[name]
        rows = [(c.name, c.type.simpleString(), c.name in meta.primary, c.not_null, c.default) for c in meta.columns]
        return self._rows(rows, "name string, type string, primary_key boolean, not_null boolean, default string")

    _do_desc = _do_describe

    def _do_explain(self, sql: str, params: dict) -> DataFrame:
        """The plan as text lines; ``EXPLAIN JSON`` gives one row with the list of operators, outermost first."""
        m = re.match(r"(?is)^explain\s+(json\s+)?(.*)$", sql)
        execution = self._query(m[2], params)._jdf.queryExecution()
        if m[1]:
            nodes = [n["class"].rsplit(".", 1)[-1] for n in json.loads(execution.analyzed().toJSON())]
            names = [OPERATORS.get(n, n) for n in nodes if n not in ("SubqueryAlias", "View", "UnresolvedSubqueryColumnAliases")]
            return self._rows([(json.dumps(names),)], "plan string")
        return self._rows([(line,) for line in execution.toString().splitlines()], "plan string")

    def _do_call(self, sql: str, params: dict) -> DataFrame:
        return self._query("SELECT " + re.sub(r"(?is)^call\s+", "", sql) + " AS result", params)

    def _do_execute(self, sql: str, params: dict) -> DataFrame:
        m = re.match(r"(?is)^execute\s+(\w+)\s*(?:\((.*)\))?$", sql)
        values = [self._query(f"SELECT {rewrite.text(a)} AS v").first()[0] for a in rewrite.arguments(rewrite.lex(m[2]))] if m[2] else []
        return self.execute(m[1], values)

    def _do_prepare(self, sql: str, params: dict) -> DataFrame:
        m = re.match(r"(?is)^prepare\s+(\w+)\s+(?:as|from)\s+(.*)$", sql)
        body = rewrite.plain(m[2])
        self.prepare(m[1], body[1:-1].replace("''", "'") if body.startswith("'") else body)
        return self._done(0)

    # --- results for host programs ---

    def select_maps(self, sql: str, args: list | None = None) -> Iterator[dict]:
        """Rows as dictionaries, streamed partition by partition."""
        return (r.asDict() for r in self.sql(sql, args).toLocalIterator())

    def select_arrays(self, sql: str, args: list | None = None) -> Iterator[list]:
        return (list(r) for r in self.sql(sql, args).toLocalIterator())


def _top_level_where(body: str) -> tuple[str, str | None]:
    tokens, depth = rewrite.lex(body), 0
    for k, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.kind == "word" and t.low == "where":
            return rewrite.text(tokens[:k]), rewrite.text(tokens[k + 1 :])
    return body, None


def _pairs(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Rows as ``old_c`` and ``new_c`` columns; the side that is not given is null."""
    one = new if new is not None else old
    assert one is not None
    kinds = dict(one.dtypes)
    side = lambda df, prefix: [(F.col(f"`{c}`") if df is not None else F.lit(None).cast(kinds[c])).alias(f"{prefix}_{c}") for c in one.columns]
    return one.select(*side(old, "old"), *side(new, "new"))


def _side(pairs: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return pairs.select(*[F.col(f"`{side}_{c}`").alias(c) for c in columns])


def _of_pair(sql: str) -> str:
    """``NEW.c`` and ``OLD.c`` as columns of ``__pairs``."""
    tokens, out, k = rewrite.lex(sql), [], 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind == "word" and t.low in ("new", "old") and k + 2 < len(tokens) and tokens[k + 1].text == "." and tokens[k + 2].kind in ("word", "quoted"):
            out.append(rewrite.Token("word", f"{t.low}_{tokens[k + 2].low.strip('`')}"))
            k += 3
        else:
            out.append(t)
            k += 1
    return rewrite.text(out)


def _increments(statement: str) -> tuple[str, dict[str, str], str] | None:
    """Table, increments and condition of ``UPDATE t SET c = c + x, ... WHERE ...`` that speaks of NEW or OLD rows."""
    m = re.match(rf"(?is)^update\s+({_NAME})\s+set\s+(.*)$", rewrite.masked(statement))
    if not m or _of_pair(statement) == rewrite.text(rewrite.lex(statement)):
        return None
    body, where = _top_level_where(m[2])
    assign = {}
    for part in rewrite.arguments(rewrite.lex(body)):
        x = re.match(r"(?is)^`?(\w+)`?\s*=\s*`?(\w+)`?\s*([+-])\s*(.+)$", rewrite.text(part))
        if not x or x[1].lower() != x[2].lower():
            return None
        assign[x[1].lower()] = x[4] if x[3] == "+" else f"-({x[4]})"
    return (m[1].lower().strip("`"), assign, where) if where else None


def _set_based(statement: str) -> str:
    """A statement about one NEW or OLD row as one over all rows of ``__pairs``.

    ``INSERT ... VALUES`` and ``SELECT`` read from it, ``DELETE`` asks whether a
    row is there, ``UPDATE`` becomes a MERGE (of several rows for one target the
    greatest outcome counts).  A statement that names neither runs as it is.
    """
    sql = _of_pair(statement)
    if sql == rewrite.text(rewrite.lex(statement)):
        return statement
    hidden = rewrite.masked(sql)
    if m := re.match(r"(?is)^(insert\s.*?)\bvalues\s*(\(.*\))$", hidden):
        rows = [rewrite.text(r).strip() for r in rewrite.arguments(rewrite.lex(m[2]))]
        return f"{rewrite.plain(m[1])} " + " UNION ALL ".join(f"SELECT {r[1:-1]} FROM __pairs" for r in rows)
    if m := re.match(rf"(?is)^update\s+({_NAME})\s+set\s+(.*)$", hidden):
        body, where = _top_level_where(m[2])
        return f"MERGE INTO {m[1]} USING __pairs ON {where or 'true'} WHEN MATCHED THEN UPDATE SET {rewrite.plain(body)}"
    if m := re.match(rf"(?is)^delete\s+from\s+({_NAME})\s+where\s+(.*)$", hidden):
        return f"DELETE FROM {m[1]} WHERE EXISTS (SELECT 1 FROM __pairs WHERE {rewrite.plain(m[2])})"
    parts = rewrite.clauses(rewrite.lex(re.sub(r"(?is)^insert\s.*?(?=\bselect\b)", "", hidden)))
    if not parts:
        raise rewrite.SqlError(f"a trigger cannot run: {statement}")
    head = rewrite.plain(hidden[: re.search(r"(?is)\bselect\b", hidden).start()])
    source = f"{rewrite.text(parts['from'])} CROSS JOIN __pairs" if "from" in parts else "__pairs"
    tail = " ".join(f"{w} {rewrite.text(parts[w])}" for w in ("where", "group", "having", "order", "limit") if w in parts)
    return f"{head} SELECT {rewrite.text(parts['select'])} FROM {source} {tail}"


def parse_columns(body: str) -> TableMeta:
    """Columns and table constraints of a CREATE TABLE body."""
    columns, primary, unique, checks, foreign = [], (), [], [], []
    for part in rewrite.arguments(rewrite.lex(body)):
        s = rewrite.masked(rewrite.text(part))
        s = re.sub(r"(?is)^constraint\s+\w+\s+", "", s)
        names = lambda x: tuple(c.strip().strip("`").lower() for c in x.split(","))
        if m := re.match(r"(?is)^primary\s+key\s*\((.*?)\)$", s):
            primary = names(m[1])
        elif m := re.match(r"(?is)^unique\s*\((.*?)\)$", s):
            unique.append(names(m[1]))
        elif m := re.match(r"(?is)^check\s*\((.*)\)$", s):
            checks.append(rewrite.plain(m[1]))
        elif m := re.match(r"(?is)^foreign\s+key\s*\(\s*(\w+)\s*\)\s*references\s+(\w+)\s*\(\s*(\w+)\s*\)(.*)$", s):
            foreign.append(_foreign(m[1], m[2], m[3], m[4]))
        else:
            m = re.match(r"(?is)^(`[^`]+`|\w+)\s+([\w]+(?:\s*\[\s*\]|\s*\([^)]*\))?)\s*(.*)$", s)
            if not m:
                raise rewrite.SqlError(f"cannot read column: {s}")
            name, kind, rest = m[1].strip("`").lower(), re.sub(r"\s", "", m[2]), m[3]
            low = rest.lower()
            is_pk = "primary key" in low
            if is_pk:
                primary = (name,)
            if re.search(r"(?i)\bunique\b", rest):
                unique.append((name,))
            if c := re.search(r"(?is)check\s*\(((?:[^()]|\([^()]*\))*)\)", rest):
                checks.append(rewrite.plain(c[1]))
            if r := re.search(r"(?is)references\s+(\w+)\s*\(\s*(\w+)\s*\)(.*)$", rest):
                foreign.append(_foreign(name, r[1], r[2], r[3]))
            d = re.search(r"(?is)default\s+(\((?:[^()]|\([^()]*\))*\)|'(?:[^']|'')*'|[-+]?[\w.]+(?:\(\))?)", rest)
            auto = bool(re.search(r"(?i)auto_?increment", rest)) or (is_pk and kind.lower() == "integer")
            columns.append(Column(name, sql_type(kind), "not null" in low, rewrite.plain(d[1]) if d else None, auto))
    if len({c.name for c in columns}) != len(columns) or not columns:
        raise CatalogError("a table needs columns with different names")
    return TableMeta(tuple(columns), primary, tuple(unique), tuple(checks), tuple(foreign))


def _foreign(column: str, parent: str, parent_column: str, rest: str) -> ForeignKey:
    rule = lambda event: (m[1].lower() if (m := re.search(rf"(?i)on\s+{event}\s+(cascade|set\s+null|restrict|no\s+action)", rest)) else "restrict")
    return ForeignKey(column.lower(), parent.lower(), parent_column.lower(), re.sub(r"\s+", " ", rule("delete")), re.sub(r"\s+", " ", rule("update")))


def ddl(name: str, meta: TableMeta) -> str:
    """CREATE TABLE text of a table."""
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "TEXT", "boolean": "BOOLEAN", "array<string>": "STRINGS[]", "array<double>": "FLOATS[]", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    parts = [
        f"{c.name} {kinds.get(c.type.simpleString(), c.type.simpleString())}" + (" NOT NULL" if c.not_null else "") + (f" DEFAULT {c.default}" if c.default else "") + (" AUTO_INCREMENT" if c.auto else "")
        for c in meta.columns
    ]
    if meta.primary:
        parts.append(f"PRIMARY KEY ({', '.join(meta.primary)})")
    parts += [f"UNIQUE ({', '.join(u)})" for u in meta.unique] + [f"CHECK ({c})" for c in meta.checks]
    parts += [f"FOREIGN KEY ({f.column}) REFERENCES {f.parent}({f.parent_column}) ON DELETE {f.on_delete.upper()} ON UPDATE {f.on_update.upper()}" for f in meta.foreign]
    return f"CREATE TABLE {name} ({', '.join(parts)})"
