"""Leaderboards, ordinal maxima, replay order and rule-driven value patching."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.recursion import recursive_distinct

if TYPE_CHECKING:
    from larkspur.plans.session import Session


def leaderboard(df: DataFrame, by: Sequence[str], n: int = 10, where: str | None = None, measure: Column | None = None) -> DataFrame:
    """The ``n`` groups with the greatest ``measure`` (row count by default), ties broken by the group's columns."""
    x = df.filter(where) if where else df
    x = x.groupBy(*by).agg((measure if measure is not None else F.count(F.lit(1))).alias("score"))
    return x.orderBy(F.col("score").desc(), *[F.col(c).asc_nulls_last() for c in by]).limit(n)


def highest_of(df: DataFrame, key: str, value: str, ranks: Sequence[str]) -> DataFrame:
    """Per ``key`` the value that comes last in ``ranks``; unlisted values count below all."""
    place = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(value))
    return df.groupBy(key).agg(F.max_by(value, F.struct(place, F.col(value))).alias("highest"))


#: Operators that ``patched`` knows; ``value`` is the rule's argument as text.
VALUE_OPERATORS = ("set", "toggle", "inc", "add", "sub", "mul", "div", "mod", "cat", "default", "round", "clamp", "negate", "replace", "format")


def apply_operator(value: Column, operator: Column, argument: Column) -> Column:
    """One rule applied to a text value: arithmetic on its number (0 if it is none), division and remainder by 0 give 0."""
    x, y = F.coalesce(value.try_cast("double"), F.lit(0.0)), F.coalesce(argument.try_cast("double"), F.lit(0.0))

    def num(c: Column) -> Column:
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        return F.when(whole, F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))

    bounds = F.split(argument, r"\|")
    lo, hi = F.get(bounds, F.lit(0)).try_cast("double"), F.get(bounds, F.lit(1)).try_cast("double")
    scale = F.pow(F.lit(10.0), y)
    return (
        F.when(operator == "set", argument)
        .when(operator == "toggle", F.when(F.lower(value).isin("true", "1"), F.lit("false")).otherwise(F.lit("true")))
        .when(operator.isin("inc", "add"), num(x + y))
        .when(operator == "sub", num(x - y))
        .when(operator == "mul", num(x * y))
        .when(operator == "div", num(F.coalesce(F.try_divide(x, y), F.lit(0.0))))
        .when(operator == "mod", num(F.coalesce(F.try_mod(x, y), F.lit(0.0))))
        .when(operator == "cat", F.concat(F.coalesce(value, F.lit("")), argument))
        .when(operator == "default", F.coalesce(F.nullif(value, F.lit("")), argument))
        .when(operator == "round", num(F.round(x * scale) / scale))
        .when(operator == "clamp", num(F.least(F.greatest(x, F.coalesce(lo, x)), F.coalesce(hi, x))))
        .when(operator == "negate", num(-x))
        .when(operator == "replace", F.regexp_replace(value, F.get(bounds, F.lit(0)), F.coalesce(F.get(bounds, F.lit(1)), F.lit(""))))
        .when(operator == "format", F.replace(argument, F.lit("%1"), F.coalesce(value, F.lit(""))))
        .otherwise(value)
    )


def ancestors(parents: DataFrame) -> DataFrame:
    """``kind, above``: every kind with itself and all kinds above it, from ``kind, parent`` rows (cycles end)."""
    up = parents.select(F.col("kind").alias("_k"), F.col("parent").alias("_p")).filter("_p IS NOT NULL")
    seed = parents.select("kind", F.col("kind").alias("above")).unionAll(parents.select("parent", F.col("parent").alias("above"))).filter("kind IS NOT NULL")
    return recursive_distinct(seed, lambda front: front.join(up, F.col("above") == F.col("_k")).select("kind", F.col("_p").alias("above")))


def patched(targets: DataFrame, target_key: str, kind: str, value: str, rules: DataFrame, max_rules: int = 10_000, parents: DataFrame | None = None) -> DataFrame:
    """Apply active rules to every target in the order of priority (descending), then id.

    ``targets`` has a key, a kind (the name that rules match) and a text value.
    ``rules`` has ``id, active, priority, match_type, match_value, operator, value``;
    ``match_type`` is ``all``, ``exact`` (one name or a comma list), ``type_of``
    (the named kinds and all kinds below them by ``parents``, ``kind, parent``
    rows), ``wildcard`` or ``regex``.  Result: the targets with ``patched`` and
    ``n_rules``.

    Rules match the distinct kinds only, so the rule list (at most ``max_rules``,
    checked) meets each name once, not each row; the fold of a kind's rules is an
    ``aggregate`` over its sorted rule array.
    """
    active = rules.filter("active = 1")
    if active.count() > max_rules:
        raise ValueError(f"more than {max_rules} active rules")
    c = F.col
    names = F.transform(F.split("match_value", ","), lambda s: F.trim(s))
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("match_value", r"([.\\+^$()\[\]{}|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    kinds = targets.select(c(kind).alias("_kind")).distinct()
    above = F.array(c("_kind"))
    if parents is not None:
        lines = ancestors(parents).groupBy(c("kind").alias("_kind")).agg(F.collect_set("above").alias("_above"))
        kinds, above = kinds.join(lines, "_kind", "left"), F.coalesce("_above", above)
    hit = (
        (c("match_type") == "all")
        | ((c("match_type") == "exact") & F.array_contains(names, c("_kind")))
        | ((c("match_type") == "type_of") & F.arrays_overlap(names, above))
        | ((c("match_type") == "wildcard") & F.rlike(c("_kind"), glob))
        | ((c("match_type") == "regex") & F.rlike(c("_kind"), c("match_value")))
    )
    rule = F.struct((-c("priority")).alias("p"), c("id").alias("id"), c("operator").alias("op"), c("value").alias("arg"))
    # A broadcast of the checked rule list; every name is compared with every rule once.
    lists = kinds.join(F.broadcast(active), hit).groupBy("_kind").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    x = targets.join(lists, c(kind).eqNullSafe(c("_kind")), "left").drop("_kind")
    start = c(value).cast("string")
    folded = F.aggregate("_rules", start, lambda acc, r: apply_operator(acc, r.op, r.arg))
    return x.withColumn("patched", F.when(c("_rules").isNull(), start).otherwise(folded)).withColumn("n_rules", F.coalesce(F.size("_rules"), F.lit(0)).cast("long")).withColumn("n_rules", F.greatest("n_rules", F.lit(0).cast("long"))).drop("_rules")


#: Table of the rules that ``live_patch`` writes.
PATCH_RULES = """CREATE TABLE IF NOT EXISTS patch_rules (id INTEGER AUTO_INCREMENT, name TEXT NOT NULL PRIMARY KEY, active INTEGER DEFAULT 1,
    priority INTEGER DEFAULT 0, match_type TEXT NOT NULL DEFAULT 'exact', match_value TEXT DEFAULT '', target_type TEXT NOT NULL, property TEXT NOT NULL,
    operator TEXT DEFAULT 'set', value TEXT NOT NULL, created_at TEXT DEFAULT '')"""


def live_patch(session: Session, *words: str) -> DataFrame:
    """``list`` shows the rules by priority, ``query`` runs SQL over them, and ``target property value`` adds a rule and shows it."""
    session.sql(PATCH_RULES)
    if words[:1] == ("list",):
        return session.sql("SELECT * FROM patch_rules ORDER BY priority, id")
    if words[:1] == ("query",):
        if len(words) < 2:
            raise ValueError("query needs SQL")
        return session.run(words[1])[-1]
    if len(words) < 3 or not all(words[:3]):
        raise ValueError("a rule needs a target, a property and a value")
    stamp = time.time_ns()
    name = f"live_patch_{stamp // 10**9}_{stamp % 10**9:09d}"
    values = [name, *words[:3], str(stamp // 10**9)]
    session.sql("INSERT INTO patch_rules (name, target_type, property, value, created_at) VALUES ($1, $2, $3, $4, $5)", values)
    return session.sql("SELECT * FROM patch_rules WHERE name = $1", [name])
