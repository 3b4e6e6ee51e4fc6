"""Recursive queries with set semantics (UNION without ALL), and the row limit of Spark's own with UNION ALL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.materialize import cut


#: Rounds after which what is known is written anew as one frame.
COMPACT_EVERY = 16

#: Spark's setting for the rows that a recursion with UNION ALL may have in all; -1 stands for any number.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def lift_row_limit(spark: SparkSession) -> None:
    """Let recursions with UNION ALL have any number of rows, where Spark ends them by an error at a million.

    The setting is read when a query runs, so it stays in the session.  A limit
    that is set already is kept; that of levels still ends endless recursions.
    """
    if spark.conf.get(ROW_LIMIT, None) is None:
        spark.conf.set(ROW_LIMIT, "-1")


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 100) -> DataFrame:
    """Least fixpoint of ``seed`` under ``step`` as a set; ends on cycles too.

    Semi-naive: a round expands only the rows that the last one added.  These are
    written to shared storage once, so a lost executor does not lose the state,
    and compared with what is known by one null-safe anti-join, whose small side
    is broadcast where its measured size allows.  The known rows are the written
    rounds, put together every ``COMPACT_EVERY`` rounds.  More than
    ``max_rounds`` is an error.
    """
    front = cut(seed.distinct())
    seen = front
    columns = seed.columns
    for no in range(1, max_rounds + 1):
        new = step(front).toDF(*columns).distinct()
        known = seen.toDF(*[f"_{i}" for i in range(len(columns))])
        same = reduce(and_, [new[c].eqNullSafe(known[f"_{i}"]) for i, c in enumerate(columns)])
        front = cut(new.join(known, same, "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
        if no % COMPACT_EVERY == 0:
            seen = cut(seen)
    raise RecursionError(f"the recursion did not end within {max_rounds} rounds")
