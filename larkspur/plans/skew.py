"""Joining many rows to a set of keys when one key may hold a large share of the rows; telling repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.005


def hot_keys(counts: DataFrame, key: str, n: str, share: float = HOT_SHARE) -> list:
    """Keys of ``counts`` (one row per key with its row count ``n``) that hold ``share`` of all rows.

    At most ``1 / share`` values come to the driver, whatever the data.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    if not total:
        return []
    rows = counts.filter(F.col(n) >= F.lit(share * total)).orderBy(F.col(n).desc()).limit(int(1 / share) + 1).select(key).collect()
    return [r[0] for r in rows]


def semi_join_split(rows: DataFrame, key: str, keys: DataFrame, hot: list) -> DataFrame:
    """Rows whose ``key`` is in ``keys``, with the rows of ``hot`` keys kept out of the shuffle.

    ``keys`` has a column named like ``key``.  Hot keys are few (see
    ``hot_keys``), so that part is a broadcast of bounded size; all other keys
    hold less than ``HOT_SHARE`` of the rows each and join by shuffle.
    """
    if not hot:
        return rows.join(keys, key, "left_semi")
    is_hot = F.col(key).isin(hot)
    few = rows.filter(is_hot).join(F.broadcast(keys.filter(is_hot)), key, "left_semi")
    rest = rows.filter(~F.coalesce(is_hot, F.lit(False))).join(keys.filter(~is_hot), key, "left_semi")
    return few.unionByName(rest)


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row, in which a null differs from a value that is not there."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        # Bit by bit; a table of more than 60 columns takes further words of the sum, which a hash may well share.
        nulls = nulls + F.when(c.isNull(), F.lit(1 << (i % 60)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.xxhash64(*columns, nulls)
