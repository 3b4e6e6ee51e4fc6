"""Mixed timestamp text to one UTC instant.

An Arrow-batched parser (``larkspur.functions.timeparse``) reads the text's own
clock and whatever offset or zone it names.  Values whose text does not settle
the instant are resolved by an as-of join against
the zone's offset intervals, exploded to one broadcast row per (zone, local
year): the number of intervals that contain the local time is the verdict --
one gives the offset, two mean the clock showed that time twice, none means it
never showed it.

Broadcast bound: the interval table has (zones of the server table and zones
named in texts) x (``FIRST_YEAR`` to ``LAST_YEAR``) rows; there are fewer than
700 IANA zones, whatever the data size.  Years before and after need no rows:
clocks before 1800 keep their first offset, and from ``RULED_YEAR`` on, where
only yearly rules are left, a year is like every other that begins on the same
weekday and is as long.
"""

from __future__ import annotations

from calendar import isleap
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import timeparse
from larkspur.plans.ship import ship

#: Most zone names that a server table may hold (there are fewer than 700).
MAX_ZONES = 1000
#: Years of the interval table: from before the first zone change to one of each kind of year under yearly rules alone.
FIRST_YEAR, RULED_YEAR, LAST_YEAR = 1800, 2101, 2128
_ALWAYS = 2**62
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_INTERVAL = T.ArrayType(
    T.StructType(
        [
            T.StructField("lo", T.LongType(), False),
            T.StructField("hi", T.LongType(), False),
            T.StructField("off", T.LongType(), False),
            T.StructField("abbr", T.StringType(), False),
        ]
    ),
    False,
)


@lru_cache(maxsize=1024)
def zone_periods(zone: str) -> tuple[tuple[int, int, int, str], ...]:
    """Periods ``(utc_start, utc_end, offset, abbreviation)`` of constant offset, in seconds; the first has no begin.

    Found by stepping through the zone's rules and bisecting every step over
    which the offset or the abbreviation changes, to quarters of an hour first,
    where nearly all changes lie.
    """
    tz = ZoneInfo(zone)

    def at(second: int) -> tuple[int, str]:
        moment = (_EPOCH + timedelta(seconds=second)).astimezone(tz)
        return int(moment.utcoffset().total_seconds()), moment.tzname() or ""

    begin, stop = _new_year(FIRST_YEAR) - 2 * 86400, _new_year(LAST_YEAR + 1) + 2 * 86400
    out, start, now, second = [], -_ALWAYS, at(begin), begin
    while second < stop:
        ahead = min(second + 9 * 86400, stop)
        if at(ahead) != now:
            lo, hi = second, ahead
            for grain in (900, 1):
                while hi - lo > grain:
                    mid = (lo + hi) // (2 * grain) * grain
                    if at(mid) == now:
                        lo = mid
                    else:
                        hi = mid
                if at(hi - 1) == now:
                    break
            out.append((start, hi, *now))
            start, now, second = hi, at(hi), hi - hi % 900
        else:
            second = ahead
    out.append((start, stop, *now))
    return tuple(out)


def _new_year(year: int) -> int:
    return int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())


@lru_cache(maxsize=1)
def _like_years() -> list[int]:
    """For every year modulo 400 a year from ``RULED_YEAR`` to ``LAST_YEAR`` with the same calendar."""
    def kind(y: int) -> tuple[int, bool]:
        return datetime(y, 1, 1).weekday(), isleap(y)

    first = {}
    for y in range(RULED_YEAR, LAST_YEAR + 1):
        first.setdefault(kind(y), y)
    return [first[kind(2400 + r)] for r in range(400)]


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    """IANA names by their lower-case spelling."""
    return {z.lower(): z for z in available_timezones()}


def zone_intervals(spark: SparkSession, zones: list[str]) -> DataFrame:
    """One row per (zone, local year) with the offset intervals that touch that local year.

    Columns ``zone`` (lower case), ``local_year``, ``spans`` (array of ``lo``, ``hi`` in local
    seconds, ``off`` in seconds, ``abbr``).  Names that are no IANA zone are left out.
    """
    known = _zone_names()
    rows = []
    years = range(FIRST_YEAR, LAST_YEAR + 1)
    edges = [_new_year(y) for y in [*years, LAST_YEAR + 1]]
    for zone in sorted({z.lower() for z in zones if z.lower() in known}):
        periods = [(lo + off, hi + off, off, abbr) for lo, hi, off, abbr in zone_periods(known[zone])]
        first = 0
        for k, year in enumerate(years):
            while periods[first][1] <= edges[k] and first + 1 < len(periods):
                first += 1
            end = first
            # Local spans overlap by hours at most, so one more tells where a year's spans end.
            while end < len(periods) and periods[end][0] < edges[k + 1]:
                end += 1
            rows.append((zone, year, [p for p in periods[max(0, first - 1) : end] if p[0] < edges[k + 1] and p[1] > edges[k]]))
    schema = T.StructType(
        [T.StructField("zone", T.StringType()), T.StructField("local_year", T.IntegerType()), T.StructField("spans", _INTERVAL)]
    )
    return spark.createDataFrame(rows, schema)


def named_zones(df: DataFrame, text: str) -> list[str]:
    """IANA zones (lower case) that texts name in brackets: at most all there are, whatever the number of rows."""
    tail = F.rtrim(F.substring_index(F.col(f"`{text}`"), "[", -1))
    name = F.lower(F.rtrim(tail, F.lit("]")))
    # Distinct first: the names are few, the rows are many.
    found = df.filter(F.contains(F.col(f"`{text}`"), F.lit("["))).select(name.alias("z")).distinct()
    # One text to parse in place of some hundred literals to send.
    found = found.filter("z IN ('" + "', '".join(sorted(_zone_names())) + "')")
    return [r.z for r in found.collect()]


_PARSED = T.StructType(
    [T.StructField("base_us", T.LongType()), T.StructField("off_s", T.IntegerType()), T.StructField("place", T.StringType())]
)


@F.arrow_udf(_PARSED)
def _parsed(texts: pa.Array, month_first: pa.Array, dotted_too: pa.Array) -> pa.Array:
    return timeparse.parse(texts, month_first, dotted_too)


def with_utc_micros(df: DataFrame, text: str, out: str, servers: DataFrame, server_id: str = "server_id", dotted: str = "dmy") -> DataFrame:
    """Append ``out``: microseconds since 1970 UTC of the instant that ``text`` names, else NULL.

    ``servers`` has ``server_id``, ``zone`` (IANA) and ``date_order`` (``dmy`` or
    ``mdy``) and at most one row per server; it is a reference table of bounded
    size (its distinct zones are listed on the driver, at most one per IANA
    zone).  Rows are neither added nor lost; no shuffle.

    Defined results: surrounding blanks are ignored; null, empty and over-long
    texts, filler words, a date without a time, an impossible date or time, a
    local time shown twice or never, and a local time of an unknown server or
    zone give NULL.  Digits finer than a microsecond are cut.  Figures separated
    by ``/`` follow the server's date order (day-first if unknown); dotted
    figures are day-first on every server (``dotted="dmy"``, see the README for
    the evidence) or follow it too (``dotted="server"``).  A numeric offset wins
    over a bracketed zone name beside it; a bracketed name alone may be any IANA
    zone, in any case.  An abbreviation is looked up in the server's zone.  Any
    year from 1 to 9999 is resolved.  (A stream cannot be asked which zones it
    names, so its interval table holds all IANA zones.)
    """
    if dotted not in ("dmy", "server"):
        raise ValueError("dotted must be 'dmy' or 'server'")
    ship(df.sparkSession)
    spark = df.sparkSession
    zones = [r.zone for r in servers.select("zone").distinct().limit(MAX_ZONES + 1).collect() if r.zone]
    if len(zones) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} different zones")
    place = servers.groupBy(F.col("server_id").alias("_ls_ts_server")).agg(
        F.first("zone", True).alias("_ls_ts_zone"), F.first("date_order", True).alias("_ls_ts_order")
    )
    c = F.col
    x = df.join(F.broadcast(place), c(f"`{server_id}`") == c("_ls_ts_server"), "left")
    x = x.withColumn("_ls_p", _parsed(c(f"`{text}`"), c("_ls_ts_order") == "mdy", F.lit(dotted == "server")))
    bracket = F.startswith(c("_ls_p.place"), F.lit("["))
    year = F.year(F.date_from_unix_date(F.floor(c("_ls_p.base_us") / F.lit(86_400_000_000.0)).cast("int")))
    like = F.when(year > LAST_YEAR, F.element_at(F.expr(f"array({', '.join(map(str, _like_years()))})"), F.pmod(year, F.lit(400)) + 1)).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))
    moved = F.when(year > LAST_YEAR, F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) - F.unix_date(F.make_date(like, F.lit(1), F.lit(1)))).otherwise(F.lit(0))
    x = x.select(
        *[c(f"`{k}`") for k in df.columns],
        c("_ls_p.base_us").alias("_ls_base"),
        c("_ls_p.off_s").alias("_ls_off"),
        F.when(bracket, F.lit("")).otherwise(c("_ls_p.place")).alias("_ls_abbr"),
        F.lower(F.when(bracket, F.btrim(c("_ls_p.place"), F.lit("[]"))).otherwise(c("_ls_ts_zone"))).alias("_ls_zone"),
        # Only values that the text leaves open take part in the as-of join.
        F.when(c("_ls_p.off_s").isNull(), like).alias("_ls_year"),
        (moved.cast("long") * 86_400).alias("_ls_moved"),
    )
    named = list(_zone_names()) if df.isStreaming else named_zones(df, text)
    spans = zone_intervals(spark, [*zones, *named]).withColumnsRenamed({"zone": "_ls_z", "local_year": "_ls_y", "spans": "_ls_spans"})
    x = x.join(F.broadcast(spans), (c("_ls_zone") == c("_ls_z")) & (c("_ls_year") == c("_ls_y")), "left")
    second = F.floor(c("_ls_base") / F.lit(1_000_000.0)).cast("long") - c("_ls_moved")
    hit = F.when(c("_ls_abbr") == "", F.filter("_ls_spans", lambda i: (i.lo <= second) & (second < i.hi))).otherwise(
        F.filter("_ls_spans", lambda i: i.abbr == c("_ls_abbr"))
    )
    x = x.withColumn("_ls_hit", F.when(c("_ls_off").isNull(), F.transform(hit, lambda i: i.off)))
    only = F.when(F.array_min("_ls_hit") == F.array_max("_ls_hit"), F.array_min("_ls_hit"))
    only = F.when((c("_ls_abbr") != "") | (F.size("_ls_hit") == 1), only)
    offset = F.coalesce(c("_ls_off").cast("long"), only)
    return x.select(*[c(f"`{k}`") for k in df.columns], (c("_ls_base") - offset * 1_000_000).alias(out))


def instants(fields: Iterable[tuple[str, DataFrame, str, str]], servers: DataFrame, server_id: str = "server_id") -> DataFrame:
    """``source_table, row_key, utc_us`` of every value that names exactly one instant.

    ``fields`` gives ``(name, table, key column, text column)``; all are parsed
    and resolved in one pass.  Repeated rows give one row; rows with a null key
    are kept with a null ``row_key``.
    """
    slim: DataFrame | None = None
    for name, table, key, text in fields:
        one = table.select(
            F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("_text"), F.col(server_id).alias("server_id")
        )
        slim = one if slim is None else slim.unionByName(one)
    if slim is None:
        raise ValueError("no fields given")
    out = with_utc_micros(slim, "_text", "utc_us", servers).filter(F.col("utc_us").isNotNull())
    return out.select("source_table", "row_key", "utc_us").distinct()
