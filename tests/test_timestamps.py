from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions.timeparse import parse
from larkspur.operators.timestamps import instants, with_utc_micros, zone_periods

SERVERS = [(1, "Europe/Berlin", "dmy"), (2, "America/New_York", "mdy"), (3, "UTC", "dmy"), (4, "Nowhere/Land", "dmy"), (5, "Australia/Sydney", "dmy")]


def us(*parts, offset=0.0, micro=0):
    t = datetime(*parts, tzinfo=timezone.utc) - timedelta(hours=offset)
    return int(t.timestamp()) * 1_000_000 + micro


CASES = [
    (1, "2024-08-20 12:00:00", us(2024, 8, 20, 12, offset=2)),
    (1, "  2024-08-20T12:00:00\t", us(2024, 8, 20, 12, offset=2)),
    (1, "2024-08-20T12:00:00.1234567Z", us(2024, 8, 20, 12, micro=123456)),
    (1, "2024-08-20 12:00", us(2024, 8, 20, 12, offset=2)),
    (1, "20.08.2024 12:30", us(2024, 8, 20, 12, 30, offset=2)),
    (2, "20.08.2024 12:30", us(2024, 8, 20, 12, 30, offset=-4)),
    (2, "08/09/2024 12:30:00 AM", us(2024, 8, 9, 0, 30, offset=-4)),
    (2, "08/09/2024 12:30:00 PM", us(2024, 8, 9, 12, 30, offset=-4)),
    (2, "08/09/2024 13:30:00 PM", None),
    (1, "08/09/2024 12:30:00", us(2024, 9, 8, 12, 30, offset=2)),
    (1, "1724155200", us(2024, 8, 20, 12)),
    (1, "1724155200123", us(2024, 8, 20, 12, micro=123000)),
    (1, "1724155200123456", us(2024, 8, 20, 12, micro=123456)),
    (1, "20240820T120000Z", us(2024, 8, 20, 12)),
    (1, "Tue, 20 Aug 2024 12:00:00 -0500", us(2024, 8, 20, 12, offset=-5)),
    (1, "2024-08-20 12:00:00,250 +0530", us(2024, 8, 20, 12, offset=5.5, micro=250000)),
    (1, "2024-08-20T12:00:00+02:00[Europe/Berlin]", us(2024, 8, 20, 12, offset=2)),
    (1, "2024-08-20 12:00:00 [Asia/Tokyo]", us(2024, 8, 20, 12, offset=9)),
    (9, "2024-08-20 12:00:00[america/new_york]", us(2024, 8, 20, 12, offset=-4)),
    (1, "2024-08-20 12:00:00 [Etc/GMT+5]", us(2024, 8, 20, 12, offset=-5)),
    (1, "2024-08-20 12:00:00 [Etc/GMT-5]", us(2024, 8, 20, 12, offset=5)),
    (1, "2024-08-20 12:00:00 [Mars/Base]", None),
    (1, "2024-08-20" + " " * 500 + "12:00:00", us(2024, 8, 20, 12, offset=2)),
    (1, "2024-08-20T12:00:00.5" + "0" * 200 + "Z", us(2024, 8, 20, 12, micro=500_000)),
    (3, "0001-01-01 00:00:00", us(1, 1, 1)),
    (3, "9999-12-31 23:59:59", us(9999, 12, 31, 23, 59, 59)),
    (2, "1969-07-20 16:17:40", us(1969, 7, 20, 16, 17, 40, offset=-4)),
    (2, "2101-07-01 12:00:00", us(2101, 7, 1, 12, offset=-4)),
    (2, "2555-07-01 12:00:00", us(2555, 7, 1, 12, offset=-4)),
    (2, "9999-01-01 12:00:00", us(9999, 1, 1, 12, offset=-5)),
    (2, "2555-03-08 02:30:00", us(2555, 3, 8, 2, 30, offset=-5)),
    (2, "2555-03-09 02:30:00", None),
    (2, "2555-03-10 02:30:00", us(2555, 3, 10, 2, 30, offset=-4)),
    (2, "2555-11-02 01:30:00", None),
    (5, "2129-01-01 00:30:00", us(2129, 1, 1, 0, 30, offset=11)),
    (2, "2024-11-03 01:30:00", None),
    (2, "2024-11-03 01:30:00 EST", us(2024, 11, 3, 1, 30, offset=-5)),
    (2, "2024-11-03 01:30:00 EDT", us(2024, 11, 3, 1, 30, offset=-4)),
    (1, "2024-03-31 02:30:00", None),
    (5, "2024-10-06 02:30:00", None),
    (5, "2024-10-06 03:00:00", us(2024, 10, 6, 3, offset=11)),
    (3, "2024-02-30 00:00:00", None),
    (3, "2024-13-04 10:61:00", None),
    (3, "0000-00-00 00:00:00", None),
    (3, "2024-10-05", None),
    (3, "24:70", None),
    (3, "yesterday 20:15", None),
    (3, "", None),
    (3, None, None),
    (3, "x" * 100_000, None),
    (4, "2024-08-20 12:00:00", None),
    (4, "2024-08-20 12:00:00Z", us(2024, 8, 20, 12)),
    (9, "2024-08-20 12:00:00", None),
    (None, "2024-08-20 12:00:00 UTC", us(2024, 8, 20, 12)),
]


def frames(spark):
    servers = spark.createDataFrame(SERVERS, "server_id long, zone string, date_order string")
    data = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(CASES)], "id long, server_id long, ts string")
    return data, servers


def test_each_format(spark):
    data, servers = frames(spark)
    got = {r.id: r.u for r in with_utc_micros(data, "ts", "u", servers).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_clashing_columns_and_repeats(spark):
    data, servers = frames(spark)
    odd = data.withColumn("zone", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("base_us", F.lit(0))
    assert with_utc_micros(odd, "ts", "u", servers).columns == [*odd.columns, "u"]
    twice = instants([("t", data.unionAll(data), "id", "ts")], servers)
    assert twice.count() == sum(w is not None for _, _, w in CASES)


def test_empty(spark):
    data, servers = frames(spark)
    assert with_utc_micros(data.limit(0), "ts", "u", servers).count() == 0
    assert parse(pa.array([], pa.string()), pa.array([], pa.bool_())).to_pylist() == []


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney"]))
def test_periods_agree_with_the_zone(moment, zone):
    second = int(moment.replace(tzinfo=timezone.utc).timestamp())
    hit = [p for p in zone_periods(zone) if p[0] <= second < p[1]]
    assert len(hit) == 1
    local = moment.replace(tzinfo=timezone.utc, microsecond=0).astimezone(ZoneInfo(zone))
    assert hit[0][2] == local.utcoffset().total_seconds() and hit[0][3] == local.tzname()
