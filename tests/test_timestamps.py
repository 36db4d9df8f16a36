import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from ledgerloom.operators.timestamps import listing_instants, with_instants
from pyspark.sql import functions as F

UTC = dt.timezone.utc


def micros(*parts, zone="UTC", fold=0):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000


CASES = [
    ("1720242007", "UTC", "ymd", 1720242007000000),
    ("1626793622.637", "UTC", "ymd", 1626793622637000),
    ("1744746873898", "UTC", "ymd", 1744746873898000),
    ("1720956286812113", "UTC", "ymd", 1720956286812113),
    ("1626313276098317640", "UTC", "ymd", 1626313276098317),
    ("2022-05-19T01:29:10+02:00", "UTC", "ymd", micros(2022, 5, 18, 23, 29, 10)),
    ("2021-09-09T13:35:49.686708838z", "Asia/Tokyo", "ymd", micros(2021, 9, 9, 13, 35, 49) + 686708),
    ("2021-07-20T15:07:02+00:00[UTC]", "UTC", "ymd", micros(2021, 7, 20, 15, 7, 2)),
    ("2023-10-19 15:23:39,713", "Asia/Kolkata", "dmy", micros(2023, 10, 19, 9, 53, 39) + 713000),
    ("2023-04-06 18:27:29.217 +0545", "UTC", "ymd", micros(2023, 4, 6, 12, 42, 29) + 217000),
    ("20260627T192057Z", "UTC", "ymd", micros(2026, 6, 27, 19, 20, 57)),
    ("20240131", "Europe/Berlin", "dmy", micros(2024, 1, 30, 23)),
    ("2024/05/31 06:29", "America/New_York", "mdy", micros(2024, 5, 31, 10, 29)),
    ("08/07/2025 5:54 PM", "America/Los_Angeles", "mdy", micros(2025, 8, 8, 0, 54)),
    ("03/10/2024 12:10 AM", "America/New_York", "mdy", micros(2024, 3, 10, 5, 10)),
    ("21/07/2026 11:47:51", "Europe/Berlin", "dmy", micros(2026, 7, 21, 9, 47, 51)),
    ("02.11.2025 14:27", "Europe/Berlin", "dmy", micros(2025, 11, 2, 13, 27)),
    ("21/07/2026", "UTC", "ymd", micros(2026, 7, 21)),
    ("06/07/2026", "UTC", "ymd", None),
    ("June 6, 2024 3:39 PM", "UTC", "ymd", micros(2024, 6, 6, 15, 39)),
    ("6 Jun 2024 09:13 UTC", "Asia/Tokyo", "ymd", micros(2024, 6, 6, 9, 13)),
    ("Thu, 21 Jul 2022 06:10:51 +0000", "UTC", "ymd", micros(2022, 7, 21, 6, 10, 51)),
    ("Mon, 22 Nov 2021 11:41:15 GMT", "Asia/Tokyo", "ymd", micros(2021, 11, 22, 11, 41, 15)),
    ("2025-08-08 07:10:27 PDT", "UTC", "ymd", micros(2025, 8, 8, 14, 10, 27)),
    ("2021-10-13 20:08:32 America/Los_Angeles", "UTC", "ymd", micros(2021, 10, 14, 3, 8, 32)),
    # twice: the first occurrence, unless more is written
    ("2025-10-26T02:48:32", "Europe/Berlin", "dmy", micros(2025, 10, 26, 2, 48, 32, zone="Europe/Berlin")),
    ("2025-10-26 02:42:24 CET", "Europe/Berlin", "dmy", micros(2025, 10, 26, 1, 42, 24)),
    # skipped: moved on by the length of the gap
    ("2025-03-30 02:30:00", "Europe/Berlin", "dmy", micros(2025, 3, 30, 1, 30)),
    *((v, "UTC", "ymd", None) for v in ("", "  ", "n/a", "soon", "-1", "0", "0000-00-00", "2025-13-45T00:00:00Z", "2025-02-30 10:00:00", "2025-02-03 25:00:00",
      "1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "-62135596800", "253402300799", "2035-01-01T00:00:00Z", "2024-01-01 10:00:00 Nowhere/Land", "2024-01-01 10:00:00 QQT", "13:00 PM", "2024-01-01 13:00 PM", "x" * 100_000)),
    ("2015-01-01T00:00:00Z", "UTC", "ymd", 1420070400000000),
    ("2034-12-31 23:59:59.999999999", "UTC", "ymd", 2051222399999999),
    (None, "UTC", "ymd", None),
    ("2024-01-01 00:00", None, None, 1704067200000000),
    ("2024-01-01 00:00", "No/Zone", "ymd", None),
]


def test_each_form(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, text string, zone string, date_order string")
    got = {r.i: r.utc_us for r in with_instants(df, F.col("text"), F.col("zone"), F.col("date_order")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong


def test_skipped_times_can_be_rejected(spark):
    df = spark.createDataFrame([("2025-03-30 02:30:00",), ("2025-03-30 03:30:00",), ("2025-10-26 02:30:00",)], "t string")
    got = [r.utc_us for r in with_instants(df, F.col("t"), F.lit("Europe/Berlin"), F.lit("dmy"), shift_gaps=False).collect()]
    assert got == [None, micros(2025, 3, 30, 1, 30), micros(2025, 10, 26, 0, 30)]


LISTING = "listing_id bigint, source_id string, created string, created_at string, fetched_at string, openrouter struct<created:bigint>, tz_name string, utc_us int"


def test_listings(spark, rows):
    data = [
        (1, "mirror", "1720242007", None, "2024/05/31 06:29", (1720242007000,), "x", 1),
        (1, "mirror", "1720242007", None, "2024/05/31 06:29", (1720242007000,), "x", 1),
        (2, None, None, "2024-01-01", None, None, "x", 1),
        (3, "unlisted", "soon", "", "0", (None,), "x", 1),
        (None, "mirror", "1720242007", None, None, None, "x", 1),
    ]
    zones = spark.createDataFrame([("mirror", "America/New_York", "mdy", 1)], "source_id string, tz_name string, date_order string, created int")
    got = rows(listing_instants(spark.createDataFrame(data, LISTING), zones))
    assert got == [
        (1, "created", 1720242007000000), (1, "fetched_at", micros(2024, 5, 31, 10, 29)), (1, "openrouter.created", 1720242007000000),
        (2, "created_at", micros(2024, 1, 1)),
    ]
    empty = spark.createDataFrame([], LISTING)
    assert listing_instants(empty, zones.limit(0)).count() == 0


def test_times_that_occur_twice(spark):
    zone = {"2025-10-26 02:30:00": "Europe/Berlin", "2025-10-26 02:30:00 CET": "Europe/Berlin", "2025-10-26 03:30:00": "Europe/Berlin", "2025-11-02 01:15": "America/New_York", "2025-04-06 01:45:00": "Australia/Lord_Howe", "2025-03-30 02:30:00": "Europe/Berlin", "soon": "UTC"}
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(zone.items())], "i int, t string, z string")
    def got(**options):
        found = with_instants(df, F.col("t"), F.col("z"), F.lit("dmy"), **options)
        return [r.utc_us for r in found.orderBy("i").collect()]
    first = [micros(2025, 10, 26, 0, 30), micros(2025, 10, 26, 1, 30), micros(2025, 10, 26, 2, 30), micros(2025, 11, 2, 5, 15), micros(2025, 4, 5, 14, 45), micros(2025, 3, 30, 1, 30), None]
    last = [micros(2025, 10, 26, 1, 30), first[1], first[2], micros(2025, 11, 2, 6, 15), micros(2025, 4, 5, 15, 15), first[5], None]
    assert got() == first and got(ambiguous="last") == last
    assert got(ambiguous="reject") == [None, first[1], first[2], None, None, first[5], None]
    assert got(ambiguous="reject", shift_gaps=False) == [None, first[1], first[2], None, None, None, None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert got(ambiguous="last", shift_gaps=False)[:5] == last[:5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
