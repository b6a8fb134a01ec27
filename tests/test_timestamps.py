from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomdoc.operators.timestamps import lag_counts, normalise_timestamps, possible_zones, zone_histories

CASES = [
    ("Thu, 20 Feb 2025 20:15:23 +0000", "2025-02-20T20:15:23Z"),
    ("Sat, 23 Jul 2022 15:32:36 +0100 (IST)", "2022-07-23T14:32:36Z"),
    ("Fri, 28 Jun 2024\r\n 15:37:01 -0400", "2024-06-28T19:37:01Z"),
    ("Sat,\t25 Jan 2025 09:13:13 -0600", "2025-01-25T15:13:13Z"),
    ("Thu, 07 Sep 23 16:43:14 UT", "2023-09-07T16:43:14Z"),
    ("Sat, 15 Apr 2023 19:56:21 CST", "2023-04-16T01:56:21Z"),
    ("Mon, 25 Mar 2024 02:00 CET", "2024-03-25T01:00:00Z"),
    ("2024-09-28T21:16:01,155-04:00", "2024-09-29T01:16:01Z"),
    ("2022-10-16T04:29:32.994326−05:00", "2022-10-16T09:29:32Z"),
    ("2025-12-19T02:03:37,718-08", "2025-12-19T10:03:37Z"),
    ("2025-06-12T05:25:40+0300", "2025-06-12T02:25:40Z"),
    ("2022-02-23 02:16:07.168Z", "2022-02-23T02:16:07Z"),
    ("20220223T083826Z", "2022-02-23T08:38:26Z"),
    ("D:20250926141911-07'00'", "2025-09-26T21:19:11Z"),
    ("1726901760", "2024-09-21T06:56:00Z"),
    ("1641707283612", "2022-01-09T05:48:03Z"),
    ("1687487184403141", "2023-06-23T02:26:24Z"),
    ("1649287021.954", "2022-04-06T23:17:01Z"),
    ("2025-04-19 05:17:21 America/Chicago", "2025-04-19T10:17:21Z"),
    ("2023-09-05T04:12:58[Asia/Tokyo]", "2023-09-04T19:12:58Z"),
    ("Do. 25. August 2022 13:34:34 +00:00", "2022-08-25T13:34:34Z"),
    ("lun. 26 déc. 2022 14:45:21 -0500", "2022-12-26T19:45:21Z"),
    ("mar. 19 mars 2024 15:47:31 +0100", "2024-03-19T14:47:31Z"),
    # without a zone: wall time in Berlin
    ("2022-03-21 18:47:39.902", "2022-03-21T17:47:39Z"),
    ("2022/11/13 05:58", "2022-11-13T04:58:00Z"),
    ("01.02.2022 20:36", "2022-02-01T19:36:00Z"),
    ("July 18, 2025 at 12:05 AM", "2025-07-17T22:05:00Z"),
    ("July 7, 2024 12:47 PM", "2024-07-07T10:47:00Z"),
    ("Fri Dec  5 16:37:08 2025", "2025-12-05T15:37:08Z"),
    ("Sun, 30 Oct 2022 02:31:02", "2022-10-30T00:31:02Z"),  # twice: the first
    ("Sun, 27 Mar 2022 02:30:00", "2022-03-27T01:30:00Z"),  # skipped: later by the skip
    # none
    ("2024-02-21", None), ("0000-00-00 00:00:00", None), ("unknown", None), ("", None), (None, None), ("2025-02-30T20:53:35Z", None), ("Tue, 34 Oct 2023 14:13:42 +0000", None),
    ("2024-01-01 24:00:00", None), ("2024-01-01 10:61:00", None), ("x" * 100_000, None), ("July 7, 2024 13:47 PM", None),
]


def test_cases(spark):
    rows = [(i, h, "b") for i, (h, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, h string, s string")
    zones = spark.createDataFrame([("b", "Europe/Berlin")], "source string, zone string")
    got = {r.i: r.utc_second for r in normalise_timestamps(df, "h", source="s", zones=zones).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("zone", ["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"])
def test_wall_time_against_the_zone_database(spark, zone):
    walls = [datetime(2022, 1, 1) + timedelta(hours=7 * i, minutes=13) for i in range(2000)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S"),) for w in walls], "h string")
    out = normalise_timestamps(df.withColumn("s", F.lit("x")), "h", source="s", zones=spark.createDataFrame([("x", zone)], "source string, zone string"))
    z = ZoneInfo(zone)
    for r in out.collect():
        w = datetime.strptime(r.h, "%Y-%m-%d %H:%M:%S")
        assert r.utc_second == w.replace(tzinfo=z).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), r.h


def test_missing_zone_is_estimated(spark):
    z = ZoneInfo("Asia/Tokyo")
    rows = []
    for i in range(400):
        sent = datetime(2023, 1, 1, tzinfo=UTC) + timedelta(hours=11 * i)
        rows.append(("a", sent.astimezone(z).strftime("%Y-%m-%d %H:%M:%S"), (sent + timedelta(minutes=37 * (i % 38))).replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "s string, h string, seen timestamp")
    out = normalise_timestamps(df, "h", source="s", seen="seen", zones=spark.createDataFrame([], "source string, zone string"))
    first = out.orderBy("h").first()
    assert first.utc_second == "2023-01-01T00:00:00Z"


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "h string, s string, zone string, source string, place string")
    assert normalise_timestamps(df, "h", source="s").columns == [*df.columns, "utc_second"]
    one = spark.createDataFrame([("2024-01-01T00:00:00Z", "s", "zz", "q", "p")] * 2, df.schema)
    assert [r.utc_second for r in normalise_timestamps(one, "h", source="s").collect()] == ["2024-01-01T00:00:00Z"] * 2
    seen = df.withColumn("seen", F.lit(None).cast("timestamp"))
    assert normalise_timestamps(seen, "h", source="s", seen="seen").columns == [*seen.columns, "utc_second"]


def test_zones_outside_the_list_and_ties(spark):
    """Any zone of the database can be found, and sources whose rows fit several are not given one of them."""
    def rows(name, zone, n, step, lags):
        z, out = ZoneInfo(zone), []
        for i in range(n):
            sent = datetime(2023, 1, 1, tzinfo=UTC) + timedelta(hours=step * i)
            wall = sent.astimezone(z).replace(tzinfo=UTC)
            out.append((name, int(wall.timestamp()), int(sent.timestamp()) + lags[i % len(lags)]))
        return out

    wide = [0, 60, 3000, 7000]
    data = [*rows("kathmandu", "Asia/Kathmandu", 300, 29, wide), *rows("la", "America/Los_Angeles", 300, 29, wide), *rows("few", "Asia/Tokyo", 2, 5, [3000])]
    df = spark.createDataFrame(data, "s string, l long, seen long")
    lag = lag_counts(spark.createDataFrame([(0, x) for x in wide * 50] + [(None, 5)], "sent long, seen long"), "sent", "seen")
    got = {r.source: r for r in possible_zones(df, "s", "l", "seen", lag).collect()}
    same = zone_histories(spark)
    assert got["kathmandu"].zone == same["Asia/Kathmandu"] and got["la"].zone == "America/Los_Angeles"
    assert got["kathmandu"].violations == got["la"].violations == 0 and got["la"].rows == 300
    assert got["few"].zone is None and {"Asia/Tokyo", "Australia/Sydney"} - set(got["few"].zones) == {"Australia/Sydney"} and len(got["few"].zones) > 1
    none = lag_counts(spark.createDataFrame([], "sent long, seen long"), "sent", "seen")
    assert possible_zones(df, "s", "l", "seen", none).count() == 3 and possible_zones(df.limit(0), "s", "l", "seen", none).count() == 0


def test_stated_zone_against_the_rows(spark):
    """Of the likely histories the stated one is taken; one that the rows speak against is overruled; a source without rows keeps it."""
    rows = []
    for name, zone in (("tie", "Europe/Rome"), ("wrong", "Asia/Tokyo")):
        for i in range(300):
            sent = datetime(2023, 1, 1, tzinfo=UTC) + timedelta(hours=29 * i)
            rows.append((name, sent.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), (sent + timedelta(minutes=7 * (i % 9))).replace(tzinfo=None)))
            rows.append(("stated", sent.strftime("%Y-%m-%d %H:%M:%S +0000"), (sent + timedelta(minutes=7 * (i % 9))).replace(tzinfo=None)))
    rows.append(("lone", "2023-07-01 10:00:00", None))
    df = spark.createDataFrame(rows, "s string, h string, seen timestamp")
    zones = spark.createDataFrame([("tie", "Europe/Rome"), ("wrong", "America/Chicago"), ("lone", "Asia/Kolkata")], "source string, zone string")
    got = {r.s: r.utc_second for r in normalise_timestamps(df, "h", source="s", seen="seen", zones=zones).groupBy("s").agg(F.min("utc_second").alias("utc_second")).collect()}
    assert got == {"tie": "2023-01-01T00:00:00Z", "wrong": "2023-01-01T00:00:00Z", "stated": "2023-01-01T00:00:00Z", "lone": "2023-07-01T04:30:00Z"}
