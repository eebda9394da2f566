"""Typed times against a second reading with the standard library."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import functions as F

from sievelark.operators import instants as I


def us(t):
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def local(y, mo, d, h=0, mi=0, s=0, tz="UTC"):
    """The instant of a local time: the first of two, or moved forward over a gap (fold 0 reads with the offset before it)."""
    return us(datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(tz)).astimezone(UTC))


CASES = [
    ("2024-11-20t00:32:59z", None, None, local(2024, 11, 20, 0, 32, 59)),
    ("2015-11-13T04:02:02.836252973Z", None, None, local(2015, 11, 13, 4, 2, 2) + 836252),
    ("2019-11-08T01:48:50.5Z", None, None, local(2019, 11, 8, 1, 48, 50) + 500000),
    ("2021", "Asia/Tokyo", None, local(2021, 1, 1, tz="Asia/Tokyo")),
    ("20180518", None, None, local(2018, 5, 18)),
    ("20150910T050623Z", "Asia/Tokyo", None, local(2015, 9, 10, 5, 6, 23)),
    ("1700200292", None, None, 1700200292_000000),
    ("1700200292336", None, None, 1700200292336_000),
    ("1725391196616252", None, None, 1725391196616252),
    ("999999999", None, None, local(2001, 9, 9, 1, 46, 39)),
    ("99999999999999999", None, None, None),
    ("2024-05-17T23:48:28+10:00", "UTC", None, local(2024, 5, 17, 13, 48, 28)),
    ("2015-09-17 08:50:08 -0530", "UTC", None, local(2015, 9, 17, 14, 20, 8)),
    ("2015-09-17 08:50:08 +1960", None, None, None),
    ("Sat, 18 Jan 2014 10:04:22 EST", None, None, local(2014, 1, 18, 15, 4, 22)),
    ("14 Jan 2024, 00:31", "Asia/Kolkata", None, local(2024, 1, 14, 0, 31, tz="Asia/Kolkata")),
    ("April 20, 2020 12:18 AM", None, None, local(2020, 4, 20, 0, 18)),
    ("April 20, 2020 12:18 PM", None, None, local(2020, 4, 20, 12, 18)),
    ("April 20, 2020 13:18 PM", None, None, None),
    ("May 6, 2021", None, None, local(2021, 5, 6)),
    ("Mayday 6, 2021", None, None, None),
    ("12/09/2024 05:11", "Europe/Berlin", True, local(2024, 9, 12, 5, 11, tz="Europe/Berlin")),
    ("12/09/2024 05:11", "America/New_York", False, local(2024, 12, 9, 5, 11, tz="America/New_York")),
    ("29/12/2024 17:42", None, False, local(2024, 12, 29, 17, 42)),
    ("2024-12-19T21:12:09 America/New_York", "Asia/Tokyo", None, local(2024, 12, 19, 21, 12, 9, "America/New_York")),
    ("2021-10-28T05:26:24[Asia/Kolkata]", None, None, local(2021, 10, 28, 5, 26, 24, "Asia/Kolkata")),
    ("2018-01-31T13:49:26[UTC]", "Asia/Tokyo", None, local(2018, 1, 31, 13, 49, 26)),
    ("2023-11-05 01:30:00", "America/New_York", None, local(2023, 11, 5, 1, 30, tz="America/New_York")),
    ("2024-03-31 02:30", "Europe/Berlin", None, local(2024, 3, 31, 2, 30, tz="Europe/Berlin")),
    ("2050-07-01 12:00", "Australia/Sydney", None, local(2050, 7, 1, 2)),
    ("2024-01-01 00:00", "Nowhere/Land", None, None),
    ("  2024-01-01 00:00\t", None, None, local(2024, 1, 1)),
    ("2023-02-30T10:00:00Z", None, None, None),
    ("2023-02-20T24:00:00Z", None, None, None),
    ("2024-13-45", None, None, None),
    ("0000-00-00", None, None, None),
    ("yesterday", None, None, None),
    ("", None, None, None),
    (None, "UTC", True, None),
]


def test_forms(spark):
    rows = [(i, t, z, d) for i, (t, z, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string, zone string, day_first boolean")
    got = {r.i: r.instant_us for r in I.to_instant(df, "text", F.col("zone"), F.col("day_first")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if c[3] != got[i]]
    assert not wrong


def test_every_hour_of_a_year(spark):
    zones = ["America/New_York", "Europe/London", "Australia/Sydney", "America/Bogota", "Asia/Kolkata", "Australia/Lord_Howe"]
    start = datetime(2024, 1, 1, 0, 30)
    rows = [(z, (start + timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S")) for z in zones for h in range(0, 366 * 24)]
    df = spark.createDataFrame(rows, "zone string, text string")
    for r in I.to_instant(df, "text", F.col("zone"), kind="kind").collect():
        t = datetime.strptime(r.text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r.zone))
        assert us(t.astimezone(UTC)) == r.instant_us, r
        assert (r.kind == "unique") == (t.utcoffset() == t.replace(fold=1).utcoffset())


def test_every_zone_in_early_and_late_years(spark):
    """No year is clamped: local times from 1850 to 2600 of every zone, days around New Year and the usual clock changes included."""
    days = [(1, 1), (3, 12), (3, 31), (7, 1), (10, 27), (11, 3), (12, 31)]
    zones = sorted(available_timezones() - {"localtime"})
    years = [1850, 1883, 1901, 1916, 1918, 1940, 1945, 1959, 1965, 1969, 1971, 2037, 2038, 2045, 2065, 2066, 2088, 2099, 2100, 2101, 2400, 2600]
    rows = [(z, f"{y}-{m:02}-{d:02} {(i * 7 + y) % 24:02}:30:00") for i, z in enumerate(zones) for y in years for m, d in days]
    df = spark.createDataFrame(rows, "zone string, text string")
    wrong = []
    for r in I.to_instant(df, "text", F.col("zone")).collect():
        t = datetime.strptime(r.text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r.zone))
        if us(t.astimezone(UTC)) != r.instant_us:
            wrong.append((r.zone, r.text, r.instant_us, us(t.astimezone(UTC))))
    assert not wrong, (len(wrong), wrong[:5])


def test_extra_columns_empty_and_repeats(spark):
    df = spark.createDataFrame([("2021", 1, "x"), ("2021", 1, "x")], "text string, tbl int, zone string")
    assert I.to_instant(df, "text").count() == 2
    assert I.to_instant(df.limit(0), "text").collect() == []
