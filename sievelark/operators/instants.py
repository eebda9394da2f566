"""Texts of mixed date and time forms to one UTC instant.

A text is matched against a fixed list of forms by JVM regular expressions; a local time is
then resolved by an as-of join against exploded zone-offset intervals: one matching interval
gives the offset, two mean the time is ambiguous (the first is taken), none means a clock
change skipped it (it is moved forward by the gap, that is, read with the offset before it).

The interval table is read from the IANA files: for each different zone the local years from its
first clock change to its last, and for zones whose changes go on by rule a cycle of years,
to one of which, of the same length and first weekday, every later year is led back. So any year from 1 to 9999 has
its own offset, and the tables are a constant of some 60 thousand rows whatever the data: they are
broadcast. Everything else is a narrow projection: no shuffle, no Python.

Defined results: null, empty and unparsable texts, impossible dates and times, offsets
beyond 18 hours and unknown zones give a null instant (`kind` says why); digits finer than
a microsecond are dropped; leading and trailing white space is ignored; extra columns of
the input pass through untouched, names starting with `_i_` being reserved."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta
from functools import cache
from importlib.resources import files
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.session import table

#: Changes by rule are listed for one cycle: 28 years from the first, or 400 after the last listed change where that is later.
RULES_FROM, CYCLE, LONG_CYCLE = 2038, 28, 400
#: Bare numbers count from 1970 if that gives a date in these years.
EPOCH_YEARS = (2000, 2030)
#: Zone abbreviations of RFC 822 and a few common ones, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "CET": 60, "CEST": 120, "BST": 60, "WET": 0, "WEST": 60, "EET": 120, "EEST": 180,
    "JST": 540, "AEST": 600, "AEDT": 660,
}
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"

_ZONE = r"([Zz]|[A-Z]{2,5}|[+-]\d{2}:?\d{2}|\[?[A-Z][A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+\]?|\[[A-Z]{2,5}\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
#: Form -> (pattern, order of year|month|day|hour|minute|second|fraction|zone|half). A slash date has its order from the source.
_FORMS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ] *{_CLOCK} *{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(\d{2})?([Zz])?)?$", "$1|$2|$3|$4|$5|$6||$7|"),
    "year": (r"^(\d{4})$", "$1|1|1||||||"),
    "mdy": (rf"^(?:[A-Za-z]+, *)?([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})(?:,? +{_CLOCK} *([AaPp][Mm])? *{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    "dmy": (rf"^(?:[A-Za-z]+, *)?(\d{{1,2}}) +([A-Za-z]{{3,9}})\.? +(\d{{4}})(?:,? +{_CLOCK} *([AaPp][Mm])? *{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? +{_CLOCK} *([AaPp][Mm])? *{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAMES = r"^(?i)(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"


def _zone_file(name: str) -> bytes:
    """The TZif file of a zone, from the system's folders or the tzdata package."""
    for folder in TZPATH:
        if (f := Path(folder, name)).is_file():
            return f.read_bytes()
    return files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def listed_changes(raw: bytes) -> tuple[int, list[tuple[int, int]], str]:
    """(first offset, changes as UTC second and offset after it, rule of later ones) of a TZif file (RFC 8536), version 2 or later."""

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = counts(at)
    at += 44
    when = struct.unpack(f">{times}q", raw[at : at + 8 * times])
    which = raw[at + 8 * times : at + 9 * times]
    at += 9 * times
    offset = [struct.unpack(">l", raw[at + 6 * i : at + 6 * i + 4])[0] for i in range(types)]
    rule = raw[at + types * 6 + chars + leap * 12 + std + utc :].strip(b"\n").decode()
    out, last = [], offset[0]
    for t, k in zip(when, which, strict=True):
        if offset[k] != last:
            out.append((t, offset[k]))
            last = offset[k]
    return offset[0], out, rule


def _sec(t: datetime) -> int:
    return int((t - _EPOCH).total_seconds())


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def ruled_changes(name: str, since: int, until: int) -> list[tuple[int, int]]:
    """A zone's changes by its rule, from a UTC second to the end of a year, found by bisection between probes 14 days apart."""
    zone = ZoneInfo(name)
    off = lambda x: int((_EPOCH + timedelta(seconds=x)).astimezone(zone).utcoffset().total_seconds())
    out, a, last, step = [], since, off(since), 14 * 86400
    while a < _sec(datetime(until + 1, 2, 1, tzinfo=UTC)):
        if (now := off(a + step)) != last:
            x, y = a, a + step
            while y - x > 1:
                m = (x + y) // 2
                x, y = (m, y) if off(m) == last else (x, m)
            out.append((y, now))
            last = now
        a += step
    return out


@cache
def zone_tables() -> tuple[pd.DataFrame, pd.DataFrame]:
    """(zones, intervals): for each zone its clock, the years listed of it and the cycle of its rule (0 without one);
    for each clock and local year the offset intervals [from, to) in local seconds that touch the year."""
    far = 1 << 40
    clocks: dict[bytes, tuple] = {}
    zones, rows = [], []
    year = lambda x: (_EPOCH + timedelta(seconds=x)).year
    for name in sorted(available_timezones()):
        raw = _zone_file(name)
        if raw not in clocks:
            first, cuts, rule = listed_changes(raw)
            goes_on = "," in rule
            late = year(cuts[-1][0]) + LONG_CYCLE if cuts and year(cuts[-1][0]) >= RULES_FROM else RULES_FROM + CYCLE - 1
            if goes_on:
                cuts += ruled_changes(name, cuts[-1][0] if cuts else 0, late)
            cuts = [(-far, first), *cuts]
            lo = year(cuts[1][0]) - 1 if len(cuts) > 1 else 2000
            hi = late if goes_on else max(lo, year(cuts[-1][0]) + 1) if len(cuts) > 1 else lo
            clock = len(clocks)
            spans = [(a + o, (cuts[i + 1][0] if i + 1 < len(cuts) else far) + o, o) for i, (a, o) in enumerate(cuts)]
            at = 0
            for y in range(lo, hi + 1):
                a, b = _sec(datetime(y, 1, 1, tzinfo=UTC)), _sec(datetime(y + 1, 1, 1, tzinfo=UTC))
                while spans[at][1] <= a - 86400:
                    at += 1
                end = at
                while end < len(spans) and spans[end][0] < b + 86400:
                    end += 1
                rows.append((clock, y, [list(x) for x in spans[at:end]]))
            clocks[raw] = (clock, lo, hi, 0 if not goes_on else CYCLE if late < RULES_FROM + CYCLE else LONG_CYCLE)
        zones.append((name, *clocks[raw]))
    return pd.DataFrame(zones, columns=["_i_zone", "_i_clock", "_i_lo", "_i_hi", "_i_cycle"]), pd.DataFrame(rows, columns=["_i_clock", "_i_year", "_i_spans"])


def zone_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The zone and interval tables as DataFrames; their sizes depend on the IANA database alone."""
    zones, spans = zone_tables()
    return spark.createDataFrame(zones, "_i_zone string, _i_clock int, _i_lo int, _i_hi int, _i_cycle int"), spark.createDataFrame(spans, "_i_clock int, _i_year int, _i_spans array<array<bigint>>")


def _year_alike(year: Column) -> Column:
    """The year of the rule cycle with the same length and first weekday."""
    kind: dict[int, int] = {}
    for y in range(RULES_FROM, RULES_FROM + CYCLE):
        d = datetime(y, 1, 1)
        kind.setdefault((d.isoweekday() % 7) * 2 + (y % 4 == 0), y)
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    leap = (F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).cast("int")
    return F.element_at(F.create_map(*[F.lit(x) for kv in kind.items() for x in kv]), (F.dayofweek(new_year) - 1) * 2 + leap)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def to_instant(df: DataFrame, text: str, default_zone: Column | str | None = None, day_first: Column | None = None, out: str = "instant_us", kind: str | None = None) -> DataFrame:
    """Adds `out` (microseconds since 1970-01-01 UTC, or null) for the column `text`.

    default_zone: the zone of texts without one (a column or a name; UTC where null).
    day_first: the order in dates written in digits and slashes (month first where null;
    a first number above 12 is a day whatever this says).
    kind: if given, a column saying how it was found: number, fixed, unique, ambiguous,
    nonexistent, or why not: none."""
    zone0 = F.lit("UTC") if default_zone is None else F.lit(default_zone) if isinstance(default_zone, str) else default_zone
    first = F.coalesce(day_first, F.lit(False)) if day_first is not None else F.lit(False)
    s = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    df = df.withColumn("_i_s", s).withColumn("_i_dz", F.coalesce(zone0, F.lit("UTC"))).withColumn("_i_df", first)
    parts = F.lit(None).cast("string")
    for name, (pattern, order) in reversed(_FORMS.items()):
        parts = F.when(F.col("_i_s").rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace("_i_s", pattern, order))).otherwise(parts)
    digits = F.col("_i_s").rlike(r"^\d{9,18}$")
    df = df.withColumn("_i_p", F.when(~digits, F.split(parts, r"\|", -1)))
    g = lambda i: F.get("_i_p", F.lit(i))
    form, ampm = g(0), F.lower(g(9))
    a, b = _int(g(2)), _int(g(3))
    swap = (form == "slash") & ((F.col("_i_df") & (b <= 12)) | (a > 12))
    named = F.when(g(2).rlike(_MONTH_NAMES), ((F.instr(F.lit(_MONTHS), F.lower(F.substring(g(2), 1, 3))) + 2) / 3).cast("int"))
    month = F.when(form.isin("mdy", "dmy"), named).when(swap, b).otherwise(a)
    day = F.when(swap, a).otherwise(b)
    hour0 = F.when(g(4) == "", 0).otherwise(_int(g(4)))
    hour = F.when(ampm == "", hour0).when((hour0 >= 1) & (hour0 <= 12), hour0 % 12 + F.when(ampm == "pm", 12).otherwise(0))
    minute = F.when(g(5) == "", 0).otherwise(_int(g(5)))
    second = F.when(g(6) == "", 0).otherwise(_int(g(6)))
    frac = F.rpad(F.substring(g(7), 1, 6), 6, "0").cast("bigint")
    date = F.concat(g(1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    df = df.withColumn("_i_l", F.when(ok, (F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second)))
    df = df.withColumn("_i_f", F.when(g(7) == "", F.lit(0).cast("bigint")).otherwise(frac)).withColumn("_i_z", F.regexp_replace(g(8), r"[\[\]]", ""))
    df = df.withColumn("_i_y0", F.year(date))
    z = F.col("_i_z")
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    signed = z.rlike(r"^[+-]\d{2}:?\d{2}$")
    digits4 = F.regexp_replace(z, r"[+:\-]", "")
    hh, mm = F.substring(digits4, 1, 2).try_cast("int"), F.substring(digits4, 3, 2).try_cast("int")
    off = F.when(signed & (hh <= 18) & (mm < 60), (hh * 60 + mm) * F.when(z.startswith("-"), -1).otherwise(1)).when(~signed, F.try_element_at(abbr, F.upper(z)))
    df = df.withColumn("_i_o", off * 60)
    region = F.when(z == "", F.col("_i_dz")).when(z.contains("/"), z)
    region = F.when((region == "UTC") | F.col("_i_l").isNull(), F.lit(None)).otherwise(region)
    df = df.withColumn("_i_region", region)
    zones, spans = zone_frames(df.sparkSession)
    df = df.join(F.broadcast(zones), F.col("_i_region") == F.col("_i_zone"), "left")
    later = (F.col("_i_y0") > F.col("_i_hi")) & (F.col("_i_cycle") > 0)
    long = F.col("_i_hi") - (LONG_CYCLE - 1) + (F.col("_i_y0") - F.col("_i_hi") - 1) % LONG_CYCLE
    alike = F.when(later & (F.col("_i_cycle") == LONG_CYCLE), long).when(later, _year_alike(F.col("_i_y0"))).otherwise(F.greatest("_i_lo", F.least("_i_hi", "_i_y0")))
    df = df.withColumn("_i_y", alike)
    df = df.join(F.broadcast(spans.withColumnRenamed("_i_clock", "_i_c2")), (F.col("_i_clock") == F.col("_i_c2")) & (F.col("_i_y") == F.col("_i_year")), "left")
    moved = F.unix_date(F.make_date("_i_y0", F.lit(1), F.lit(1))) - F.unix_date(F.make_date("_i_y", F.lit(1), F.lit(1)))
    local = F.col("_i_l") - F.when(later, moved.cast("bigint") * 86400).otherwise(F.lit(0))
    hit = F.filter("_i_spans", lambda x: (x[0] <= local) & (local < x[1]))
    df = df.withColumn("_i_hit", hit)
    before = F.filter("_i_spans", lambda x: x[1] <= local)
    span = F.when(F.size("_i_hit") > 0, F.get("_i_hit", F.lit(0))).otherwise(F.get(before, F.size(before) - 1))
    zoned = F.col("_i_l") - F.get(span, F.lit(2))
    plain = F.when((z == "") & (F.col("_i_dz") == "UTC"), F.col("_i_l")).when(F.col("_i_o").isNotNull() & (z != ""), F.col("_i_l") - F.col("_i_o"))
    n = F.when(digits, F.col("_i_s").try_cast("bigint"))
    lo, hi = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (EPOCH_YEARS[0], EPOCH_YEARS[1] + 1))
    number = F.when(n.between(lo, hi - 1), n * 1_000_000)
    number = number.when(n.between(lo * 1000, hi * 1000 - 1), n * 1000).when(n.between(lo * 1_000_000, hi * 1_000_000 - 1), n)
    found = F.coalesce(number, (F.coalesce(plain, F.when(F.col("_i_spans").isNotNull(), zoned)) * 1_000_000 + F.col("_i_f")))
    extra = {}
    if kind:
        size = F.size("_i_hit")
        extra[kind] = F.when(found.isNull(), "none").when(number.isNotNull(), "number").when(plain.isNotNull(), "fixed").when(size > 1, "ambiguous").when(size == 1, "unique").otherwise("nonexistent")
    return df.withColumns({out: found, **extra}).drop(*[c for c in ("_i_s", "_i_dz", "_i_df", "_i_p", "_i_l", "_i_f", "_i_z", "_i_y0", "_i_y", "_i_o", "_i_region", "_i_zone", "_i_clock", "_i_c2", "_i_lo", "_i_hi", "_i_cycle", "_i_year", "_i_spans", "_i_hit")])


def stored_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed time of papers, blog_posts and feedback_events: tbl, row_key, text, zone, day_first."""
    papers = table(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("item_ord").cast("string").alias("row_key"), F.col("published_date").alias("text"), F.lit(None).cast("string").alias("zone"), F.lit(None).cast("boolean").alias("day_first"))
    feeds = table(spark, sf_dir, "blog_feeds").select("feed_key", F.col("tz").alias("zone"), "day_first").dropDuplicates(["feed_key"])
    blogs = table(spark, sf_dir, "blog_posts").select("post_id", "published_date", "feed_key").join(feeds, "feed_key", "left")
    blogs = blogs.select(F.lit("blog_posts").alias("tbl"), F.col("post_id").cast("string").alias("row_key"), F.col("published_date").alias("text"), "zone", "day_first")
    people = table(spark, sf_dir, "reviewers").select("reviewer", F.col("tz").alias("zone")).dropDuplicates(["reviewer"])
    events = table(spark, sf_dir, "feedback_events").select("event_id", "created_at", "reviewer").join(people, "reviewer", "left")
    events = events.select(F.lit("feedback_events").alias("tbl"), F.col("event_id").alias("row_key"), F.col("created_at").alias("text"), "zone", F.lit(None).cast("boolean").alias("day_first"))
    return papers.unionByName(blogs).unionByName(events)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored time that denotes an instant and is not already canonical; each row once."""
    rows = stored_instants(spark, sf_dir).where(F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL))
    return to_instant(rows, "text", F.col("zone"), F.col("day_first")).where("instant_us is not null").select("tbl", "row_key", "instant_us").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the times of each table were resolved: rows by kind."""
    rows = to_instant(stored_instants(spark, sf_dir), "text", F.col("zone"), F.col("day_first"), kind="kind")
    return rows.groupBy("tbl", "kind").agg(F.count("*").alias("n_rows"))
