"""Mixed timestamp formats and time zones brought to one UTC instant."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names as written in labels (Czech genitive, English, Roman).
MONTHS = {
    "ledna": 1, "února": 2, "března": 3, "dubna": 4, "května": 5, "června": 6,
    "července": 7, "srpna": 8, "září": 9, "října": 10, "listopadu": 11, "prosince": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12,
}
# Abbreviations that name an offset, in minutes.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180}

# Places written as zones that the zone database files under another name.
ZONE_ALIASES = {"America/Punta_Cana": "America/Santo_Domingo"}

DAY_US = 86_400_000_000
#: From so many years on the zones' segments aren't broadcast.
BROADCAST_YEARS = 8


@dataclass(frozen=True)
class Form:
    """One way to write a time: a pattern whose groups are the named parts, in order.

    Parts: y, mo (number or name), d, h, mi, s, frac, ap (AM/PM), off (+02:00, CEST), zone, week, wd, doy, sec, ms, and
    d_end for the day of a range that shares the month with its end.
    """

    pattern: str
    parts: tuple[str, ...]
    #: What a text of this form has for certain, told without a regular expression.
    sign: Callable[[Column], Column]


def _at(place: int, *chars: str) -> Callable[[Column], Column]:
    return lambda t: F.substring(t, place, 1).isin(*chars)


def _long(*sizes: int) -> Callable[[Column], Column]:
    return lambda t: F.length(t).isin(*sizes)


def _digit(place: int) -> Callable[[Column], Column]:
    return lambda t: F.substring(t, place, 1).between("0", "9")


def _has(text: str) -> Callable[[Column], Column]:
    return lambda t: F.contains(t, F.lit(text))


_CLOCK = r"(\d{1,2})[:.](\d{2})"
_WEEKDAY = r"(?:\p{L}{2,3}\.?\s+)?"
_OFF = r"(Z|UTC|GMT|WES?T|CES?T|EES?T|MSK|[+-]\d{2}:?\d{2})"

FORMS = (
    Form(r"^(\d{13})$", ("ms",), _long(13)),
    Form(r"^(\d{10})$", ("sec",), _long(10)),
    Form(r"^(\d{4})-W(\d{2})-(\d)$", ("y", "week", "wd"), _at(6, "W")),
    Form(r"^(\d{4})-(\d{3})$", ("y", "doy"), _long(8)),
    Form(rf"^(\d{{4}})[-/]?(\d{{2}})[-/]?(\d{{2}})(?:(?:T|\s)?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?\s*{_OFF}?(?:\[([A-Za-z0-9_+/-]+)\])?$", ("y", "mo", "d", "h", "mi", "s", "frac", "off", "zone"), lambda t: _digit(4)(t) & _digit(3)(t) & _digit(1)(t)),
    Form(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", ("d", "mo", "y"), lambda t: _has("/")(t) & (F.length(t) <= 10)),
    Form(rf"^\p{{L}}{{3}},\s+(\d{{1,2}})\s+(\p{{L}}{{3}})\s+(\d{{4}})\s+(\d{{2}}):(\d{{2}}):(\d{{2}})\s*{_OFF}$", ("d", "mo", "y", "h", "mi", "s", "off"), _at(4, ",")),
    Form(r"^(\p{L}{3,})\s+(\d{1,2}),\s*(\d{4})(?:\s+(\d{1,2}):(\d{2})\s*([AaPp])[Mm])?$", ("mo", "d", "y", "h", "mi", "ap"), lambda t: _has(",")(t) & ~_digit(1)(t)),
    Form(rf"^(\d{{1,2}})\.\s*(\p{{L}}{{3,}})\s+(\d{{4}})(?:\s+{_CLOCK})?$", ("d", "mo", "y", "h", "mi"), lambda t: _digit(1)(t) & (_at(2, ".")(t) | _at(3, ".")(t)) & ~_has("–")(t)),
    # Labels of a departure and a return; only the departure is taken.
    Form(rf"^(?:odjezd\s+)?{_WEEKDAY}(\d{{1,2}})\.\s*(\d{{1,2}})\.(?:\s*(\d{{4}}|\d{{2}})(?![\d:.]))?(?:\s+(?:v\s+)?{_CLOCK})?", ("d", "mo", "y", "h", "mi"), _has(".")),
    Form(r"^(\d{1,2})\.\s*[–-]\s*(\d{1,2})\.\s*(\d{1,2})\.(?:\s*(\d{4}|\d{2})(?![\d:.]))?", ("d", "d_end", "mo", "y"), _digit(1)),
    Form(rf"^{_WEEKDAY}(\d{{1,2}})/(\d{{1,2}})(?:/(\d{{4}}))?\s*[–-]", ("d", "mo", "y"), _has("/")),
    Form(rf"^{_WEEKDAY}(\d{{1,2}})\.?\s+(\p{{L}}+)\.?(?:\s+(\d{{4}}))?\s*[–-]", ("d", "mo", "y"), _has(" ")),
)
#: Day first, without separators; tried where the eight digits are no date with the year first.
_DAY_FIRST = r"^(\d{2})(\d{2})(\d{4})$"

_PARTS = ("y", "mo", "d", "h", "mi", "s", "frac", "ap", "off", "zone", "week", "wd", "doy", "sec", "ms", "d_end")


def _pieces(text: Column) -> Column:
    """Array of the parts in the order of ``_PARTS`` ('' where not written) by the first form that fits, else null.

    Each form rewrites the text to its parts with bars between them, so that one expression serves all parts. Only forms
    whose sign a text has are tried.
    """
    chain = F.lit(None).cast("string")
    for form in reversed(FORMS):
        at = {p: i + 1 for i, p in enumerate(form.parts)}
        parts = "|".join(f"${at[p]}" if p in at else "" for p in _PARTS)
        chain = F.when(form.sign(text) & text.rlike(form.pattern), F.regexp_replace(text, form.pattern + ".*", parts)).otherwise(chain)
    return F.split(chain, r"\|", -1)


def _num(c: Column) -> Column:
    return c.try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    """Date or null where the calendar has no such day."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last), F.make_date(y, m, d))


def zone_intervals(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``(zone, month, spans)``: for each zone and calendar month the intervals of wall time with their UTC offset.

    ``month`` is year * 12 + month - 1 and ``spans`` an array of (lo, hi, off) in microseconds of wall time, of the
    offsets in force at any moment of that month. Where two of them overlap a wall time occurs twice, between two that
    don't touch it never occurs. Rows: zones (about 600) times months; its size depends on nothing else, so it may be
    broadcast.
    """
    schema = "zone string, month int, spans array<struct<lo:bigint,hi:bigint,off:bigint>>"
    return spark.createDataFrame(_interval_rows(first_year, last_year), schema)


def wall_segments(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``(zone, month, lo, hi, hits, off)``: :func:`zone_intervals` exploded, overlaps apart.

    Within [lo, hi) of wall time ``hits`` intervals match: 1, or 2 where the hour occurs twice (``off`` is the offset
    of the first occurrence). Wall times that never occur lie in no segment; a wall time lies in one segment at most.
    """
    rows = []
    for zone, month, spans in _interval_rows(first_year, last_year):
        edges = sorted({e for lo, hi, _ in spans for e in (lo, hi)})
        for lo, hi in zip(edges, edges[1:], strict=False):
            offs = [o for a, z, o in spans if a <= lo and hi <= z]
            if offs:
                rows.append((zone, month, lo, hi, len(offs), max(offs)))
    return spark.createDataFrame(rows, "zone string, month int, lo bigint, hi bigint, hits int, off bigint")


@functools.lru_cache(maxsize=4)
def _interval_rows(first_year: int, last_year: int) -> list[tuple]:
    utc, us = dt.timezone.utc, dt.timedelta(microseconds=1)
    epoch = dt.datetime(1970, 1, 1)
    start, end = dt.datetime(first_year, 1, 1) - dt.timedelta(days=2), dt.datetime(last_year + 1, 1, 1) + dt.timedelta(days=2)
    rows = []
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)

        def offset(t: dt.datetime, zone: zoneinfo.ZoneInfo = zone) -> dt.timedelta:
            return t.replace(tzinfo=utc).astimezone(zone).utcoffset()

        t, off, spans = start, offset(start), []
        began = start
        while t < end:
            after = min(t + dt.timedelta(days=7), end)
            if offset(after) != off:
                lo, hi = t, after
                while hi - lo > dt.timedelta(seconds=1):
                    mid = lo + (hi - lo) // 2
                    mid = mid.replace(microsecond=0)
                    if mid <= lo:
                        break
                    lo, hi = (lo, mid) if offset(mid) != off else (mid, hi)
                spans.append((began, hi, off))
                began, off = hi, offset(hi)
            t = after
        spans.append((began, end, off))
        wall = [((a + o - epoch) // us, (b + o - epoch) // us, o // us) for a, b, o in spans]
        for y in range(first_year, last_year + 1):
            for m in range(12):
                lo = (dt.datetime(y, m + 1, 1) - epoch) // us
                hi = (dt.datetime(y + m // 11, (m + 1) % 12 + 1, 1) - epoch) // us
                rows.append((name, y * 12 + m, [w for w in wall if w[0] < hi and w[1] > lo]))
    by_zone = {}
    for r in rows:
        by_zone.setdefault(r[0], []).append(r)
    rows += [(alias, m, spans) for alias, name in ZONE_ALIASES.items() for _, m, spans in by_zone.get(name, [])]
    return rows


def to_instants(df: DataFrame, text: str, reference: str | None = None, zone: str = "Europe/Prague", years: tuple[int, int] = (2026, 2027)) -> DataFrame:
    """``df`` plus ``instant`` (timestamp), ``instant_status`` and ``instant_wall_us`` (wall time, microseconds).

    Status: ``exact``; ``ambiguous`` (the hour occurs twice and the text doesn't say which: the first is taken);
    ``nonexistent`` (the hour is skipped: no instant); ``unreadable`` (null, empty, no known form, no day of the
    calendar, a year outside ``years``: no instant). A bare wall time is in ``zone``, a bare date is midnight there or
    in the offset written with it. A missing year gives the first such day on or after the day of ``reference`` in
    ``zone``. Eight digits are read year first, else day first.

    Every row is looked up once in :func:`wall_segments`, by zone, month and range. That table has about 600 zones times
    the months of ``years`` rows; it is broadcast below ``BROADCAST_YEARS`` years (some 4 MB then), else Spark chooses by
    its size. Added columns replace columns of the same names.
    """
    first_year, last_year = years
    spark = df.sparkSession
    clean = F.trim(F.regexp_replace(df[text].cast("string"), r"(?U)\s+", " "))
    day_first = F.regexp_extract(clean, _DAY_FIRST, 0)
    year_first_ok = F.try_to_date(F.when(day_first != "", clean), "yyyyMMdd")
    swapped = F.when((day_first != "") & ~F.coalesce(F.year(year_first_ok).between(first_year, last_year), F.lit(False)), F.regexp_replace(clean, _DAY_FIRST, "$3-$2-$1")).otherwise(clean)
    # The text in a column of its own, so that it is cleaned once for all forms.
    base = df.drop("instant", "instant_status", "instant_wall_us").withColumn("__t", swapped).withColumn("__p", _pieces(F.col("__t")))
    p = {x: F.get("__p", F.lit(i)) for i, x in enumerate(_PARTS)}
    names = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    month = F.coalesce(_num(p["mo"]), F.try_element_at(names, F.lower(p["mo"])))
    day, day_end = _num(p["d"]), _num(p["d_end"])
    month = F.when(day_end < day, F.when(month == 1, 12).otherwise(month - 1)).otherwise(month)
    year = F.when(F.length(p["y"]) == 2, _num(p["y"]) + 2000).otherwise(_num(p["y"]))
    base = base.withColumn("__y", year).withColumn("__m", month).withColumn("__d", day)
    y, m, d = F.col("__y"), F.col("__m"), F.col("__d")
    if reference is not None:
        seen = F.to_date(F.from_utc_timestamp(df[reference], zone))
        # Nine years hold every day of the calendar, also 29 February over a century.
        nearest = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: _date(F.year(seen) + k, m, d)), lambda x: x >= seen), F.lit(0))
    else:
        nearest = F.lit(None).cast("date")
    y4 = F.make_date(y, F.lit(1), F.lit(4))
    weeks = F.date_add(F.date_sub(y4, F.weekday(y4)), (_num(p["week"]) - 1) * 7 + _num(p["wd"]) - 1)
    of_week = F.when(_num(p["wd"]).between(1, 7) & (F.weekofyear(weeks) == _num(p["week"])), weeks)
    of_year = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), _num(p["doy"]) - 1)
    date = (
        F.when(p["week"] != "", F.when(y.isNotNull(), of_week))
        .when(p["doy"] != "", F.when(F.year(of_year) == y, of_year))
        .when(p["y"] == "", nearest)
        .otherwise(_date(y, m, d))
    )
    hour, minute, second = (F.coalesce(_num(p[x]), F.lit(0)) for x in ("h", "mi", "s"))
    hour = F.when(p["ap"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(p["ap"]) == "p", 12).otherwise(0))
    micros = _num(F.rpad(F.substring(p["frac"], 1, 6), 6, "0"))
    micros = F.when(p["frac"] == "", 0).otherwise(micros)
    clock = F.when((hour < 24) & (minute < 60) & (second < 60), ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + micros)
    wall = F.unix_date(date).cast("long") * DAY_US + clock

    letters = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    signed = F.regexp_extract(p["off"], r"^([+-])(\d{2}):?(\d{2})$", 1)
    minutes = F.when(signed != "", (_num(F.substring(p["off"], 2, 2)) * 60 + _num(F.substring(p["off"], -2, 2))) * F.when(signed == "-", -1).otherwise(1)).otherwise(F.try_element_at(letters, p["off"]))
    epoch = F.coalesce(p["sec"].try_cast("long") * 1_000_000, p["ms"].try_cast("long") * 1000)
    base = base.withColumn("__w", wall).withColumn("__epoch", epoch).withColumn("__off", F.when(p["zone"] == "", minutes.cast("long") * 60_000_000)).withColumn("__zone", F.when(p["zone"] == "", F.lit(zone)).otherwise(p["zone"]))
    whole = F.date_from_unix_date(F.floor(F.col("__w") / DAY_US).cast("int"))
    base = base.withColumn("__month", F.year(whole) * 12 + F.month(whole) - 1)
    # The as-of join: a wall time lies in one segment of its zone and month, or never occurs.
    segments = wall_segments(spark, first_year, last_year)
    segments = segments.select(F.col("zone").alias("__zone_2"), F.col("month").alias("__month_2"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("hits").alias("__hits"), F.col("off").alias("__shift"))
    if last_year - first_year < BROADCAST_YEARS:
        segments = F.broadcast(segments)
    inside = (F.col("__zone") == F.col("__zone_2")) & (F.col("__month") == F.col("__month_2")) & (F.col("__lo") <= F.col("__w")) & (F.col("__w") < F.col("__hi"))
    found = base.join(segments, inside, "left")
    fixed = F.coalesce(F.col("__epoch"), F.col("__w") - F.col("__off"))
    instant = F.coalesce(fixed, F.col("__w") - F.col("__shift"))
    in_years = F.year(F.date_from_unix_date(F.floor(F.coalesce(F.col("__w"), F.col("__epoch")) / DAY_US).cast("int"))).between(first_year, last_year)
    zones = sorted({r[0] for r in _interval_rows(first_year, last_year)})
    status = (
        F.when(~F.coalesce(in_years, F.lit(False)), "unreadable").when(fixed.isNotNull(), "exact").when(~F.col("__zone").isin(*zones), "unreadable")
        .when(F.col("__hits").isNull(), "nonexistent").when(F.col("__hits") == 1, "exact").otherwise("ambiguous")
    )
    keep = [found[c] for c in base.columns if not c.startswith("__")]
    out = found.select(*keep, instant.alias("__i"), status.alias("instant_status"), F.col("__w").alias("instant_wall_us"))
    known = F.col("instant_status").isin("exact", "ambiguous")
    return out.withColumn("instant", F.when(known, F.timestamp_micros("__i"))).drop("__i")


def iso_utc(instant: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of an instant, whatever the session's zone."""
    us = F.unix_micros(instant)
    day = F.date_from_unix_date(F.floor(us / DAY_US).cast("int"))
    rest = F.pmod(us, F.lit(DAY_US))
    hours, minutes, seconds = (F.floor(rest / k).cast("int") for k in (3_600_000_000, 60_000_000, 1_000_000))
    clock = F.format_string("T%02d:%02d:%02d.%06dZ", hours, minutes % 60, seconds % 60, (rest % 1_000_000).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), clock)
