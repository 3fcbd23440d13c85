"""Snapshot changes, instants, rolling totals and units on small cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators.instants import iso_utc, to_instants, wall_segments, zone_intervals
from sojourn.operators.rolling import rolling_totals
from sojourn.operators.snapshot_diff import snapshot_changes
from sojourn.operators.units import in_base_unit, nights_in, number_in, people_in, per_person_for_stay, tidy, to_common, totals_in_other_units

SNAP = "snapshot_no int, delivered_at timestamp, id long, title string, stars double, active boolean, last_seen_at timestamp, key string, hash string, idx int"


def _t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    numbers = [1, 2, 4, 5, 9]
    rows = []
    for no in numbers:
        for k in [*range(30), None]:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((no, _t(rng.randrange(500)), k, rng.choice(["A b", "A  b ", None, "", "Č", "Č", "B"]), rng.choice([None, 3.0]), True, _t(0), "x", None, 1))
    rows += rows[:10]
    want = set()
    best = {}
    for r in rows:
        import unicodedata

        said = (None if r[3] is None else unicodedata.normalize("NFC", "".join(r[3].split())), r[4])
        if (r[2], r[0]) not in best or r[1] > best[r[2], r[0]][0]:
            best[r[2], r[0]] = (r[1], said)
    ties = {}
    for r in rows:
        ties.setdefault((r[2], r[0], r[1]), set()).add((r[3], r[4]))
    for a, b in zip(numbers, numbers[1:], strict=False):
        for k in [*range(30), None]:
            x, y = best.get((k, a)), best.get((k, b))
            if x and not y:
                want.add((b, k, "removed"))
            elif y and not x:
                want.add((b, k, "added"))
            elif x and y and x[1] != y[1]:
                want.add((b, k, "changed"))
    clear = {k for k, v in ties.items() if len(v) == 1}
    sure = [r for r in rows if (r[2], r[0], r[1]) in clear]
    assert len(sure) > 100
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    unclear = {k[0] for k in ties if k not in clear}
    assert {g for g in got if g[1] not in unclear} == {w for w in want if w[1] not in unclear}


def test_changes_of_nothing_and_null_numbers(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0
    assert snapshot_changes(spark.createDataFrame([(None, _t(0), 1, "a", None, True, _t(0), None, None, 0)], SNAP)).count() == 0


CASES = [
    ("20260824", "2026-08-23T22:00:00.000000Z", "exact"),
    ("05072026", "2026-07-04T22:00:00.000000Z", "exact"),
    ("20260231", None, "unreadable"),
    ("2026-W53-5", "2026-12-31T23:00:00.000000Z", "exact"),
    ("2026-W54-1", None, "unreadable"),
    ("2026-366", None, "unreadable"),
    ("2026-278", "2026-10-04T22:00:00.000000Z", "exact"),
    ("20260306+01:00", "2026-03-05T23:00:00.000000Z", "exact"),
    ("2026-10-25 02:30", "2026-10-25T00:30:00.000000Z", "ambiguous"),
    ("2026-10-25 02:30 CET", "2026-10-25T01:30:00.000000Z", "exact"),
    ("2026-03-29T02:30:00", None, "nonexistent"),
    ("Ne 29. 3. 02:30 – Ne 5. 4. 18:55", None, "nonexistent"),
    ("13.–24. 5.", "2026-05-12T22:00:00.000000Z", "exact"),
    ("14.1.-21.1.", "2027-01-13T23:00:00.000000Z", "exact"),
    ("31. 6. – 7. 7.", None, "unreadable"),
    ("Apr 15, 2026 12:15 AM", "2026-04-14T22:15:00.000000Z", "exact"),
    ("2026-07-27T19:25:00[Europe/Istanbul]", "2026-07-27T16:25:00.000000Z", "exact"),
    ("2026-07-27T19:25:00[Nowhere/Land]", None, "unreadable"),
    ("1786538700872", "2026-08-12T12:45:00.872000Z", "exact"),
    ("24:00", None, "unreadable"),
    ("2026-05-05 24:00", None, "unreadable"),
    ("", None, "unreadable"),
    (None, None, "unreadable"),
    ("x" * 100_000, None, "unreadable"),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, c[0], dt.datetime(2026, 3, 1, 12), "old") for i, c in enumerate(CASES)], "i int, text string, seen timestamp, instant string")
    got = {r.i: (r.u, r.instant_status) for r in to_instants(df, "text", "seen").select("i", iso_utc(F.col("instant")).alias("u"), "instant_status").collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(CASES)}
    assert to_instants(df.limit(0), "text").count() == 0


def test_zone_intervals_cover_each_month(spark):
    rows = zone_intervals(spark, 2026, 2026).filter("zone = 'Europe/Prague'").orderBy("month").collect()
    assert len(rows) == 12
    assert [len(r.spans) for r in rows] == [1, 1, 2, 1, 1, 1, 1, 1, 1, 2, 1, 1]


def test_rolling_totals_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else dt.datetime(2026, 3, 20) + dt.timedelta(minutes=rng.randrange(60 * 24 * 40)), rng.choice([0, None, 5, 900])) for _ in range(200)]
    rows += rows[:20]
    got = {(r["offer"], r["day"]): r for r in rolling_totals(spark.createDataFrame(rows, "offer int, at timestamp, price int"), "offer", "at", "price").collect()}
    from zoneinfo import ZoneInfo

    daily: dict = {}
    for o, at, p in set(rows):
        if at is not None:
            day = at.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo("Europe/Prague")).date()
            daily.setdefault(o, {}).setdefault(day, []).append(p)
    want = 0
    for o, days in daily.items():
        d = min(days)
        while d <= max(days):
            want += 1
            for n in (7, 30):
                vs = [p for k in range(n) for p in days.get(d - dt.timedelta(days=k), []) if p and p > 0]
                r = got[o, d]
                assert (r[f"n_{n}"], r[f"sum_{n}"]) == (len(vs), sum(vs))
                assert r[f"mean_{n}"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)
            d += dt.timedelta(days=1)
    assert want == len(got)


def test_units(spark):
    texts = [("1.121,91 €", "1121.91"), ("CZK 8,100.00", "8100.00"), ("29920.0", "29920.0"), ("19\xa0920,- Kč", "19920"), ("34,5 tis. Kč", "34.5"), ("1.007.500,00 Ft", "1007500.00"), ("8.100", "8100"), ("na dotaz", None), (None, None), ("", None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(number_in(tidy(F.col("t"))).alias("n")).collect()
    assert [None if r.n is None else float(r.n) for r in got] == [None if n is None else float(n) for _, n in texts]
    people = [("2+1", 3), ("3 ADT 1 CHD", 4), ("3.0", 3), ("jeden dospělý a dítě", 2), ("dle obsazenosti", None), ("0", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in people], "t string").select(people_in(F.col("t"))).collect()] == [n for _, n in people]
    nights = [("8 dní", 7), ("8 dní / 7 nocí", 7), ("7N", 7), ("2 týdny", 14), ("x", None), ("1", 1), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in nights], "t string").select(nights_in(F.col("t"))).collect()] == [n for _, n in nights]


RATES = [("CZK", 1, 1.0), ("EUR", 1, 25.1), ("HUF", 100, 6.4)]


def test_amounts_per_person(spark):
    rates = spark.createDataFrame(RATES, "currency string, units int, czk double")
    cases = [("41200 Kč celkem", 2, 7, 20600), ("1296 Kč za osobu a noc", None, 11, 14256), ("51760 Kč za 2 os.", None, 7, 25880), ("26720", 3, 7, 8907), ("26720", None, 7, None), ("0", 2, 7, None), ("2 955 000 hal.", 2, 7, 14775), ("€100.00 / os.", None, 7, 2510), ("5 JPY", 2, 7, 3), (None, 2, 7, None)]
    df = spark.createDataFrame([(i, t, p, n, "clash") for i, (t, p, n, _) in enumerate(cases)], "i int, t string, p int, n int, amount string")
    out = to_common(df, "t", rates, "kč").select("i", per_person_for_stay(F.col("amount"), F.col("t"), F.col("p"), F.col("n"), False).alias("x")).collect()
    assert {r.i: r.x for r in out} == {i: c[3] for i, c in enumerate(cases)}


def test_totals_in_other_units(spark):
    rates = spark.createDataFrame(RATES, "currency string, units int, czk double")
    df = spark.createDataFrame([(1, 20000, 10000), (2, 797, 10000), (3, 2000000, 10000), (4, 20, 10000), (5, 312500, 10000), (6, None, 10000), (7, 5, 0), (8, 123, 10000)], "id int, t int, p int")
    got = {r.id: r.amount for r in totals_in_other_units(df, "t", "p", rates).collect()}
    assert got == {2: 20000, 3: 20000, 4: 20000, 5: 20000}


def test_segments_tell_double_and_missing_hours(spark):
    rows = wall_segments(spark, 2026, 2026).filter("zone = 'Europe/Prague'").collect()
    hour = 3_600_000_000
    day = lambda m, d: int(dt.datetime(2026, m, d, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    at = lambda us: [(r.hits, r.off // hour) for r in rows if r.lo <= us < r.hi and r.month == 2026 * 12 + dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc).month - 1]
    assert at(day(3, 29) + hour * 5 // 2) == []
    assert at(day(10, 25) + hour * 5 // 2) == [(2, 2)]
    assert at(day(3, 29) + 3 * hour) == [(1, 2)] and at(day(1, 1)) == [(1, 1)]


def test_rolling_totals_of_fractions(spark):
    rows = [(1, dt.datetime(2026, 3, d), v) for d, v in ((1, 10.7), (1, 0.5), (4, 2.0))]
    got = rolling_totals(spark.createDataFrame(rows, "e int, at timestamp, v double"), "e", "at", "v", (2,)).orderBy("day").collect()
    assert [(r.n_2, r.sum_2) for r in got] == [(2, pytest.approx(11.2)), (2, pytest.approx(11.2)), (0, 0), (1, 2.0)]
    exact = rolling_totals(spark.createDataFrame(rows, "e int, at timestamp, v double").withColumn("v", F.col("v").cast("decimal(9,2)")), "e", "at", "v", (2,))
    assert [str(r.sum_2) for r in exact.orderBy("day").collect()] == ["11.20", "11.20", "0.00", "2.00"]
    assert rolling_totals(spark.createDataFrame([], "e int, at timestamp, v double"), "e", "at", "v").count() == 0


def test_units_with_offset_and_field(spark):
    """Kelvin from text, field and default; a field that names no unit leaves it to the text."""
    units = spark.createDataFrame([("°c", "1", "273.15"), ("°f", "0.55555556", "255.37222222"), ("k", "1", "0")], "alias string, factor string, offset string")
    units = units.select("alias", F.col("factor").cast("decimal(20,8)").alias("factor"), F.col("offset").cast("decimal(20,8)").alias("offset"))
    rows = [("20 °C", None, 293.15), ("-40 °F", None, 233.15), ("300", None, 300.0), ("68", "°F", 293.15), ("20 °C", "?", 293.15), ("0 °C", "K", 0.0), ("cold", None, None), (None, "K", None)]
    df = spark.createDataFrame([(i, t, f, "x") for i, (t, f, _) in enumerate(rows)], "i int, t string, f string, amount string")
    got = {r.i: r.amount for r in in_base_unit(df, "t", units, "k", "f", r"(°c|°f|(?<!\p{L})k(?!\p{L}))", signed=True).collect()}
    for i, (_, _, want) in enumerate(rows):
        assert got[i] is None if want is None else float(got[i]) == pytest.approx(want, abs=1e-4)


def test_small_totals_in_other_units(spark):
    """Every unit and multiple from one piece on, against trying them all."""
    rates = spark.createDataFrame(RATES, "currency string, units int, czk double")
    rows = [(t, p) for t in (1, 2, 3, 7, 40, 799) for p in (1, 13, 24, 26, 38, 63, 79, 1003)]
    got = {(r.t, r.p): r.amount for r in totals_in_other_units(spark.createDataFrame(rows, "t int, p int"), "t", "p", rates).collect()}
    factors = [25.1, 0.064, 1000, 0.01]
    for t, p in rows:
        ways = [(abs(t - p * k / f), k) for f in factors for k in range(1, 5)]
        off, k = min(ways)
        want = None if (t % p == 0 and t // p <= 4) or off > 0.5 + 1e-6 else k * p
        assert got.get((t, p)) == want
