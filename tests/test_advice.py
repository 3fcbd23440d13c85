"""What the review of round 1 found to be cut. The SQL here is written from SURVEY; queries_reference.ORACLE stays as it was."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from oracle import differences
from pyspark.sql import functions as F

from sojourn.operators import history as H
from sojourn.plans import queries_reference as R

SMALL = "/root/testdata/sf0.001"
tables_here = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")

LADDER = f"""
WITH {R._PN}, {R._MARKET}, {R._LOCALITY}, {R._HOTEL}, {R._OWN},
omnibus AS (SELECT offer_id, omnibus_lowest_price AS base FROM price_snapshots QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) = 1),
rungs AS (
  SELECT id, 1 AS place, 'own' AS reference, 1 AS times, baseline AS base, price AS now FROM priced JOIN own ON own.offer_id = priced.id
  UNION ALL SELECT id, 2, 'omnibus', 1, base, price FROM priced JOIN omnibus ON omnibus.offer_id = priced.id
  UNION ALL SELECT id, 3, 'hotel', nights, median, pn FROM pn JOIN hotel USING (id)
  UNION ALL SELECT id, 4, 'locality', nights, median, pn FROM pn JOIN locality USING (id)
  UNION ALL SELECT id, 5, 'market', nights, median, pn FROM pn JOIN market USING (id)),
first AS (SELECT * FROM rungs WHERE base > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1)
SELECT priced.id, reference, CAST(floor(base * times + 0.5) AS BIGINT) AS baseline, CAST(floor((base - now) / base * 100 + 0.5) AS BIGINT) AS real_pct
FROM priced LEFT JOIN first ON first.id = priced.id"""


@tables_here
def test_ladder_equals_survey_sql(spark):
    assert differences(R.reference_ladder(spark, SMALL), LADDER, SMALL) == ""


def test_ladder_rungs_in_total(spark, tmp_path):
    # (id, nights, omnibus of the older row, of the newer row); only offer 1 has an own baseline
    cases = [(1, None, None, 9000), (2, None, 9000, 12000), (3, 0, None, 12001), (4, 7, None, 20000), (5, None, 9000, None), (6, 7, None, 0)]
    offers = [(i, "h", "Řecko", None, 4.0, "AI", dt.date(2026, 7, 1), n, True, f"m{i}", f"h{i}") for i, n, _, _ in cases]
    spark.createDataFrame(offers, "id long, title string, country string, locality string, stars double, board string, departure_date date, nights int, active boolean, match_key string, hotel_key string").write.parquet(f"{tmp_path}/offers.parquet")
    at = lambda day: dt.datetime(2026, 5, day, 12, tzinfo=dt.timezone.utc)
    prices = [(10 * i + k, i, at(1 + k), 10000, o) for i, _, old, new in cases for k, o in enumerate((old, new))] + [(k, 1, at(k), 8000, None) for k in (4, 6, 9)]
    spark.createDataFrame(prices, "id long, offer_id long, captured_at timestamp, price_per_person int, omnibus_lowest_price int").write.parquet(f"{tmp_path}/price_snapshots.parquet")
    got = {r.id: (r.reference, r.baseline, r.real_pct) for r in R.reference_ladder(spark, str(tmp_path)).collect()}
    none = (None, None, None)
    assert got == {1: ("own", 8000, -25), 2: ("omnibus", 12000, 17), 3: ("omnibus", 12001, 17), 4: ("omnibus", 20000, 50), 5: none, 6: none}


STREAKS = """
WITH r AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events)
SELECT user_id, count(*) FILTER (failed AND i IN (0, 1, 2)) = 3 AND count(*) FILTER (failed AND i = 3) = 0 AS alert FROM r WHERE i < 20 GROUP BY user_id"""


@tables_here
def test_streaks_equal_survey_sql(spark):
    assert differences(R.failure_streaks(spark, SMALL), STREAKS, SMALL) == ""


def test_streaks_query_asks_for_three(spark, tmp_path):
    users = ("error error error view", "error view", "error error error error", "error error view")
    rows = [(u, 100 - i, e) for u, seq in enumerate(users) for i, e in enumerate(seq.split())]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.alert for r in R.failure_streaks(spark, str(tmp_path)).collect()} == {0: True, 1: False, 2: False, 3: False}


def test_streaks_ignored(spark):
    # newest first; B rows are about backing off and fill the look-back of 20 raw rows, but break no chain
    runs = {"a": "FBFBBFS", "b": "FBFBFBF", "c": "BFF" + "B" * 17 + "F", "d": "FFF" + "B" * 17 + "F", "e": "BBB", "f": "FFBS"}
    rows = [(s, 1000 - i, c == "F", c == "B" or None) for s, seq in runs.items() for i, c in enumerate(seq)]
    df = spark.createDataFrame(rows, "s string, id int, f boolean, b boolean")
    got = {r.s: r.alert for r in H.streaks(df, "s", "id", F.col("f"), ignored=F.col("b")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": False}
