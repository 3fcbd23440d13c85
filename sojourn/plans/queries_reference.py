"""Queries of the tracker's own operators over its tables, with the SQL that DuckDB checks them by."""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sojourn.functions import normalize as N
from sojourn.operators import criteria as C
from sojourn.operators import history as H
from sojourn.operators import peers as P
from sojourn.operators.ranks import number_rows
from sojourn.session import cut, table

#: The tables' present.
NOW = dt.datetime(2026, 5, 16, tzinfo=dt.timezone.utc)


def _offers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers")


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "price_snapshots")


def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    """match_key and hotel_key of every offer, computed anew; the table's own are the check."""
    o = _offers(spark, d)
    return o.select("id", N.match_key(o.title, o.country, o.departure_date, o.nights, o.board, o.departure_airport).alias("match_key"), N.hotel_key(o.title, o.country).alias("hotel_key"))


def normal_names(spark: SparkSession, d: str) -> DataFrame:
    """Names, airports, bands and months of offers."""
    o = _offers(spark, d)
    return o.select("id", N.strip(o.title).alias("stripped"), N.hotel_name(o.title).alias("name"), N.airport(o.departure_airport).alias("airport"), N.is_placeholder(o.title).alias("placeholder"), N.nights_band(o.nights).alias("band"), N.month_of(o.departure_date).alias("month"))


def raw_labels(spark: SparkSession, d: str) -> DataFrame:
    """Board, transport and country of the raw records of three tables (null where a table has no such label)."""
    names = {"alexandria_packages": ("board_name", "transport_name", "country_name"), "datour_packages": ("board_name", "transport_name", "country_name"), "zajezdy_departures": ("strava", None, "country_name")}
    parts = [table(spark, d, t).select(F.lit(t).alias("record_kind"), "raw_id", *[F.col(c).alias(a) if c else F.lit(None).cast("string").alias(a) for c, a in zip(cs, ("b", "t", "c"), strict=True)]) for t, cs in names.items()]
    raw = reduce(DataFrame.unionByName, parts)
    return raw.select("record_kind", "raw_id", N.board(F.col("b")).alias("board"), N.transport(F.col("t")).alias("transport"), N.country(F.col("c")).alias("country"), N.is_known_country(F.col("c")).alias("known"))


def raw_dates(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and dates in the raw texts of four tables."""
    names = {"alexandria_packages": ("package_price", "start"), "datour_packages": ("unit_price", "start"), "invia_terms": (None, "check_in_date"), "zajezdy_departures": ("po_sleve", "odjezd_prijezd")}
    parts = [table(spark, d, t).select(F.lit(t).alias("record_kind"), "raw_id", F.col(m).cast("string").alias("m") if m else F.lit(None).cast("string").alias("m"), F.col(w).alias("w")) for t, (m, w) in names.items()]
    return reduce(DataFrame.unionByName, parts).select("record_kind", "raw_id", N.czk(F.col("m")).alias("czk"), N.cz_date(F.col("w")).alias("day"))


def latest_price(spark: SparkSession, d: str) -> DataFrame:
    """A1: latest price of each offer by id."""
    return H.latest(_prices(spark, d), "offer_id", "id", ["price_per_person", "captured_at"])


def own_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A5: median of an offer's own 30 days."""
    return H.own_baseline(_prices(spark, d), "offer_id", "captured_at", "price_per_person", F.lit(NOW))


def sparkline(spark: SparkSession, d: str) -> DataFrame:
    """Last 14 prices of 30 days, as text."""
    recent = _prices(spark, d).filter(F.col("captured_at") >= F.lit(NOW) - F.expr("INTERVAL 30 DAYS"))
    return H.last_points(recent, "offer_id", "id", "price_per_person").select("offer_id", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"))


def price_moves(spark: SparkSession, d: str) -> DataFrame:
    """Changes of price."""
    return H.moves(_prices(spark, d), "offer_id", "id", "price_per_person")


def heartbeat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a change-or-heartbeat writer keeps."""
    return H.heartbeat(_prices(spark, d), "offer_id", "id", "captured_at", "price_per_person")


def _priced(spark: SparkSession, d: str, *also: str) -> DataFrame:
    """Active offers with their latest price, and with what ``also`` names of that row."""
    last = H.latest(_prices(spark, d), "offer_id", "id", ["price_per_person", *also]).withColumnsRenamed({"offer_id": "id", "price_per_person": "price"})
    return _offers(spark, d).filter("active").join(last, "id").filter("price > 0")


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """A3: cheapest offer of each match_key with up to three dearer ones."""
    r = H.representatives(_priced(spark, d).select("id", "match_key", "source", "price"), "match_key", "id", "price", ["source"])
    return r.select("id", "price", "source", F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["source"], a["price"].cast("string"))), ",").alias("alternatives"))


def _per_night(priced: DataFrame) -> DataFrame:
    p = priced.withColumn("pn", N.per_night(F.col("price"), F.col("nights"))).filter("pn is not null")
    return p.withColumn("band", N.nights_band(F.col("nights"))).withColumn("month", N.month_of(F.col("departure_date")))


def _market(pn: DataFrame) -> DataFrame:
    return P.leave_out_median(pn, ["country", "board", "stars", "band", "month"], "match_key", "id", "pn", 8)


def _locality(pn: DataFrame) -> DataFrame:
    return P.leave_out_median(pn.filter("locality is not null"), ["locality", "board", "stars", "month"], "match_key", "id", "pn", 8)


def _hotel(pn: DataFrame) -> DataFrame:
    return P.range_median(pn, ["hotel_key", "board"], "match_key", "id", "pn", "departure_date", 30, "nights", 2, 4, nullable=("board",))


def market_median(spark: SparkSession, d: str) -> DataFrame:
    """Median per night of the market bucket without the offer's own twins."""
    return _market(_per_night(_priced(spark, d)))


def locality_median(spark: SparkSession, d: str) -> DataFrame:
    """Median per night of the locality bucket."""
    return _locality(_per_night(_priced(spark, d)))


def hotel_median(spark: SparkSession, d: str) -> DataFrame:
    """Median per night of the hotel's terms near by."""
    return _hotel(_per_night(_priced(spark, d)))


def _ladder(spark: SparkSession, d: str, priced: DataFrame) -> DataFrame:
    """``(id, reference, baseline, real_pct)`` of priced offers; ``priced`` is read by each rung, so it should be written.

    The own and omnibus rungs are totals; the three others are per night, and offers below one night aren't in them.
    """
    pn = _per_night(priced)
    rows = priced.select("id", "price", "nights", N.per_night(F.col("price"), F.col("nights")).alias("pn"), F.col("omnibus_lowest_price").alias("omnibus"))
    for name, rung in (("hotel", _hotel(pn)), ("locality", _locality(pn)), ("market", _market(pn))):
        rows = rows.join(rung.select("id", F.col("median").alias(name)), "id", "left")
    rows = rows.join(own_baseline(spark, d).select(F.col("offer_id").alias("id"), F.col("baseline").alias("own")), "id", "left")
    reference, base = P.first_rung([(r, F.col(r)) for r in ("own", "omnibus", "hotel", "locality", "market")])
    rows = rows.withColumn("reference", reference).withColumn("base", base)
    in_total = F.col("reference").isin("own", "omnibus")
    now = F.when(in_total, F.col("price")).otherwise(F.col("pn"))
    rows = rows.withColumn("real_pct", N.half_up((F.col("base") - now) / F.col("base") * 100).cast("long"))
    shown = N.half_up(F.col("base") * F.when(in_total, 1).otherwise(F.col("nights"))).cast("long")
    return rows.select("id", "reference", shown.alias("baseline"), "real_pct")


def _fake(claimed: str) -> Column:
    """Q3: a claimed discount of 15 points or more beyond the real one."""
    return F.coalesce(F.col(claimed) - F.col("real_pct") >= 15, F.lit(False)).alias("fake")


def reference_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Q1, Q2: the first reference that an offer has, its baseline, and the price's distance from it in percent."""
    return _ladder(spark, d, cut(_priced(spark, d, "omnibus_lowest_price")))


def fake_claims(spark: SparkSession, d: str) -> DataFrame:
    """Q3: offers with their claimed discount and whether it exceeds the real one by 15 points or more."""
    priced = cut(_priced(spark, d, "omnibus_lowest_price", "claimed_discount_pct"))
    return _ladder(spark, d, priced).join(priced.select("id", "claimed_discount_pct"), "id").select("id", "claimed_discount_pct", "real_pct", _fake("claimed_discount_pct"))


#: Countries that a user has muted, in these queries.
EXCLUDED = ("Egypt", "Malta")
_CRITERIA = [("sea", ["Řecko", "Turecko", "Kypr"], ["AI", "HB"], [6, 7, 8], "flight", None, None), ("soon", [], [], [], None, 14, None), ("cheap", [], [], [], None, None, 9000)]


def _excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in EXCLUDED], "country string")


def _criteria(spark: SparkSession, *more: tuple) -> DataFrame:
    return spark.createDataFrame([*_CRITERIA, *more], "name string, countries array<string>, boards array<string>, months array<int>, transport string, within_days int, most int")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Visible groups of twins with their cheapest offer, its ladder and the group's least id; peers are all active offers."""
    priced = cut(_priced(spark, d, "omnibus_lowest_price", "claimed_discount_pct"))
    shown = C.visible(priced, _excluded(spark), F.lit(NOW)).select("id", "match_key", "price", "source", "country", F.col("claimed_discount_pct").alias("claimed"))
    groups = H.representatives(shown, "match_key", "id", "price", ["source", "country", "claimed"])
    first = shown.groupBy(H.twin_key(F.col("match_key"), F.col("id")).alias("twins")).agg(F.min("id").alias("first_id"))
    return groups.join(first, "twins").join(_ladder(spark, d, priced), "id")


def board(spark: SparkSession, d: str) -> DataFrame:
    """The offers to show: visible groups by their cheapest offer, those with a country filter
    after grouping and a least discount (null fails), with dearer offers, last prices and place (ties: first seen)."""
    rows = _grouped(spark, d).filter("country = 'Řecko' and real_pct >= 0")
    rows = rows.join(sparkline(spark, d).withColumnRenamed("offer_id", "id"), "id", "left").withColumn("points", F.coalesce("points", F.lit("")))
    rows = number_rows(rows.withColumn("less", -F.col("real_pct")), ["less", "first_id"], "place")
    others = F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["source"], a["price"].cast("string"))), ",")
    return rows.select("place", "id", "price", "source", "reference", "baseline", "real_pct", _fake("claimed"), others.alias("alternatives"), "points")


def digest(spark: SparkSession, d: str) -> DataFrame:
    """Q8, O2: the ten visible groups with the largest discount; ties: groups without a key first, then as first seen."""
    keyed = ~F.col("twins").startswith("id:")
    top = _grouped(spark, d).withColumn("keyed", keyed).orderBy(F.desc_nulls_last("real_pct"), "keyed", "first_id").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("real_pct"), "keyed", "first_id"))  # over ten rows
    return top.select(place.alias("place"), "id", "price", "reference", "baseline", "real_pct")


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Visible active offers; offers new in 24 hours, also inactive or departed ones, without excluded countries;
    median latest price of the offers that meet each criterion (null where none does), not grouped."""
    offers, excluded = _offers(spark, d), _excluded(spark)
    active = C.visible(offers.filter("active"), excluded, F.lit(NOW)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("active").alias("name"), "value")
    fresh = offers.filter(F.col("first_seen_at") >= F.lit(NOW) - F.expr("INTERVAL 1 DAY")).join(excluded, "country", "left_anti")
    fresh = fresh.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("new in 24 hours").alias("name"), "value")
    criteria = _criteria(spark, ("nowhere", ["Island"], [], [], None, None, 1))
    met = C.meet_criteria(C.visible(_priced(spark, d), excluded, F.lit(NOW)), criteria, F.lit(NOW)).groupBy("name").agg(F.median("price").alias("value"))
    medians = criteria.select("name").join(met, "name", "left").select(F.concat(F.lit("median of "), F.col("name")).alias("name"), "value")
    return active.unionByName(fresh).unionByName(medians)


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """A10: offers by value of four columns."""
    return H.facets(_offers(spark, d), ["country", "departure_airport", "source", "board"])


def first_fetched(spark: SparkSession, d: str) -> DataFrame:
    """The first of refetched records."""
    return H.first_wins(table(spark, d, "invia_terms").select("term_id", "fetched_at", "raw_id", "check_in_date"), "term_id", ["fetched_at", "raw_id"])


def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last three events, and not the one before, were errors."""
    return H.streaks(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")


def visible_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers not departed and not of two excluded countries."""
    return C.visible(_offers(spark, d), _excluded(spark), F.lit(NOW)).select("id", "country", "departure_date")


def criteria_medians(spark: SparkSession, d: str) -> DataFrame:
    """Offers that meet each of three criteria, and their median price."""
    met = C.meet_criteria(_priced(spark, d), _criteria(spark), F.lit(NOW))
    return met.groupBy("name").agg(F.count(F.lit(1)).alias("offers"), F.median("price").alias("median"))


def history_stats(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each offer's prices."""
    return C.history_stats(_prices(spark, d), "offer_id", "id", "captured_at", "price_per_person", F.lit(NOW))


QUERIES = {f.__name__: f for f in (identity_keys, normal_names, raw_labels, raw_dates, latest_price, own_baseline, sparkline, price_moves, heartbeat_rows, representatives, market_median, locality_median, hotel_median, reference_ladder, fake_claims, board, digest, stats, facet_counts, first_fetched, failure_streaks, visible_offers, criteria_medians, history_stats)}

_LATEST = "latest AS (SELECT offer_id, arg_max(price_per_person, id) AS price FROM price_snapshots GROUP BY offer_id)"
_PRICED = f"{_LATEST}, priced AS (SELECT o.*, l.price FROM offers o JOIN latest l ON l.offer_id = o.id WHERE o.active AND l.price > 0)"
_BAND = "CASE WHEN nights < 0 THEN NULL WHEN nights <= 5 THEN '0-5' WHEN nights <= 8 THEN '6-8' WHEN nights <= 12 THEN '9-12' WHEN nights >= 13 THEN '13+' END"
_PN = f"{_PRICED}, pn AS (SELECT *, CAST(floor(price / nights + 0.5) AS INTEGER) AS pn, {_BAND} AS band, strftime(departure_date, '%Y-%m') AS month, coalesce(match_key, 'id:' || id) AS twins FROM priced WHERE nights >= 1)"
_NAME = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(title)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('hotel', 'resort', 'spa', 'aparthotel', 'apartments', 'wellness', 'and')), ' ')"


def _bucket_sql(name: str, keys: list[str], where: str, least: int) -> str:
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""{name}_pool AS (SELECT s.id, p.twins, min(p.pn) AS v FROM pn s LEFT JOIN pn p ON {same} AND p.twins <> s.twins WHERE {where} GROUP BY ALL),
{name} AS (SELECT id, count(v) AS peers, CASE WHEN count(v) >= {least} THEN median(v) END AS median FROM {name}_pool GROUP BY id)"""


_MARKET = _bucket_sql("market", ["country", "board", "stars", "band", "month"], "TRUE", 8)
_LOCALITY = _bucket_sql("locality", ["locality", "board", "stars", "month"], "s.locality IS NOT NULL", 8)
_HOTEL = """hotel_pool AS (
  SELECT s.id, p.twins, min(p.pn) AS v FROM pn s JOIN pn p ON s.hotel_key = p.hotel_key AND s.board IS NOT DISTINCT FROM p.board AND p.twins <> s.twins AND abs(date_diff('day', s.departure_date, p.departure_date)) <= 30 AND abs(s.nights - p.nights) <= 2
  GROUP BY ALL),
hotel AS (SELECT id, count(v) AS peers, CASE WHEN count(v) >= 4 THEN median(v) END AS median FROM hotel_pool GROUP BY id)"""
_OWN = """recent AS (
  SELECT * FROM price_snapshots WHERE captured_at >= TIMESTAMPTZ '2026-05-16 00:00:00+00' - INTERVAL 30 DAYS AND captured_at < TIMESTAMPTZ '2026-05-16 00:00:00+00'
    AND CAST(captured_at AT TIME ZONE 'Europe/Prague' AS DATE) <> DATE '2026-05-16'),
own AS (
  SELECT offer_id, count(*) AS n, CASE WHEN count(*) >= 3 AND epoch_us(max(captured_at)) - epoch_us(min(captured_at)) >= 432000000000 THEN median(price_per_person) END AS baseline
  FROM recent GROUP BY offer_id)"""

# Each offer's first rung, from the survey: totals first, then what is per night, which needs a night at least.
_LADDER = f"""{_PN}, {_MARKET}, {_LOCALITY}, {_HOTEL}, {_OWN},
newest AS (SELECT offer_id, omnibus_lowest_price AS omnibus, claimed_discount_pct AS claimed FROM price_snapshots QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) = 1),
rungs AS (
  SELECT id, 1 AS place, 'own' AS reference, 1 AS times, baseline AS base, price AS now FROM priced JOIN own ON own.offer_id = priced.id
  UNION ALL SELECT id, 2, 'omnibus', 1, omnibus, price FROM priced JOIN newest ON newest.offer_id = priced.id
  UNION ALL SELECT id, 3, 'hotel', nights, median, pn FROM pn JOIN hotel USING (id)
  UNION ALL SELECT id, 4, 'locality', nights, median, pn FROM pn JOIN locality USING (id)
  UNION ALL SELECT id, 5, 'market', nights, median, pn FROM pn JOIN market USING (id)),
first_rung AS (SELECT * FROM rungs WHERE base > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1),
ladder AS (
  SELECT priced.id, reference, CAST(floor(base * times + 0.5) AS BIGINT) AS baseline, CAST(floor((base - now) / base * 100 + 0.5) AS BIGINT) AS real_pct, claimed
  FROM priced LEFT JOIN first_rung ON first_rung.id = priced.id JOIN newest ON newest.offer_id = priced.id)"""
_SHOWN = """shown AS (SELECT *, coalesce(match_key, 'id:' || id) AS twins FROM priced WHERE (country IS NULL OR country NOT IN ('Egypt', 'Malta')) AND (departure_date IS NULL OR departure_date >= DATE '2026-05-16')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY twins ORDER BY price, id) AS rn, min(id) OVER (PARTITION BY twins) AS first_id FROM shown)"""

ORACLE = {
    "identity_keys": "SELECT id, match_key, hotel_key FROM offers",
    "normal_names": f"""
SELECT id, strip_accents(lower(title)) AS stripped, {_NAME} AS name,
       CASE WHEN regexp_matches(trim(departure_airport), '^[a-zA-Z]{{3}}$') THEN upper(trim(departure_airport))
            ELSE CASE strip_accents(lower(trim(departure_airport))) WHEN 'praha' THEN 'PRG' WHEN 'brno' THEN 'BRQ' WHEN 'ostrava' THEN 'OSR' WHEN 'pardubice' THEN 'PED' WHEN 'viden' THEN 'VIE' WHEN 'bratislava' THEN 'BTS'
                 WHEN 'budapest' THEN 'BUD' WHEN 'katovice' THEN 'KTW' WHEN 'krakov' THEN 'KRK' WHEN 'wroclaw' THEN 'WRO' END END AS airport,
       regexp_matches(title, '^Hotel\\s+\\d+$') AS placeholder, {_BAND} AS band, strftime(departure_date, '%Y-%m') AS month
FROM offers""",
    "raw_labels": f"""
WITH texts AS (
  SELECT 'alexandria_packages' AS record_kind, raw_id, board_name AS b, transport_name AS t, country_name AS c FROM alexandria_packages
  UNION ALL SELECT 'datour_packages', raw_id, board_name, transport_name, country_name FROM datour_packages
  UNION ALL SELECT 'zajezdy_departures', raw_id, strava, NULL, country_name FROM zajezdy_departures),
raw AS (SELECT record_kind, raw_id, coalesce(b, '') AS bn, strip_accents(lower(b)) AS b, coalesce(t, '') AS tn, strip_accents(lower(t)) AS t, nullif(trim(regexp_split_to_array(c, '[/,–-]')[1]), '') AS c FROM texts),
named(key, country) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ({N._plain(c): c for c in N.COUNTRIES} | N.COUNTRY_ALIASES).items())})
SELECT record_kind, raw_id,
       CASE WHEN bn = '' THEN 'unknown' WHEN contains(b, 'all') AND contains(b, 'inclusive') THEN 'AI' WHEN contains(b, 'plna penze') OR b = 'fb' THEN 'FB' WHEN contains(b, 'polopenze') OR b = 'hb' THEN 'HB'
            WHEN contains(b, 'snidan') OR b = 'bb' THEN 'BB' WHEN contains(b, 'bez strav') THEN 'none' ELSE 'unknown' END AS board,
       CASE WHEN tn = '' THEN 'unknown' WHEN contains(t, 'letec') OR contains(t, 'flight') THEN 'flight' WHEN contains(t, 'vlastni') OR contains(t, 'own') THEN 'own' WHEN contains(t, 'bus') THEN 'bus' ELSE 'unknown' END AS transport,
       coalesce(named.country, c) AS country, named.country IS NOT NULL AS known
FROM raw LEFT JOIN named ON named.key = strip_accents(lower(c))""",
    "raw_dates": r"""
WITH texts AS (
  SELECT 'alexandria_packages' AS record_kind, raw_id, package_price AS m, start AS w FROM alexandria_packages
  UNION ALL SELECT 'datour_packages', raw_id, unit_price, start FROM datour_packages
  UNION ALL SELECT 'invia_terms', raw_id, NULL, check_in_date FROM invia_terms
  UNION ALL SELECT 'zajezdy_departures', raw_id, CAST(po_sleve AS VARCHAR), odjezd_prijezd FROM zajezdy_departures)
SELECT record_kind, raw_id, CASE WHEN TRY_CAST(nullif(c, '') AS INTEGER) > 0 THEN TRY_CAST(nullif(c, '') AS INTEGER) END AS czk,
       CASE WHEN iso <> '' THEN iso WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS day
FROM (SELECT record_kind, raw_id, regexp_extract(regexp_replace(m, '[\s\x{a0}\x{2009}\x{202f}]', '', 'g'), '(\d{3,})', 1) AS c, regexp_extract(w, '\d{4}-\d{2}-\d{2}') AS iso,
             regexp_extract(w, '(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})', 1) AS d, regexp_extract(w, '(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})', 2) AS m,
             regexp_extract(w, '(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})', 3) AS y FROM texts)""",
    "latest_price": "SELECT offer_id, arg_max(price_per_person, id) AS price_per_person, arg_max(captured_at, id) AS captured_at FROM price_snapshots GROUP BY offer_id",
    "own_baseline": f"WITH {_OWN} SELECT * FROM own",
    "sparkline": """
SELECT offer_id, string_agg(CAST(price_per_person AS VARCHAR), ',' ORDER BY id) AS points
FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) AS rn FROM price_snapshots WHERE captured_at >= TIMESTAMPTZ '2026-05-16 00:00:00+00' - INTERVAL 30 DAYS) WHERE rn <= 14 GROUP BY offer_id""",
    "price_moves": "SELECT * FROM (SELECT offer_id, id, price_per_person, lag(price_per_person) OVER (PARTITION BY offer_id ORDER BY id) AS previous FROM price_snapshots) WHERE previous <> price_per_person",
    "representatives": f"""
WITH {_PRICED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(match_key, 'id:' || id) ORDER BY price, id) AS rn, coalesce(match_key, 'id:' || id) AS twins FROM priced)
SELECT max(id) FILTER (rn = 1) AS id, max(price) FILTER (rn = 1) AS price, max(source) FILTER (rn = 1) AS source, coalesce(string_agg(source || ':' || price, ',' ORDER BY rn) FILTER (rn BETWEEN 2 AND 4), '') AS alternatives
FROM ranked GROUP BY twins""",
    "market_median": f"WITH {_PN}, {_MARKET} SELECT * FROM market",
    "locality_median": f"WITH {_PN}, {_LOCALITY} SELECT * FROM locality",
    "hotel_median": f"WITH {_PN}, {_HOTEL} SELECT * FROM hotel",
    "reference_ladder": f"WITH {_LADDER} SELECT id, reference, baseline, real_pct FROM ladder",
    "fake_claims": f"WITH {_LADDER} SELECT id, claimed AS claimed_discount_pct, real_pct, coalesce(claimed - real_pct >= 15, FALSE) AS fake FROM ladder",
    "board": f"""
WITH {_LADDER}, {_SHOWN},
spark AS (
  SELECT offer_id, string_agg(CAST(price_per_person AS VARCHAR), ',' ORDER BY id) AS points
  FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) AS rn FROM price_snapshots WHERE captured_at >= TIMESTAMPTZ '2026-05-16 00:00:00+00' - INTERVAL 30 DAYS) WHERE rn <= 14 GROUP BY offer_id),
dearer AS (SELECT twins, string_agg(source || ':' || price, ',' ORDER BY rn) AS others FROM ranked WHERE rn BETWEEN 2 AND 4 GROUP BY twins)
SELECT row_number() OVER (ORDER BY real_pct DESC, first_id) AS place, r.id, price, source, reference, baseline, real_pct, coalesce(claimed - real_pct >= 15, FALSE) AS fake, coalesce(others, '') AS alternatives, coalesce(points, '') AS points
FROM ranked r JOIN ladder l ON l.id = r.id LEFT JOIN spark ON spark.offer_id = r.id LEFT JOIN dearer USING (twins) WHERE rn = 1 AND country = 'Řecko' AND real_pct >= 0""",
    "digest": f"""
WITH {_LADDER}, {_SHOWN}, tops AS (SELECT row_number() OVER (ORDER BY real_pct DESC NULLS LAST, match_key IS NOT NULL, first_id) AS place, r.id, price, reference, baseline, real_pct FROM ranked r JOIN ladder l ON l.id = r.id WHERE rn = 1)
SELECT * FROM tops WHERE place <= 10""",
    "stats": f"""
WITH {_PRICED}, open AS (SELECT * FROM priced WHERE (country IS NULL OR country NOT IN ('Egypt', 'Malta')) AND (departure_date IS NULL OR departure_date >= DATE '2026-05-16'))
SELECT 'active' AS name, CAST(count(*) AS DOUBLE) AS value FROM offers WHERE active AND (country IS NULL OR country NOT IN ('Egypt', 'Malta')) AND (departure_date IS NULL OR departure_date >= DATE '2026-05-16')
UNION ALL SELECT 'new in 24 hours', CAST(count(*) AS DOUBLE) FROM offers WHERE first_seen_at >= TIMESTAMPTZ '2026-05-15 00:00:00+00' AND (country IS NULL OR country NOT IN ('Egypt', 'Malta'))
UNION ALL SELECT 'median of sea', median(price) FROM open WHERE country IN ('Řecko', 'Turecko', 'Kypr') AND board IN ('AI', 'HB') AND month(departure_date) IN (6, 7, 8) AND transport = 'flight'
UNION ALL SELECT 'median of soon', median(price) FROM open WHERE departure_date - DATE '2026-05-16' BETWEEN 0 AND 14
UNION ALL SELECT 'median of cheap', median(price) FROM open WHERE price <= 9000
UNION ALL SELECT 'median of nowhere', NULL""",
    "facet_counts": " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM offers WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("country", "departure_airport", "source", "board")),
    "first_fetched": "SELECT term_id, fetched_at, raw_id, check_in_date FROM invia_terms QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY fetched_at, raw_id) = 1",
    "failure_streaks": """
WITH r AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events)
SELECT user_id, count(*) FILTER (failed AND i IN (0, 1, 2)) = 3 AND count(*) FILTER (failed AND i = 3) = 0 AS alert FROM r WHERE i < 20 GROUP BY user_id""",
    "visible_offers": "SELECT id, country, departure_date FROM offers WHERE (country IS NULL OR country NOT IN ('Egypt', 'Malta')) AND (departure_date IS NULL OR departure_date >= DATE '2026-05-16')",
    "criteria_medians": f"""
WITH {_PRICED}, open AS (SELECT * FROM priced WHERE departure_date IS NULL OR departure_date >= DATE '2026-05-16'),
met AS (
  SELECT 'sea' AS name, price FROM open WHERE country IN ('Řecko', 'Turecko', 'Kypr') AND board IN ('AI', 'HB') AND month(departure_date) IN (6, 7, 8) AND transport = 'flight'
  UNION ALL SELECT 'soon', price FROM open WHERE departure_date - DATE '2026-05-16' BETWEEN 0 AND 14
  UNION ALL SELECT 'cheap', price FROM open WHERE price <= 9000)
SELECT name, count(*) AS offers, median(price) AS median FROM met GROUP BY name""",
    "history_stats": """
SELECT offer_id, min(captured_at) AS first_at, max(captured_at) AS last_at, min(price_per_person) AS least, max(price_per_person) AS most, arg_max(price_per_person, id) AS last_price,
       median(price_per_person) FILTER (captured_at >= TIMESTAMPTZ '2026-05-16 00:00:00+00' - INTERVAL 30 DAYS) AS median,
       date_diff('day', CAST(min(captured_at) AT TIME ZONE 'Europe/Prague' AS DATE), CAST(max(captured_at) AT TIME ZONE 'Europe/Prague' AS DATE)) AS days_tracked
FROM price_snapshots GROUP BY offer_id""",
    "heartbeat_rows": """
WITH RECURSIVE ordered AS (SELECT offer_id, id, price_per_person, epoch_us(captured_at) AS t, row_number() OVER (PARTITION BY offer_id ORDER BY id) AS rn FROM price_snapshots),
fold AS (
  SELECT offer_id, rn, id, price_per_person, TRUE AS kept, t AS last_t, price_per_person AS last_p FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.offer_id, o.rn, o.id, o.price_per_person, o.price_per_person <> f.last_p OR o.t - f.last_t > 604800000000,
         CASE WHEN o.price_per_person <> f.last_p OR o.t - f.last_t > 604800000000 THEN o.t ELSE f.last_t END, CASE WHEN o.price_per_person <> f.last_p OR o.t - f.last_t > 604800000000 THEN o.price_per_person ELSE f.last_p END
  FROM fold f JOIN ordered o ON o.offer_id = f.offer_id AND o.rn = f.rn + 1)
SELECT offer_id, price_per_person, id FROM fold WHERE kept""",
}
