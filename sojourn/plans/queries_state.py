"""Queries of the operators that keep and show state: upsert, misses, logs of what was told, views, runs and history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sojourn.functions import labels as L
from sojourn.functions import normalize as N
from sojourn.operators import criteria as C
from sojourn.operators import history as H
from sojourn.operators import ingest as I
from sojourn.operators.view import View
from sojourn.plans.queries_reference import _LADDER, NOW, _ladder, _offers, _priced, _prices
from sojourn.session import cut, table

#: A day in the past: what was known until then is the state, what was seen since then comes in.
THEN = dt.datetime(2026, 4, 1, tzinfo=dt.timezone.utc)
#: The end of the stand-in for a run log.
RUNS_NOW = dt.datetime(2024, 1, 31)
_VIEW = View(countries=("Řecko", "Turecko", "Itálie"), bands=("6-8", "9-12"), airports=("prg", "BRQ"), own=True, most=40000, first="2026-06-01", last="2026-09-30", sort="price")


def upserted_offers(spark: SparkSession, d: str) -> DataFrame:
    """The offers as of April after those seen since then came in."""
    offers = _offers(spark, d)
    incoming = offers.filter(F.col("last_seen_at") >= F.lit(THEN)).withColumn("ordinal", F.col("id")).drop("id")
    out = I.upsert(offers.filter(F.col("first_seen_at") < F.lit(THEN)), incoming, F.lit(NOW))
    return out.select("id", "source", "source_offer_key", "title", "departure_date", "first_seen_at", "last_seen_at", "active", "misses", "match_key", "hotel_key")


def missed_offers(spark: SparkSession, d: str) -> DataFrame:
    """invia's offers after a scan that saw those of the last ten days."""
    offers = _offers(spark, d)
    seen = offers.filter((F.col("source") == "invia") & (F.col("last_seen_at") >= F.lit(NOW) - F.expr("INTERVAL 10 DAYS")))
    return I.mark_missed(offers, seen, "invia").select("id", "active", "misses")


def due_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """M3: offers whose latest price history gets, against what was last written before April."""
    now = H.latest(_prices(spark, d), "offer_id", "id", ["price_per_person", "captured_at"])
    before = H.latest(_prices(spark, d).filter(F.col("captured_at") < F.lit(THEN)), "offer_id", "id", ["price_per_person", "captured_at"])
    return I.due_snapshots(now, before, "offer_id", "price_per_person", "captured_at", F.lit(THEN)).select("offer_id", "price_per_person")


def told_again(spark: SparkSession, d: str) -> DataFrame:
    """Latest prices that a log of the first days of May (one row per price then seen) doesn't hold back."""
    last = H.latest(_prices(spark, d), "offer_id", "id", ["price_per_person"]).select(F.col("offer_id").alias("key"), F.lit("drop").alias("type"), F.col("price_per_person").alias("price"))
    may = _prices(spark, d).filter(F.col("captured_at").between(F.lit(dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)), F.lit(dt.datetime(2026, 5, 12, tzinfo=dt.timezone.utc))))
    log = may.select(F.col("offer_id").alias("key"), F.lit("drop").alias("type"), F.col("price_per_person").alias("price"), F.col("captured_at").alias("at"), "id")
    return C.not_yet_told(last, log, F.lit(NOW), ("new",), 5.0, 7)


def view_offers(spark: SparkSession, d: str) -> DataFrame:
    """A view of priced offers, through its URL form and back."""
    view = View.from_query(_VIEW.to_query())
    return view.apply(_priced(spark, d)).select("id", "price", "country", "nights", "departure_airport", "transport", "departure_date")


def cheapest_packages(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest record of each tour at the place of its first; records without an amount don't count."""
    raw = table(spark, d, "datour_packages").withColumn("price", N.czk(F.col("unit_price"))).filter("price is not null and tour_id is not null")
    return H.cheapest_wins(raw.select("tour_id", "price", "raw_id", "start"), "tour_id", "price", "raw_id").select("tour_id", "price", "raw_id")


def offer_history(spark: SparkSession, d: str) -> DataFrame:
    """Last claimed original price, and the last move: latest price less the one before (null for a single row)."""
    last = H.latest(_prices(spark, d), "offer_id", "id", ["claimed_original_price"])
    two = H.last_points(_prices(spark, d), "offer_id", "id", "price_per_person", 2)
    move = F.when(F.size("points") == 2, F.get("points", F.lit(1)) - F.get("points", F.lit(0)))
    return last.join(two, "offer_id").select("offer_id", "claimed_original_price", move.alias("last_move"))


def facet_places(spark: SparkSession, d: str) -> DataFrame:
    """Facet values in the order of a list: most first, then by the Czech alphabet."""
    counts = H.facets(_offers(spark, d), ["country", "source", "board"])
    # A facet has as many rows as a list shows, whatever the table's size.
    w = Window.partitionBy("facet").orderBy(F.desc("n"), F.collate("value", "cs"), "value")
    return counts.withColumn("place", F.row_number().over(w))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.when(failed, "failed").otherwise("ok").alias("status"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(failed, "BLOCKED").when(F.col("event_type") == "view", "BACKOFF").alias("error_sample"),
    )


def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Newest run of each source and until when it backs off; events stand in for runs."""
    return C.run_status(_runs(spark, d), F.lit(RUNS_NOW)).withColumn("source", F.col("source").cast("long"))


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """Of the last 1000 runs, by status how many and the latest."""
    last = _runs(spark, d).orderBy(F.desc("id")).limit(1000)
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("latest"))


def label_terms(spark: SparkSession, d: str) -> DataFrame:
    """Departure and nights of labels without years."""
    raw = table(spark, d, "zajezdy_departures")
    day, nights = N.trip_of_label(F.col("odjezd_prijezd"), F.lit(NOW))
    return raw.select("raw_id", day.alias("departure"), nights.alias("nights"))


def compact_terms(spark: SparkSession, d: str) -> DataFrame:
    """Days written as yyyyMMdd, and nights as their distance, else days less one."""
    raw = table(spark, d, "invia_terms")
    return raw.select("raw_id", N.compact_date(F.col("check_in_date")).alias("day"), N.nights_between(F.col("check_in_date"), F.col("check_out_date"), F.col("days_count")).alias("nights"))


def offer_labels(spark: SparkSession, d: str) -> DataFrame:
    """What people read of an offer and its discount."""
    priced = cut(_priced(spark, d, "omnibus_lowest_price"))
    rows = priced.join(_ladder(spark, d, priced), "id")
    pct, o = F.col("real_pct"), F.col
    return rows.select(
        "id", N.grouped_thousands(o("price")).alias("price"), L.saving(pct, True).alias("in_message"), L.saving(pct, False).alias("on_page"), L.tone(pct).alias("tone"),
        L.reference_label(o("reference"), o("locality"), o("country")).alias("against"), L.term_range(o("departure_date"), o("nights"), F.lit(NOW)).alias("term"), L.nights_label(o("nights")).alias("nights"),
        L.board_label(o("board")).alias("board"), L.departure_label(o("departure_airport"), o("transport")).alias("departure"),
    )


QUERIES = {f.__name__: f for f in (upserted_offers, missed_offers, due_snapshots, told_again, view_offers, cheapest_packages, offer_history, facet_places, run_states, last_runs, label_terms, compact_terms, offer_labels)}

_LAST = "latest AS (SELECT offer_id, arg_max(price_per_person, id) AS price FROM price_snapshots GROUP BY offer_id)"
_RUNS = "runs AS (SELECT event_id AS id, user_id AS source, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, ts AS started_at, event_type FROM events)"

ORACLE = {
    "upserted_offers": """
WITH old AS (SELECT * FROM offers WHERE first_seen_at < TIMESTAMPTZ '2026-04-01 00:00:00+00'),
came AS (SELECT * FROM offers WHERE last_seen_at >= TIMESTAMPTZ '2026-04-01 00:00:00+00'),
stale AS (SELECT *, departure_date < DATE '2026-05-16' AS gone FROM came)
SELECT o.id, o.source, o.source_offer_key, o.title, CASE WHEN c.id IS NULL OR NOT c.gone THEN o.departure_date END AS departure_date, o.first_seen_at,
       CASE WHEN c.id IS NULL THEN o.last_seen_at ELSE TIMESTAMPTZ '2026-05-16 00:00:00+00' END AS last_seen_at, o.active OR c.id IS NOT NULL AS active,
       CASE WHEN c.id IS NULL THEN o.misses ELSE 0 END AS misses, CASE WHEN c.id IS NULL OR NOT coalesce(c.gone, FALSE) THEN o.match_key END AS match_key, o.hotel_key
FROM old o LEFT JOIN stale c ON c.id = o.id
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY c.id), c.source, c.source_offer_key, c.title, CASE WHEN NOT c.gone THEN c.departure_date END, TIMESTAMPTZ '2026-05-16 00:00:00+00',
       TIMESTAMPTZ '2026-05-16 00:00:00+00', TRUE, 0, CASE WHEN NOT c.gone THEN c.match_key END, c.hotel_key
FROM stale c ANTI JOIN old o ON o.id = c.id""",
    "missed_offers": """
SELECT id, active AND NOT (gone AND misses + 1 >= 2) AS active, misses + CASE WHEN gone THEN 1 ELSE 0 END AS misses
FROM (SELECT *, source = 'invia' AND source_offer_key NOT IN (SELECT source_offer_key FROM offers WHERE source = 'invia' AND last_seen_at >= TIMESTAMPTZ '2026-05-06 00:00:00+00') AS gone FROM offers)""",
    "due_snapshots": f"""
WITH {_LAST}, before AS (SELECT offer_id, arg_max(price_per_person, id) AS price, arg_max(captured_at, id) AS at FROM price_snapshots WHERE captured_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' GROUP BY offer_id)
SELECT l.offer_id, l.price AS price_per_person FROM latest l LEFT JOIN before b USING (offer_id) WHERE b.offer_id IS NULL OR b.price <> l.price OR b.at + INTERVAL 7 DAY < TIMESTAMPTZ '2026-04-01 00:00:00+00'""",
    "told_again": f"""
WITH {_LAST}, sent AS (
  SELECT offer_id, price_per_person AS price, captured_at AS at FROM price_snapshots WHERE captured_at BETWEEN TIMESTAMPTZ '2026-05-01 00:00:00+00' AND TIMESTAMPTZ '2026-05-12 00:00:00+00'
  QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) = 1)
SELECT l.offer_id AS key, 'drop' AS type, l.price FROM latest l LEFT JOIN sent s USING (offer_id)
WHERE s.offer_id IS NULL OR l.price <= s.price * 0.95 OR s.at <= TIMESTAMPTZ '2026-05-09 00:00:00+00'""",
    "view_offers": f"""
WITH {_LAST}
SELECT o.id, l.price, country, nights, departure_airport, transport, departure_date FROM offers o JOIN latest l ON l.offer_id = o.id
WHERE active AND price > 0 AND price <= 40000 AND country IN ('Řecko', 'Turecko', 'Itálie') AND nights BETWEEN 6 AND 12 AND (upper(departure_airport) IN ('PRG', 'BRQ') OR transport = 'own')
  AND departure_date BETWEEN DATE '2026-06-01' AND DATE '2026-09-30'""",
    "cheapest_packages": r"""
WITH amounts AS (SELECT tour_id, raw_id, TRY_CAST(nullif(regexp_extract(regexp_replace(unit_price, '[\s\x{a0}\x{2007}\x{2009}\x{202f}]', '', 'g'), '(\d{3,})', 1), '') AS INTEGER) AS price FROM datour_packages WHERE tour_id IS NOT NULL)
SELECT tour_id, min(price) AS price, min(raw_id) AS raw_id FROM amounts WHERE price > 0 GROUP BY tour_id""",
    "offer_history": """
WITH r AS (SELECT *, lag(price_per_person) OVER (PARTITION BY offer_id ORDER BY id) AS before, row_number() OVER (PARTITION BY offer_id ORDER BY id DESC) AS rn FROM price_snapshots)
SELECT offer_id, claimed_original_price, price_per_person - before AS last_move FROM r WHERE rn = 1""",
    "facet_places": """
WITH counts AS (
  SELECT 'country' AS facet, country AS value, count(*) AS n FROM offers WHERE country IS NOT NULL GROUP BY country
  UNION ALL SELECT 'source', source, count(*) FROM offers GROUP BY source UNION ALL SELECT 'board', board, count(*) FROM offers GROUP BY board)
SELECT facet, value, n, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value COLLATE cs, value) AS INTEGER) AS place FROM counts""",
    "run_states": f"""
WITH {_RUNS}, recent AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS rn FROM runs),
newest AS (SELECT source, status, started_at FROM recent WHERE rn = 1),
deciding AS (SELECT source, event_type, started_at FROM recent WHERE rn <= 20 AND event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) = 1)
SELECT n.source, n.status, n.started_at, CASE WHEN d.event_type = 'error' AND d.started_at + INTERVAL 24 HOUR > TIMESTAMP '2024-01-31 00:00:00' THEN d.started_at + INTERVAL 24 HOUR END AS backoff_until
FROM newest n LEFT JOIN deciding d USING (source)""",
    "last_runs": f"WITH {_RUNS} SELECT status, count(*) AS runs, max(id) AS latest FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 1000) GROUP BY status",
    "label_terms": r"""
WITH days AS (SELECT raw_id, regexp_extract_all(odjezd_prijezd, '(\d{1,2})\.\s*(\d{1,2})\.', 1) AS ds, regexp_extract_all(odjezd_prijezd, '(\d{1,2})\.\s*(\d{1,2})\.', 2) AS ms FROM zajezdy_departures),
parts AS (SELECT raw_id, CAST(ds[1] AS INTEGER) AS d1, CAST(ms[1] AS INTEGER) AS m1, CAST(ds[2] AS INTEGER) AS d2, CAST(ms[2] AS INTEGER) AS m2 FROM days),
dated AS (
  SELECT raw_id, TRY_CAST(printf('%04d-%02d-%02d', 2026 + CASE WHEN m1 < 5 THEN 1 ELSE 0 END, m1, d1) AS DATE) AS a, TRY_CAST(printf('%04d-%02d-%02d', 2026 + CASE WHEN m1 < 5 THEN 1 ELSE 0 END + CASE WHEN m2 < m1 THEN 1 ELSE 0 END, m2, d2) AS DATE) AS b
  FROM parts WHERE d2 IS NOT NULL)
SELECT z.raw_id, a AS departure, CASE WHEN b > a THEN CAST(b - a AS INTEGER) END AS nights FROM zajezdy_departures z LEFT JOIN dated USING (raw_id)""",
    "compact_terms": r"""
WITH days AS (
  SELECT raw_id, days_count, CASE WHEN regexp_full_match(check_in_date, '\d{8}') THEN CAST(try_strptime(check_in_date, '%Y%m%d') AS DATE) END AS a, CASE WHEN regexp_full_match(check_out_date, '\d{8}') THEN CAST(try_strptime(check_out_date, '%Y%m%d') AS DATE) END AS b
  FROM invia_terms)
SELECT raw_id, a AS day, CASE WHEN coalesce(b - a, days_count - 1) > 0 THEN CAST(coalesce(b - a, days_count - 1) AS INTEGER) END AS nights FROM days""",
    "offer_labels": f"""
WITH {_LADDER}
SELECT p.id, replace(format('{{:,}}', p.price), ',', ' ') AS price, CASE WHEN real_pct >= 0 THEN '−' || real_pct || ' %' WHEN real_pct < 0 THEN '+' || -real_pct || ' %' END AS in_message,
       CASE WHEN real_pct > 0 THEN '−' || real_pct || ' %' WHEN real_pct <= 0 THEN '+' || -real_pct || ' %' END AS on_page,
       CASE WHEN real_pct IS NULL THEN 'none' WHEN real_pct <= 0 THEN 'up' WHEN real_pct >= 15 THEN 'good' ELSE 'mid' END AS tone,
       CASE reference WHEN 'own' THEN '30denní medián' WHEN 'omnibus' THEN 'Omnibus 30denní min.' WHEN 'hotel' THEN 'tento hotel' WHEN 'locality' THEN coalesce(locality, 'lokalita') WHEN 'market' THEN coalesce(country, 'trh') END AS against,
       CASE WHEN departure_date IS NULL THEN 'volný termín' ELSE strftime(departure_date, '%d.%m') || CASE WHEN nights IS NULL THEN '' ELSE ' – ' || strftime(departure_date + nights, '%d.%m') END || CASE WHEN year(departure_date) <> 2026 THEN ' ' || year(departure_date) ELSE '' END END AS term,
       CASE WHEN nights IS NULL THEN '' WHEN nights = 1 THEN '1 noc' WHEN nights BETWEEN 2 AND 4 THEN nights || ' noci' ELSE nights || ' nocí' END AS nights,
       CASE board WHEN 'AI' THEN 'All inclusive' WHEN 'UAI' THEN 'Ultra all inclusive' WHEN 'FB' THEN 'Plná penze' WHEN 'HB' THEN 'Polopenze' WHEN 'BB' THEN 'Snídaně' WHEN 'none' THEN 'Bez stravy' WHEN 'unknown' THEN '—' WHEN '' THEN '—' ELSE board END AS board,
       CASE WHEN trim(departure_airport) <> '' THEN upper(departure_airport) WHEN transport = 'own' THEN 'vlastní' WHEN transport = 'bus' THEN 'bus' ELSE '—' END AS departure
FROM priced p JOIN ladder l ON l.id = p.id""",
}
