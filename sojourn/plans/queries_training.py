"""Queries of the general training-data operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.operators.instants import iso_utc, to_instants
from sojourn.operators.rolling import rolling_totals
from sojourn.operators.snapshot_diff import snapshot_changes, validity_intervals
from sojourn.operators.units import nights_in, people_in, per_person_for_stay, to_common, totals_in_other_units
from sojourn.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each delivery against the one before."""
    events = snapshot_changes(table(spark, sf_dir, "offer_snapshots"))
    return events.select(F.col("snapshot_no").cast("int"), F.col("id").cast("long"), "change")


def p1_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals behind p1_found: per offer and content, the deliveries that carried it."""
    spans = validity_intervals(table(spark, sf_dir, "offer_snapshots"))
    return spans.select(F.col("key").alias("id"), "first_no", "after_no", (F.col("last_idx") - F.col("first_idx") + 1).cast("long").alias("deliveries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant of each departure text of the three raw tables."""
    columns = {"invia_terms": "check_in_date", "zajezdy_departures": "odjezd_prijezd", "datour_packages": "start"}
    raw = [table(spark, sf_dir, name).select(F.lit(name).alias("record_kind"), F.col("raw_id").cast("long"), "fetched_at", F.col(c).alias("written")) for name, c in columns.items()]
    found = to_instants(raw[0].unionByName(raw[1]).unionByName(raw[2]), "written", "fetched_at")
    return found.filter("instant is not null").select("record_kind", "raw_id", iso_utc(F.col("instant")).alias("instant_utc"))


def p4_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7 and 30 days per offer and Prague day."""
    return rolling_totals(table(spark, sf_dir, "price_snapshots"), "offer_id", "captured_at", "price_per_person", same=["offer_id", "captured_at", "price_per_person", "price_total", "claimed_original_price", "claimed_discount_pct", "omnibus_lowest_price"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of three tables in whole CZK."""
    rates = table(spark, sf_dir, "fx_rates")
    alexandria = to_common(table(spark, sf_dir, "alexandria_packages").select("raw_id", "package_price", "persons", "nights"), "package_price", rates, "kč")
    a = alexandria.select(F.lit("alexandria_packages").alias("record_kind"), F.col("raw_id").alias("record_id"), per_person_for_stay(F.col("amount"), F.col("package_price"), people_in(F.col("persons")), F.col("nights"), False).alias("amount_czk"))
    datour = to_common(table(spark, sf_dir, "datour_packages").select("raw_id", "unit_price", "nights"), "unit_price", rates, "kč")
    d = datour.select(F.lit("datour_packages").alias("record_kind"), F.col("raw_id").alias("record_id"), per_person_for_stay(F.col("amount"), F.col("unit_price"), F.lit(None).cast("int"), nights_in(F.col("nights")), True).alias("amount_czk"))
    prices = totals_in_other_units(table(spark, sf_dir, "price_snapshots").select("id", "price_total", "price_per_person"), "price_total", "price_per_person", rates)
    p = prices.select(F.lit("price_snapshots").alias("record_kind"), F.col("id").alias("record_id"), F.col("amount").alias("amount_czk"))
    return a.unionByName(d).filter("amount_czk is not null").unionByName(p)


QUERIES = {"p1_found": p1_found, "p1_validity": p1_validity, "p3_found": p3_found, "p4_rolling_totals": p4_rolling_totals, "p6_found": p6_found}

_NORMAL = r"regexp_replace(nfc_normalize({c}), '[\s\x{{a0}}]+', '', 'g')"
_TEXTS = [_NORMAL.format(c=c) + f" AS {c}" for c in ("title", "country", "locality", "board", "tour_operator", "source", "source_offer_key")]
_STATE = f"""
deliveries AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM offer_snapshots)),
latest AS (SELECT * FROM offer_snapshots QUALIFY row_number() OVER (PARTITION BY id, snapshot_no ORDER BY delivered_at DESC) = 1),
state AS (SELECT id, snapshot_no, {', '.join(_TEXTS)}, stars, departure_date, nights, first_seen_at, active, misses FROM latest)
"""
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("title", "country", "locality", "board", "tour_operator", "source", "source_offer_key", "stars", "departure_date", "nights", "first_seen_at", "active", "misses"))

ORACLE = {
    "p1_found": f"""
WITH {_STATE}
SELECT d.next_no AS snapshot_no, coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT s.*, d.next_no FROM state s JOIN deliveries d USING (snapshot_no) WHERE d.next_no IS NOT NULL) a
FULL JOIN (SELECT s.*, d.snapshot_no AS prev_no FROM state s JOIN deliveries d ON d.next_no = s.snapshot_no) b ON a.id = b.id AND a.snapshot_no = b.prev_no
JOIN deliveries d ON d.snapshot_no = coalesce(a.snapshot_no, b.prev_no)
WHERE a.id IS NULL OR b.id IS NULL OR NOT ({_SAME})
""",
    "p1_validity": f"""
WITH {_STATE},
numbered AS (SELECT s.*, d.idx, d.next_no FROM state s JOIN (SELECT *, row_number() OVER (ORDER BY snapshot_no) AS idx FROM deliveries) d USING (snapshot_no)),
flagged AS (SELECT b.id, b.idx, b.snapshot_no, b.next_no, CASE WHEN a.id IS NULL OR NOT ({_SAME}) THEN 1 ELSE 0 END AS starts FROM numbered b LEFT JOIN numbered a ON a.id = b.id AND a.idx = b.idx - 1),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY idx) AS island FROM flagged),
spans AS (SELECT id, min(snapshot_no) AS first_no, max(idx) AS last_idx, count(*) AS deliveries FROM islands GROUP BY id, island)
SELECT id, first_no, d.next_no AS after_no, deliveries FROM spans JOIN (SELECT *, row_number() OVER (ORDER BY snapshot_no) AS idx FROM deliveries) d ON d.idx = last_idx
""",
    "p6_found": r"""
WITH units(alias, currency, factor) AS (VALUES ('kč', 'CZK', 1.0), ('czk', 'CZK', 1.0), ('tis. kč', 'CZK', 1000.0), ('hal.', 'CZK', 0.01), ('haléřů', 'CZK', 0.01), ('eur', 'EUR', 1.0), ('€', 'EUR', 1.0),
  ('usd', 'USD', 1.0), ('$', 'USD', 1.0), ('gbp', 'GBP', 1.0), ('£', 'GBP', 1.0), ('pln', 'PLN', 1.0), ('zł', 'PLN', 1.0), ('huf', 'HUF', 1.0), ('ft', 'HUF', 1.0)),
factors AS (SELECT alias, factor * czk / u.units AS f FROM (SELECT alias, currency, CAST(factor AS DOUBLE) AS factor FROM units) JOIN fx_rates u USING (currency)),
texts AS (
  SELECT 'alexandria_packages' AS kind, raw_id, package_price AS t, persons, nights AS stay FROM alexandria_packages
  UNION ALL
  SELECT 'datour_packages', raw_id, unit_price, NULL,
         CASE WHEN nights LIKE '%noc%' OR nights LIKE '%N' THEN TRY_CAST(regexp_extract(nights, '(\d+) ?(?:N|noc)', 1) AS INTEGER) WHEN nights LIKE '%týd%' THEN TRY_CAST(regexp_extract(nights, '\d+') AS INTEGER) * 7
              WHEN nights LIKE '%dn%' THEN TRY_CAST(regexp_extract(nights, '\d+') AS INTEGER) - 1 ELSE TRY_CAST(nights AS INTEGER) END
  FROM datour_packages),
tidy AS (SELECT *, trim(regexp_replace(lower(t), '[\s\x{a0}\x{2007}\x{2009}\x{202f}]+', ' ', 'g')) AS s FROM texts),
parts AS (
  SELECT *, replace(regexp_extract(s, '\d(?:[\d .,]*\d)?'), ' ', '') AS raw, coalesce(nullif(regexp_extract(regexp_replace(s, '\d(?:[\d .,]*\d)?', ' '), '(tis\. kč|haléřů|hal\.|kč|czk|eur|usd|gbp|pln|huf|zł|ft|€|\$|£)', 1), ''), 'kč') AS alias,
         TRY_CAST(regexp_extract(s, '(?:za|pro|\() ?(\d+) ?os', 1) AS INTEGER) AS party, regexp_matches(s, 'noc|night') AS nightly, contains(s, 'celkem') AS total, regexp_matches(s, '/ ?os|(za|na) osobu') AS per_head
  FROM tidy),
readable AS (
  SELECT *, TRY_CAST(CASE WHEN raw LIKE '%.%' AND raw LIKE '%,%' THEN CASE WHEN strpos(reverse(raw), ',') < strpos(reverse(raw), '.') THEN replace(replace(raw, '.', ''), ',', '.') ELSE replace(raw, ',', '') END
                         WHEN regexp_matches(raw, '^\d{1,3}([.,]\d{3})+$') THEN regexp_replace(raw, '[.,]', '', 'g') ELSE replace(raw, ',', '.') END AS DECIMAL(18, 4)) AS n,
         CAST(list_sum(list_transform(regexp_extract_all(persons, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))) AS INTEGER) AS figures,
         CASE WHEN persons LIKE 'jeden%' THEN 1 WHEN persons LIKE 'dva%' THEN 2 WHEN persons LIKE 'tři%' THEN 3 WHEN persons LIKE 'čtyři%' THEN 4 WHEN persons LIKE 'pět%' THEN 5 END + CASE WHEN persons LIKE '%a dítě' THEN 1 ELSE 0 END AS words
  FROM parts),
heads AS (SELECT *, CASE WHEN party IS NOT NULL THEN party WHEN per_head OR (nightly AND NOT total) THEN 1 WHEN kind = 'datour_packages' AND NOT total THEN 1 ELSE nullif(coalesce(figures, words), 0) END AS h, CASE WHEN nightly THEN stay ELSE 1 END AS times FROM readable),
amounts AS (SELECT kind, raw_id, CAST(floor(CAST(n AS DOUBLE) * f * times / h + 0.5 + 1e-7) AS BIGINT) AS amount_czk FROM heads JOIN factors USING (alias) WHERE n > 0 AND h > 0),
odd AS (
  SELECT id, price_total AS t, price_per_person AS p FROM price_snapshots WHERE price_total > 0 AND price_per_person > 0 AND NOT (price_total % price_per_person = 0 AND price_total // price_per_person <= 4)),
tried AS (
  SELECT id, k * p AS amount, abs(t - p * k / f) AS off FROM odd, (SELECT DISTINCT f FROM factors WHERE f <> 1) fs, (VALUES (1), (2), (3), (4)) ks(k))
SELECT kind AS record_kind, raw_id AS record_id, amount_czk FROM amounts WHERE amount_czk IS NOT NULL
UNION ALL SELECT 'price_snapshots', id, CAST(arg_min(amount, off) AS BIGINT) FROM tried WHERE off <= 0.500001 GROUP BY id
""",
    "p4_rolling_totals": """
WITH once AS (
  SELECT DISTINCT offer_id, captured_at, price_per_person, price_total, claimed_original_price, claimed_discount_pct, omnibus_lowest_price FROM price_snapshots),
daily AS (
  SELECT offer_id, CAST(captured_at AT TIME ZONE 'Europe/Prague' AS DATE) AS day,
         count(*) FILTER (price_per_person > 0) AS n, coalesce(sum(price_per_person) FILTER (price_per_person > 0), 0) AS total
  FROM once GROUP BY ALL),
calendar AS (SELECT offer_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY offer_id),
dense AS (SELECT c.offer_id, c.day, coalesce(d.n, 0) AS n, coalesce(d.total, 0) AS total FROM calendar c LEFT JOIN daily d ON d.offer_id = c.offer_id AND d.day = c.day),
sums AS (
  SELECT offer_id, day,
         CAST(sum(n) OVER w7 AS BIGINT) AS n_7, CAST(sum(total) OVER w7 AS BIGINT) AS sum_7, CAST(sum(n) OVER w30 AS BIGINT) AS n_30, CAST(sum(total) OVER w30 AS BIGINT) AS sum_30
  FROM dense
  WINDOW w7 AS (PARTITION BY offer_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY offer_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT offer_id, day, n_7, sum_7, CASE WHEN n_7 > 0 THEN sum_7 / n_7 END AS mean_7, n_30, sum_30, CASE WHEN n_30 > 0 THEN sum_30 / n_30 END AS mean_30 FROM sums
""",
}
