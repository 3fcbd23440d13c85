"""Queries of the operators in this subpackage, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.languages import label_documents
from sojourn.llm.leakage import leaking_items
from sojourn.llm.matching import match_stays
from sojourn.llm.mixing import mix, mix_report
from sojourn.llm.percentiles import price_percentiles
from sojourn.llm.survivorship import best_offers
from sojourn.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of offers that are the same stay, believed at least as likely as not."""
    return p2_beliefs(spark, sf_dir).filter("belief >= 0.5").select("offer_id_a", "offer_id_b")


def p2_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of offers with their marginal match probability, and whether its messages came to rest."""
    found = match_stays(table(spark, sf_dir, "offers"))
    return found.select(F.col("id_a").cast("long").alias("offer_id_a"), F.col("id_b").cast("long").alias("offer_id_b"), "belief", "converged")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set of offers with a common match_key."""
    found = best_offers(table(spark, sf_dir, "offers"), table(spark, sf_dir, "price_snapshots"), table(spark, sf_dir, "source_registry"))
    return found.select("match_key", "source", F.col("price_per_person").cast("int"), "url")


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price percentiles by country, locality and nights."""
    return price_percentiles(table(spark, sf_dir, "price_snapshots"), table(spark, sf_dir, "offers"), ["country", "locality", "nights"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry passages of evaluation items."""
    return leaking_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: which documents, how often, and where; in 16 shards at least, which the tree deals at any size."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), least_shards=16)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix_report(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents whose label can't be trusted, and of the lines of mixed documents."""
    found = label_documents(table(spark, sf_dir, "documents"))
    return found.filter("line_no > 0 or labelled is null or labelled <> lang").select(F.col("doc_id").cast("long"), "line_no", "lang")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, and every line's of mixed ones, with confidence."""
    return label_documents(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "lang", "confidence")


QUERIES = {
    "p2_found": p2_found, "p2_beliefs": p2_beliefs, "p5_found": p5_found, "p7_percentiles": p7_percentiles, "p8_found": p8_found,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_languages": p10_languages,
}

ORACLE: dict[str, str] = {
    "p5_found": r"""
WITH members AS (
  SELECT o.*, coalesce(r.trust_rank, 2147483647) AS rank,
         regexp_matches(url, '^https?://[^/]+/(?:.*[?&](?:term|termin)=\d+|nabidka/\d+|[^?]*-z\d+/\d+|hotel/\d+-[a-z0-9]|detail\.php\?(?:[^#]*&)?id=\d+)') AND NOT regexp_matches(url, '^https?://[^/]+/404') AS page
  FROM offers o LEFT JOIN source_registry r USING (source) WHERE match_key IS NOT NULL),
sets AS (SELECT match_key FROM members GROUP BY match_key HAVING count(*) >= 2),
best AS (SELECT match_key, source FROM members QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY rank, source DESC) = 1),
price AS (
  SELECT match_key, price_per_person FROM members m JOIN price_snapshots s ON s.offer_id = m.id WHERE s.price_per_person > 0
  QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY captured_at DESC, s.id DESC) = 1),
page AS (SELECT match_key, url FROM members WHERE page QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY rank, last_seen_at DESC, url DESC) = 1)
SELECT match_key, best.source, price.price_per_person, page.url FROM sets JOIN best USING (match_key) LEFT JOIN price USING (match_key) LEFT JOIN page USING (match_key)
""",
    "p7_percentiles": """
WITH ranked AS (
  SELECT o.country, o.locality, o.nights, s.price_per_person AS v,
         row_number() OVER (PARTITION BY o.country, o.locality, o.nights ORDER BY s.price_per_person) AS r, count(*) OVER (PARTITION BY o.country, o.locality, o.nights) AS n
  FROM price_snapshots s JOIN offers o ON o.id = s.offer_id WHERE s.price_per_person > 0)
SELECT country, locality, nights, max(n) AS n, min(v) FILTER (r >= (n * 10 + 99) // 100) AS p10, min(v) FILTER (r >= (n * 50 + 99) // 100) AS p50,
       min(v) FILTER (r >= (n * 90 + 99) // 100) AS p90, min(v) FILTER (r >= (n * 99 + 99) // 100) AS p99
FROM ranked GROUP BY ALL
""",
}
