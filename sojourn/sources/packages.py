"""Package feeds to normalized offers: two JSON shapes, one declaration each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import normalize as N
from sojourn.operators.history import cheapest_wins, first_wins
from sojourn.sources.payloads import json_records

_FIELDS = (
    "item_id string, tour_id string, tour_name string, detail string, country_name string, destination_name string, state_name string, accommodation_category double, "
    "board_name string, board_id string, transport_name string, start string, nights int, persons int, package_price double, unit_price double, original_price double, package_discount double, provider_name string"
)


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _offers(rows: DataFrame, source: str, price: Column, total: Column, original: Column, claimed: Column, key: Column, operator: Column, base: str) -> DataFrame:
    stars = N.half_up(F.col("accommodation_category"))
    return rows.select(
        F.lit(source).alias("source"), key.alias("source_offer_key"), _text("tour_name").alias("title"), N.known_country(F.col("country_name")).alias("country"),
        F.coalesce(_text("destination_name"), _text("state_name")).alias("locality"), F.when(stars > 0, stars.cast("double")).alias("stars"),
        N.board(F.col("board_name")).alias("board"), N.transport(F.col("transport_name")).alias("transport"), F.lit(None).cast("string").alias("departure_airport"),
        F.try_to_date(F.substring(_text("start"), 1, 10), "yyyy-MM-dd").alias("departure_date"), F.col("nights"), N.half_up(price).cast("int").alias("price_per_person"),
        N.half_up(total).cast("int").alias("price_total"), N.half_up(original).cast("int").alias("claimed_original_price"), claimed.cast("double").alias("claimed_discount_pct"),
        F.lit(None).cast("int").alias("omnibus_lowest_price"), operator.alias("tour_operator"), F.coalesce(F.concat(F.lit(f"{base}/"), _text("detail")), F.lit(base)).alias("url"), "ordinal",
    )


def party_packages(df: DataFrame, body: str, source: str, base: str) -> DataFrame:
    """Packages priced for a party. Rows without price, start or title are left out; the first of a key stays."""
    rows = json_records(df.select(body), body, "packages", _FIELDS).filter((F.col("package_price") > 0) & _text("start").isNotNull() & _text("tour_name").isNotNull())
    heads = F.greatest(F.coalesce("persons", F.lit(1)), F.lit(1))
    pct = N.half_up((F.col("original_price") - F.col("package_price")) / F.col("original_price") * 100)
    honest = (F.col("original_price") > F.col("package_price")) & (pct > 0) & (pct < 100)
    key = N.key_hash(F.col("tour_id"), _text("start"), F.col("nights"), F.col("board_id"))
    offers = _offers(rows, source, F.col("package_price") / heads, F.col("package_price"), F.when(honest, F.col("original_price") / heads), F.when(honest, pct), key, F.lit(None).cast("string"), base)
    return first_wins(offers, "source_offer_key", ["ordinal"]).drop("ordinal")


def person_packages(df: DataFrame, body: str, source: str, base: str) -> DataFrame:
    """Packages priced per person. Variants of one term and board are one offer, the cheapest."""
    rows = json_records(df.select(body), body, "packages", _FIELDS).filter((F.col("unit_price") > 0) & _text("start").isNotNull() & _text("tour_name").isNotNull())
    price = N.half_up(F.col("unit_price"))
    original = F.when(N.half_up(F.col("original_price")) > price, F.col("original_price"))
    discount = F.when((F.col("package_discount") > 0) & (F.col("package_discount") < 100), N.half_up(F.col("package_discount")))
    key = F.when(_text("tour_id").isNotNull(), N.key_hash(F.col("tour_id"), _text("start"), F.col("nights"), F.col("board_id"))).otherwise(N.key_hash(F.col("item_id")))
    offers = _offers(rows, source, F.col("unit_price"), F.when(F.col("package_price") > 0, F.col("package_price")), original, discount, key, _text("provider_name"), base)
    return cheapest_wins(offers, "source_offer_key", "price_per_person", "ordinal").drop("ordinal")
