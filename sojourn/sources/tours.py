"""Tour and hotel listings in JSON to normalized offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions import normalize as N
from sojourn.operators.history import first_wins

_TOUR = (
    "detailUrl string, hotel struct<id: string, name: string, starsCount: double, breadcrumbs: struct<country: string, destination: string>>, "
    "tour struct<nightsCount: int, transportType: int, date: struct<from: string>, price: struct<adultPrice: double, total: double, discount: double, lowestPrice: double>, rooms: array<struct<meal: string>>>"
)
_HOTEL = (
    "hotelId string, title string, noStars double, priceInfo struct<regular: struct<amount: double>, group: struct<amount: double>>, destinations array<struct<name: string>>, "
    "additionalInfo struct<boarding: string, transport: struct<label: string>>"
)


def _records(df: DataFrame, body: str, path: str, fields: str) -> DataFrame:
    parsed = F.from_json(F.get_json_object(body, f"$.{path}"), f"array<struct<{_colons(fields)}>>")
    keep = [c for c in df.columns if c != body]
    return df.select(*keep, F.posexplode(parsed).alias("ordinal", "r")).select(*keep, "ordinal", "r.*")


def _colons(fields: str) -> str:
    """DDL of top-level fields with colons, as a struct's has them."""
    out, depth = [], 0
    for part in fields.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def tour_offers(df: DataFrame, body: str, source: str, base: str) -> DataFrame:
    """Offers of {tours: []}: a tour with its hotel, term and prices.

    Tours without hotel name, page or a positive price for an adult are left out; the first of a key stays. The discount
    is for all travellers: their number is the total over an adult's price, one at least. A claimed discount that isn't
    between 0 and 100 percent is none, and neither is its original price.
    """
    r = _records(df.select(body), body, "tours", _TOUR)
    adult, total, discount = F.col("tour.price.adultPrice"), F.col("tour.price.total"), F.col("tour.price.discount")
    r = r.filter((F.coalesce("hotel.name", F.lit("")) != "") & (F.coalesce("detailUrl", F.lit("")) != "") & (adult > 0))
    each = discount / F.greatest(F.lit(1), N.half_up(total / adult))
    original = N.half_up(adult + each)
    pct = N.half_up(each / original * 100)
    honest = (discount > 0) & (total > 0) & (pct > 0) & (pct < 100)
    day, nights = F.substring("tour.date.from", 1, 10), F.col("tour.nightsCount")
    path = F.regexp_replace("detailUrl", "^/+", "")
    offers = r.select(
        F.lit(source).alias("source"), N.key_hash(F.coalesce("hotel.id", "hotel.name"), day, nights).alias("source_offer_key"), F.col("hotel.name").alias("title"),
        N.country(F.col("hotel.breadcrumbs.country")).alias("country"), F.col("hotel.breadcrumbs.destination").alias("locality"), F.col("hotel.starsCount").alias("stars"),
        N.board(F.get("tour.rooms", F.lit(0))["meal"]).alias("board"), F.when(F.col("tour.transportType") == 1, "flight").otherwise("unknown").alias("transport"), F.lit(None).cast("string").alias("departure_airport"),
        F.try_to_date(day, "yyyy-MM-dd").alias("departure_date"), nights.alias("nights"), N.half_up(adult).cast("int").alias("price_per_person"), N.half_up(total).cast("int").alias("price_total"),
        F.when(honest, original).cast("int").alias("claimed_original_price"), F.when(honest, pct).cast("double").alias("claimed_discount_pct"), N.half_up(F.col("tour.price.lowestPrice")).cast("int").alias("omnibus_lowest_price"),
        F.lit(None).cast("string").alias("tour_operator"), F.when(F.col("detailUrl").rlike("^https?://"), F.col("detailUrl")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path)).alias("url"), "ordinal",
    )
    return first_wins(offers, "source_offer_key", ["ordinal"]).drop("ordinal")


def hotel_offers(df: DataFrame, body: str, source: str, url: str) -> DataFrame:
    """Offers of {hotels: []}: hotels without a term, by their cheapest price; ``url`` is the page that lists them.

    Hotels without id, title or positive price are left out; countries that aren't known are null; the first of an id
    stays. Day and nights are never known.
    """
    r = _records(df.select(body, F.col(url).alias("page")), body, "hotels", _HOTEL)
    each, total = F.col("priceInfo.regular.amount"), F.col("priceInfo.group.amount")
    r = r.filter(F.col("hotelId").isNotNull() & (F.trim(F.coalesce("title", F.lit(""))) != "") & (each > 0))
    none = lambda kind: F.lit(None).cast(kind)
    offers = r.select(
        F.lit(source).alias("source"), F.col("hotelId").alias("source_offer_key"), F.trim("title").alias("title"), N.known_country(F.get("destinations", F.lit(0))["name"]).alias("country"),
        F.nullif(F.trim(F.get("destinations", F.lit(1))["name"]), F.lit("")).alias("locality"), F.when(F.col("noStars") > 0, F.col("noStars")).alias("stars"), N.board(F.col("additionalInfo.boarding")).alias("board"),
        N.transport(F.col("additionalInfo.transport.label")).alias("transport"), none("string").alias("departure_airport"), none("date").alias("departure_date"), none("int").alias("nights"),
        N.half_up(each).cast("int").alias("price_per_person"), F.when(total > 0, N.half_up(total)).cast("int").alias("price_total"), none("int").alias("claimed_original_price"), none("double").alias("claimed_discount_pct"),
        none("int").alias("omnibus_lowest_price"), none("string").alias("tour_operator"), F.col("page").alias("url"), "ordinal",
    )
    return first_wins(offers, "source_offer_key", ["ordinal"]).drop("ordinal")
