"""Feeds whose rows need other payloads: terms with country and hotel lookups, hotels of tours, names of hotels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import normalize as N
from sojourn.operators.history import first_wins
from sojourn.sources.payloads import detail_ids, json_records, sitemap_urls


def _offer(rows: DataFrame, given: dict[str, Column]) -> DataFrame:
    """The offer columns in order; those not given are null."""
    kinds = (
        ("source", "string"), ("source_offer_key", "string"), ("title", "string"), ("country", "string"), ("locality", "string"), ("stars", "double"), ("board", "string"), ("transport", "string"),
        ("departure_airport", "string"), ("departure_date", "date"), ("nights", "int"), ("price_per_person", "int"), ("price_total", "int"), ("claimed_original_price", "int"),
        ("claimed_discount_pct", "double"), ("omnibus_lowest_price", "int"), ("tour_operator", "string"), ("url", "string"),
    )
    offers = rows.select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds], "ordinal")
    return first_wins(offers, "source_offer_key", ["ordinal"]).drop("ordinal")


def country_names(df: DataFrame, body: str) -> DataFrame:
    """``(country_id, country_name)`` of payloads {data: {country: {id: name}}}; the last name of an id wins."""
    entries = df.select(F.explode(F.map_entries(F.from_json(F.get_json_object(body, "$.data.country"), "map<string,string>"))).alias("e"))
    named = entries.select(F.col("e.key").alias("country_id"), F.col("e.value").alias("country_name")).filter("country_name is not null")
    return named.groupBy("country_id").agg(F.max("country_name").alias("country_name"))


def hotel_pages(df: DataFrame, body: str) -> DataFrame:
    """``(hotel_id, hotel_name, hotel_url)`` of the detail pages in sitemaps, names from slugs."""
    urls = df.select(F.explode(sitemap_urls(F.col(body))).alias("hotel_url"))
    number, slug = detail_ids(F.col("hotel_url"))
    return urls.select(number.alias("hotel_id"), N.title_of_slug(slug).alias("hotel_name"), "hotel_url").filter("hotel_id is not null").groupBy("hotel_id").agg(F.max_by("hotel_name", "hotel_url").alias("hotel_name"), F.max("hotel_url").alias("hotel_url"))


def dated_terms(df: DataFrame, body: str, countries: DataFrame, hotels: DataFrame, source: str, base: str) -> DataFrame:
    """Terms of {data: {dates: []}} with country names and hotels looked up (left joins, broadcast by size).

    Terms without hotel, price, date or nights are left out; a hotel that isn't known is "Hotel <id>"; the first of a
    key stays.
    """
    fields = "master_id long, price_from string, date_from string, duration_night int, country string, boarding string, boarding_id string, transport string, discount_percent double, rating double, tour_operator string, airport_code string"
    rows = json_records(df.select(body), body, "data.dates", fields)
    rows = rows.withColumn("price", F.get_json_object("price_from", "$.CZK").try_cast("double")).withColumn("day", F.try_to_date(F.substring("date_from", 1, 10), "yyyy-MM-dd"))
    rows = rows.filter((F.col("price") > 0) & F.col("master_id").isNotNull() & F.col("day").isNotNull() & F.col("duration_night").isNotNull())
    rows = rows.join(countries, F.col("country") == F.col("country_id"), "left").join(hotels, F.col("master_id") == F.col("hotel_id"), "left")
    price = N.half_up(F.col("price"))
    pct = F.when((F.col("discount_percent") > 0) & (F.col("discount_percent") < 100), F.col("discount_percent"))
    return _offer(rows, {
        "source": F.lit(source), "source_offer_key": N.key_hash(F.col("master_id"), F.col("date_from"), F.col("duration_night"), F.col("boarding_id")),
        "title": F.coalesce("hotel_name", F.concat(F.lit("Hotel "), F.col("master_id").cast("string"))), "country": N.known_country(F.col("country_name")),
        "stars": F.when(F.col("rating") > 0, F.col("rating")), "board": N.board(F.col("boarding")), "transport": N.transport(F.col("transport")), "departure_airport": F.col("airport_code"),
        "departure_date": F.col("day"), "nights": F.col("duration_night"), "price_per_person": price, "claimed_original_price": N.half_up(price / (1 - pct / 100)),
        "claimed_discount_pct": N.half_up(pct), "tour_operator": F.get_json_object("tour_operator", "$.name"), "url": F.coalesce("hotel_url", F.lit(base)),
    })


def tour_hotels(df: DataFrame, body: str, tours: DataFrame, tour: str, source: str, base: str) -> DataFrame:
    """Hotels of {hotels: []} payloads with their tour's ``departure_date, nights, country, locality`` (by ``tour``)."""
    fields = "detailUrl string, hotelId long, name string, rating string, meal string, adultPrice string"
    rows = json_records(df.select(tour, body), body, "hotels", fields).withColumn("price", F.get_json_object("adultPrice", "$.amount").try_cast("double"))
    rows = rows.filter((F.col("price") > 0) & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("detailUrl", F.lit("")) != "")).join(tours, tour)
    board = N.board(F.col("meal"))
    stars = F.get_json_object("rating", "$.count").try_cast("double")
    return _offer(rows, {
        "source": F.lit(source), "source_offer_key": N.key_hash(F.coalesce(F.col("hotelId").cast("string"), F.col("name")), F.col("departure_date"), F.col("nights"), board), "title": F.col("name"),
        "country": N.known_country(F.col("country")), "locality": F.col("locality"), "stars": F.when(stars > 0, stars), "board": board, "transport": F.lit("flight"),
        "departure_date": F.col("departure_date"), "nights": F.col("nights"), "price_per_person": N.half_up(F.col("price")), "url": N.absolute_url(F.col("detailUrl"), base),
    })


def named_hotels(offers: DataFrame, known: DataFrame, hotel: str = "hotel_id") -> DataFrame:
    """Titles of all rows of a hotel from ``known`` (source_offer_key, title) of any of its terms.

    Placeholders name nothing; where terms disagree the smallest name counts. One aggregation of names per hotel and a
    join back, so a hotel of many terms moves one name.
    """
    names = offers.select("source_offer_key", hotel).join(known.filter(~N.is_placeholder(F.col("title"))).select("source_offer_key", F.col("title").alias("__t")), "source_offer_key").groupBy(hotel).agg(F.min("__t").alias("__name"))
    joined = offers.join(names, hotel, "left")
    return joined.withColumn("title", F.when(N.is_placeholder(F.col("title")), F.coalesce("__name", "title")).otherwise(F.col("title"))).select(*offers.columns)
