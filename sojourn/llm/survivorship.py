"""Best representative of each duplicate group: field by field, the maximum of a composite struct."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """An attribute of the surviving record: its value, where it counts, and what makes one better, most weighty first."""

    name: str
    value: Column
    usable: Column
    better: tuple[Column, ...]


def survivors(df: DataFrame, key: str, fields: list[Field], least: int = 2) -> DataFrame:
    """``(key, one column per field)`` for each ``key`` of ``least`` members or more, in one aggregation.

    For each field the greatest of (usable, better..., value) wins; among equals the greatest value, so the result
    doesn't depend on the order of rows. A field that no member can fill is null. Rows of a null key belong to no
    group. The maximum is taken before the shuffle as well, so a group with a third of all rows comes as one row per task.
    """
    structs = [F.max(F.struct(F.coalesce(f.usable, F.lit(False)).alias("usable"), *[b.alias(f"b{i}") for i, b in enumerate(f.better)], f.value.alias("value"))).alias(f.name) for f in fields]
    grouped = df.filter(df[key].isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__members"), *structs)
    return grouped.filter(F.col("__members") >= least).select(key, *[F.when(F.col(f"{f.name}.usable"), F.col(f"{f.name}.value")).alias(f.name) for f in fields])


#: A page of one hotel or one term carries its number; lists, searches, home and error pages carry none of these.
PAGE = r"^https?://[^/]+/(?:.*[?&](?:term|termin)=\d+|nabidka/\d+|[^?]*-z\d+/\d+|hotel/\d+-[a-z0-9]|detail\.php\?(?:[^#]*&)?id=\d+)"


def is_page(url: Column) -> Column:
    """Whether a URL leads to a page of a hotel or term itself."""
    return F.coalesce(url.rlike(PAGE) & ~url.rlike(r"^https?://[^/]+/404\b"), F.lit(False))


def best_offers(offers: DataFrame, prices: DataFrame, registry: DataFrame) -> DataFrame:
    """``(match_key, source, price_per_person, url)`` of each match_key of two or more offers.

    The best trusted source of the members (unknown sources last, then by name); the positive price captured last
    among the members (greatest id if tied); the URL of a page from the best trusted member that has one, the one seen
    last within a source. A set without such a price or URL has null there. Repeated offer ids count as members each.

    Prices are reduced to one row per offer before they meet the offers; the registry is a table of sources, joined
    by its size.
    """
    members = offers.select("id", "match_key", "source", "url", "last_seen_at").filter("match_key is not null")
    ranks = registry.groupBy(F.col("source").alias("s")).agg(F.min("trust_rank").alias("rank"))
    members = members.join(ranks, F.col("source") == F.col("s"), "left").withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))
    last = prices.filter("price_per_person > 0").groupBy("offer_id").agg(F.max(F.struct("captured_at", "id", "price_per_person")).alias("p"))
    joined = members.join(last, F.col("id") == F.col("offer_id"), "left").select("match_key", "source", "url", "last_seen_at", "rank", "p")
    trusted = (-F.col("rank")).alias("trust")
    fields = [
        Field("source", F.col("source"), F.col("source").isNotNull(), (trusted,)),
        Field("price_per_person", F.col("p.price_per_person"), F.col("p").isNotNull(), (F.col("p.captured_at"), F.col("p.id"))),
        Field("url", F.col("url"), is_page(F.col("url")), (trusted, F.col("last_seen_at"))),
    ]
    return survivors(joined, "match_key", fields)
