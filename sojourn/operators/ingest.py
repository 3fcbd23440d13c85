"""Keeping the current state of offers: upsert, misses, and the rows that history gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import normalize as N
from sojourn.operators.history import first_wins
from sojourn.operators.ranks import number_rows

_KEY = ["source", "source_offer_key"]
_TOLD = ["title", "country", "locality", "stars", "board", "transport", "departure_airport", "departure_date", "nights", "tour_operator", "url"]


def upsert(offers: DataFrame, incoming: DataFrame, now: Column, ordinal: str = "ordinal") -> DataFrame:
    """The new version of ``offers`` after ``incoming`` (normalized offers with an ``ordinal``).

    The first row of a key counts. What is known is overwritten, except that a placeholder never replaces a real
    title; seen offers become active with no misses and keep when they were first seen. Keys are computed from the
    title that stays. New offers get ids after the greatest one, in order of ``ordinal``. Departed dates become null.
    """
    zone_day = N.prague_day(now)
    known = first_wins(incoming.withColumn("__key", F.struct(*_KEY)), "__key", [ordinal]).drop("__key")
    came = known.select(*_KEY, ordinal, *[F.when(F.col("departure_date") >= zone_day, F.col("departure_date")).alias(c) if c == "departure_date" else F.col(c) for c in _TOLD])
    both = offers.alias("o").join(came.alias("n"), _KEY, "full")
    seen = F.col(f"n.{ordinal}").isNotNull()
    keeps = N.is_placeholder(F.col("n.title")) & F.col("o.title").isNotNull() & ~N.is_placeholder(F.col("o.title"))
    title = F.when(seen & ~F.coalesce(keeps, F.lit(False)), F.col("n.title")).otherwise(F.col("o.title"))
    told = {c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in _TOLD} | {"title": title}
    merged = both.select(
        F.col("o.id").alias("id"), *_KEY, *[v.alias(c) for c, v in told.items()], F.coalesce("o.first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"), (seen | F.col("o.active")).alias("active"), F.when(seen, 0).otherwise(F.col("o.misses")).alias("misses"),
        F.col(f"n.{ordinal}").alias(ordinal),
    )
    keyed = merged.withColumn("match_key", N.match_key(*[F.col(c) for c in ("title", "country", "departure_date", "nights", "board", "departure_airport")])).withColumn("hotel_key", N.hotel_key(F.col("title"), F.col("country")))
    old = keyed.filter("id is not null")
    greatest = offers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    fresh = number_rows(keyed.filter("id is null").drop("id"), [ordinal, *_KEY], "__new").withColumn("id", greatest.scalar() + F.col("__new")).drop("__new")
    return old.unionByName(fresh).drop(ordinal)


def mark_missed(offers: DataFrame, seen: DataFrame, source: str, limit: int = 2) -> DataFrame:
    """M6: offers of ``source`` whose key isn't in ``seen`` have a miss more, and aren't active from ``limit`` on."""
    keys = seen.select("source_offer_key").distinct().withColumn("__seen", F.lit(True))
    joined = offers.join(keys, "source_offer_key", "left")
    missed = (F.col("source") == source) & F.col("__seen").isNull()
    misses = F.when(missed, F.col("misses") + 1).otherwise(F.col("misses"))
    return joined.withColumn("active", F.when(missed & (F.col("misses") + 1 >= limit), False).otherwise(F.col("active"))).withColumn("misses", misses).select(*offers.columns)


def due_snapshots(current: DataFrame, latest: DataFrame, key: str, price: str, at: str, now: Column, days: int = 7) -> DataFrame:
    """M3: rows of ``current`` that history gets: new keys, other prices than the ``latest`` written, or a heartbeat."""
    last = latest.select(F.col(key).alias("__k"), F.col(price).alias("__p"), F.col(at).alias("__t"))
    joined = current.join(last, F.col(key) == F.col("__k"), "left")
    due = F.col("__k").isNull() | (F.col("__p") != F.col(price)) | (now > F.col("__t") + F.expr(f"INTERVAL {days} DAYS"))
    return joined.filter(due).select(*current.columns)


def replace_set(values: DataFrame, column: str) -> DataFrame:
    """M9: canonical countries, unknown ones left out, each once."""
    return values.select(N.known_country(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct()
