"""What changed between full snapshots: validity intervals and change events (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.canonical import row_fingerprint

#: Columns that say when a row was delivered or sighted, not what it says.
BOOKKEEPING = ("snapshot_no", "snapshot_at", "delivered_at", "last_seen_at")


def validity_intervals(df: DataFrame, key: str = "id", snapshot: str = "snapshot_no", delivered: str = "delivered_at", ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """``(key, first_idx, last_idx, first_no, after_no, hash)``: longest runs of neighbouring deliveries with one content.

    ``first_idx``/``last_idx`` count the deliveries that exist (a gap in their numbers is no gap); ``after_no`` is the
    number of the delivery after the run, null at the end. Of several rows of a key in a delivery the one with the
    latest ``delivered`` counts (ties: greatest fingerprint; null is earliest). A null key is a key; rows of a null
    ``snapshot`` belong to no delivery and count nowhere. An empty table gives no interval.

    Only (key, number, time, fingerprint) is shuffled, combined before the shuffle, so a key that was delivered
    millions of times arrives as one row per delivery.
    """
    said = [c for c in df.columns if c not in {key, snapshot, delivered, *ignore}]
    slim = df.filter(df[snapshot].isNotNull()).select(df[key].alias("key"), df[snapshot].alias("no"), df[delivered].alias("at"), row_fingerprint(df, said).alias("hash"))
    rows = slim.groupBy("key", "no").agg(F.max(F.struct("at", "hash")).alias("best")).select("key", "no", F.col("best.hash").alias("hash"))

    # One row per delivery, however many keys there are: thousands at most, so it may be broadcast.
    in_order = Window.orderBy("no")
    deliveries = df.select(df[snapshot].alias("no")).filter("no is not null").distinct().select("no", F.row_number().over(in_order).alias("idx"), F.lead("no").over(in_order).alias("next_no"))
    rows = rows.join(F.broadcast(deliveries), "no")

    of_key = Window.partitionBy("key").orderBy("idx")
    starts = F.coalesce((F.lag("idx").over(of_key) != F.col("idx") - 1) | (F.lag("hash").over(of_key) != F.col("hash")), F.lit(True))
    islands = rows.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(of_key))
    return islands.groupBy("key", "island").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("no").alias("first_no"), F.max_by("next_no", "idx").alias("after_no"), F.first("hash").alias("hash")
    ).drop("island")


def change_events(intervals: DataFrame, key: str = "id", snapshot: str = "snapshot_no") -> DataFrame:
    """``(snapshot, key, change)`` from :func:`validity_intervals`.

    An interval that follows its neighbour at once is ``changed``; one after a gap (or the first of a key, unless it
    begins with the first delivery, before which there is nothing) is ``added``; one that ends before the last
    delivery and isn't followed at once makes its key ``removed`` in the next delivery.
    """
    of_key = Window.partitionBy("key").orderBy("first_idx")
    adjacent = F.coalesce(F.lag("last_idx").over(of_key) == F.col("first_idx") - 1, F.lit(False))
    followed = F.coalesce(F.lead("first_idx").over(of_key) == F.col("last_idx") + 1, F.lit(False))
    flagged = intervals.withColumn("adjacent", adjacent).withColumn("followed", followed)
    began = F.when(F.col("adjacent"), F.struct(F.col("first_no").alias("no"), F.lit("changed").alias("change"))).when(F.col("first_idx") > 1, F.struct(F.col("first_no").alias("no"), F.lit("added").alias("change")))
    ended = F.when(~F.col("followed") & F.col("after_no").isNotNull(), F.struct(F.col("after_no").alias("no"), F.lit("removed").alias("change")))
    events = flagged.select("key", F.explode(F.array_compact(F.array(began, ended))).alias("e"))
    return events.select(F.col("e.no").alias(snapshot), F.col("key").alias(key), F.col("e.change").alias("change"))


def snapshot_changes(df: DataFrame, key: str = "id", snapshot: str = "snapshot_no", delivered: str = "delivered_at", ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """Added, removed and changed keys of each delivery against the one before it; see the two steps above."""
    return change_events(validity_intervals(df, key, snapshot, delivered, ignore), key, snapshot)
