"""Rolling totals over trailing days, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(at: Column, zone: str) -> Column:
    """Calendar day of an instant in ``zone``."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def rolling_totals(df: DataFrame, entity: str, at: str, value: str, periods: tuple[int, ...] = (7, 30), zone: str = "Europe/Prague", same: list[str] | None = None) -> DataFrame:
    """``(entity, day, n_P, sum_P, mean_P for each P)`` for every day from the entity's first to its last.

    Days are those of ``at`` in ``zone``; only positive ``value`` counts, but every row with a time makes its day part
    of the span. Rows equal in all of ``same`` (default: all columns) count once. A window without a value has count
    and sum 0 and a null mean. Rows without a time have no day and count nowhere; a null entity is an entity. Integers
    are summed as long, decimals exactly, floating-point values as double.

    Aggregate daily, cross each entity with the calendar of its own span, put the days that have values to the empty
    ones, and sum a fixed number of preceding rows. Duplicates are told apart by a fingerprint within (entity, time, value). Partitions
    are by (entity, day) until the data is one row per day, so an entity with a third of the rows is spread over its
    days; a window's partition holds an entity's days, however many rows it had.
    """
    same = df.columns if same is None else same
    rest = [c for c in same if c not in {entity, at, value}]
    mask = F.concat(F.lit(""), *[F.when(df[c].isNull(), "1").otherwise("0") for c in rest])
    rows = df.filter(df[at].isNotNull()).select(df[entity].alias("entity"), df[at].alias("at"), df[value].alias("value"), F.xxhash64(*[df[c] for c in rest], mask).alias("rest"), local_day(df[at], zone).alias("day"))
    once = rows.repartition("entity", "day").dropDuplicates(["entity", "day", "at", "value", "rest"])
    counts = F.col("value") > 0
    daily = once.groupBy("entity", "day").agg(F.count(F.when(counts, 1)).alias("n"), F.sum(F.when(counts, F.col("value"))).alias("total"))

    # Spans come from the rows themselves: least and greatest day are combined before the shuffle.
    spans = df.filter(df[at].isNotNull()).select(df[entity].alias("e"), local_day(df[at], zone).alias("day")).groupBy("e").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    kind = daily.schema["total"].dataType
    calendar = spans.select("e", F.explode(F.sequence("first", "last")).alias("d"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(kind).alias("total"))
    # An empty day and perhaps one with values meet by entity, where the windows run: one shuffle serves both.
    active = daily.select(F.col("entity").alias("e"), F.col("day").alias("d"), "n", F.coalesce("total", F.lit(0).cast(kind)).alias("total"))
    both = calendar.unionByName(active).repartition("e")
    dense = both.groupBy("e", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    out = [F.col("e").alias(entity), F.col("d").alias("day")]
    for p in periods:
        trailing = Window.partitionBy("e").orderBy("d").rowsBetween(-(p - 1), 0)
        n, total = F.sum("n").over(trailing), F.sum("total").over(trailing)
        out += [n.alias(f"n_{p}"), total.alias(f"sum_{p}"), F.when(n > 0, total / n).alias(f"mean_{p}")]
    return dense.select(*out)
