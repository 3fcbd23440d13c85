"""Values at given ranks of large groups, exactly, without gathering a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.session import cut


def values_at_ranks(counts: DataFrame, groups: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], n: str = "n") -> DataFrame:
    """``(groups, total, one column per rank)``: the first value whose cumulative frequency reaches each rank.

    ``counts`` has one row per (groups, value) with its frequency; ``ranks`` name functions of the group's total. A
    rank beyond the total gives null. Null groups are groups; an empty table gives none.

    The counts are range-sorted by group and value, so a group with most of the values lies over many partitions.
    Running sums within a partition plus the group's total in the partitions before give cumulative frequencies;
    there is one such total per group and partition. The sorted counts are written to the shared folder first: the
    totals and the sums must see the same partitions.
    """
    slim = counts.select(F.struct(*groups).alias("key"), F.col(value).alias("v"), F.col(n).alias("n"))
    placed = cut(slim.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("key", "part").agg(F.sum("n").alias("here"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("key", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(Window.partitionBy("key")).alias("total"))
    running = F.sum("n").over(Window.partitionBy("key", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = placed.join(offsets, ["key", "part"]).withColumn("upto", F.col("offset") + running)
    hits = [F.min(F.when(F.col("upto") >= rank(F.col("total")), F.col("v"))).alias(name) for name, rank in ranks.items()]
    out = reached.groupBy("key").agg(F.max("total").alias("total"), *hits)
    return out.select(*[F.col("key").getField(g).alias(g) for g in groups], "total", *ranks)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` plus ``name``: 1, 2, ... in ``order`` (which should leave no ties), without one task that holds all rows.

    Rows are range-partitioned by ``order`` and numbered within their partition; the number of rows before it is added
    (one small row per partition, so they may be broadcast). The partitions are written to the shared folder first.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before")


def with_previous(df: DataFrame, key: str, by: str, columns: list[str], name: str) -> DataFrame:
    """``df`` plus ``name``: a struct of ``columns`` of the row before in ``key`` by ``by`` (which should leave no ties), null for the first.

    Rows are range-partitioned by key and ``by``, so a key with most of the rows lies over many partitions. Within one,
    the row before is a ``lag``; the first row of a key in a partition gets the key's last row of the partitions before,
    of which there is one per key and partition. Null keys are a key. The partitions are written to the shared folder
    first: rows and edges must see the same ones.
    """
    placed = cut(df.repartitionByRange(key, by).withColumn("__part", F.spark_partition_id()))
    row = F.struct(*columns)
    edges = placed.groupBy(key, "__part").agg(F.max_by(row, by).alias("__edge"))
    before = F.lag("__edge").over(Window.partitionBy(key).orderBy("__part"))
    edges = edges.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), before.alias("__before"))
    inside = F.lag(row).over(Window.partitionBy("__part", key).orderBy(by))
    out = placed.withColumn("__inside", inside).join(edges, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    return out.select(*df.columns, F.coalesce("__inside", "__before").alias(name))
