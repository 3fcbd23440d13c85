"""Latest values, groups of twins, and series over append-only history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.ranks import with_previous
from sojourn.operators.rolling import local_day
from sojourn.session import cut


def latest(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """A1: ``columns`` of each key's row with the greatest ``by`` (an id that rises with arrival, not a time)."""
    best = df.groupBy(key).agg(F.max(F.struct(by, *columns)).alias("b"))
    return best.select(key, *[F.col("b").getField(c).alias(c) for c in columns])


def twin_key(match: Column, id_: Column) -> Column:
    """Rows without a key stay alone."""
    return F.coalesce(match, F.concat(F.lit("id:"), id_.cast("string")))


def twin_minimum(df: DataFrame, groups: list[str], match: str, id_: str, value: str) -> DataFrame:
    """A2: least ``value`` of each twin group within ``groups``; combined before the shuffle."""
    return df.groupBy(*groups, twin_key(df[match], df[id_]).alias("twins")).agg(F.min(value).alias(value))


def representatives(df: DataFrame, match: str, id_: str, price: str, others: list[str], alternatives: int = 3) -> DataFrame:
    """A3: the cheapest row of each twin group and up to ``alternatives`` dearer ones, ascending (ties: smaller id).

    One aggregation keeps the few least structs of a group, however large it is: ``alternatives`` is an array of
    (price, id, others...).
    """
    row = F.struct(F.col(price), F.col(id_), *others)
    w = Window.partitionBy("twins").orderBy(price, id_)
    few = df.withColumn("twins", twin_key(df[match], df[id_])).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= alternatives + 1)
    grouped = few.groupBy("twins").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    return grouped.select("twins", *[first.getField(c).alias(c) for c in (id_, price, *others)], F.slice("rows", 2, alternatives).alias("alternatives"))


def own_baseline(df: DataFrame, key: str, at: str, price: str, now: Column, days: int = 30, least: int = 3, span_days: float = 5.0, zone: str = "Europe/Prague") -> DataFrame:
    """A5: exact median of a key's own prices in the ``days`` before ``now``, today in ``zone`` left out.

    Null where there are fewer than ``least`` rows or they span less than ``span_days``. ``percentile`` buffers value
    counts, which are combined before the shuffle: a key with most of the rows comes as its distinct prices.
    """
    recent = df.filter((df[at] >= now - F.expr(f"INTERVAL {days} DAYS")) & (df[at] < now) & (local_day(df[at], zone) != local_day(now, zone)))
    agg = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("span"), F.median(price).alias("m"))
    return agg.select(key, "n", F.when((F.col("n") >= least) & (F.col("span") >= int(span_days * 86_400_000_000)), F.col("m")).alias("baseline"))


def last_points(df: DataFrame, key: str, by: str, value: str, points: int = 14) -> DataFrame:
    """The last ``points`` values of each key by ``by``, oldest first, as an array; only those rows are gathered."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    few = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= points)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value]).alias("points"))


def moves(df: DataFrame, key: str, by: str, price: str) -> DataFrame:
    """Rows whose price differs from the one before, with that price; a key with most of the rows is split."""
    rows = with_previous(df.select(key, by, price), key, by, [price], "__last")
    return rows.select(key, by, price, F.col("__last").getField(price).alias("previous")).filter(F.col("previous") != F.col(price))


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row in ``order``; the rest of the row goes with it."""
    rest = [c for c in df.columns if c not in {key, *order}]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *[F.col("b").getField(c).alias(c) for c in (*order, *rest)]).select(*df.columns)


def cheapest_wins(df: DataFrame, key: str, price: str, order: str) -> DataFrame:
    """Each key's cheapest row (ties: first in ``order``) at the place of its first."""
    rest = [c for c in df.columns if c not in {key, price, order}]
    best = df.groupBy(key).agg(F.min(F.struct(price, order, *rest)).alias("b"), F.min(order).alias("place"))
    return best.select(key, F.col("b").getField(price).alias(price), F.col("place").alias(order), *[F.col("b").getField(c).alias(c) for c in rest]).select(*df.columns)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: ``(facet, value, n)`` of each distinct value; null isn't one. All facets in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).filter("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def streaks(df: DataFrame, key: str, by: str, failed: Column, length: int = 3, look: int = 20, ignored: Column | None = None) -> DataFrame:
    """Keys of whose last ``look`` rows the newest ``length`` failed and the one before didn't (none counts as not).

    ``ignored`` rows (null isn't) are left out after ``look`` is cut and before the rest are numbered; a key that has no
    other row stays, without alert.
    """
    skip = F.lit(False) if ignored is None else F.coalesce(ignored, F.lit(False))
    w = Window.partitionBy(key).orderBy(F.desc(by))
    rows = df.select(key, by, failed.alias("failed"), skip.alias("skip"), F.row_number().over(w).alias("rn")).filter(F.col("rn") <= look)
    if ignored is not None:
        rows = rows.withColumn("rn", F.when(~F.col("skip"), F.count_if(~F.col("skip")).over(w)))
    chain = F.count_if(F.col("failed") & (F.col("rn") <= length)) == length
    before = F.coalesce(F.bool_or(F.col("failed") & (F.col("rn") == length + 1)), F.lit(False))
    return rows.groupBy(key).agg((chain & ~before).alias("alert"))


def heartbeat(df: DataFrame, key: str, by: str, at: str, price: str, days: float = 7.0) -> DataFrame:
    """Rows that a change-or-heartbeat writer keeps: the first, those with another price than the last one
    written, and those more than ``days`` after it.

    A run of rows of one price begins with a written row whatever was before, so runs are independent of each other:
    rows are partitioned by (key, run), not by key, and each task folds its sorted rows as they stream by, holding
    one run's last written time. The row before comes from range partitions (:func:`with_previous`), and so does the
    start of a row's run: the last start at or before it in its partition, else in those before.
    """
    rows = with_previous(df.select(F.col(key).alias("k"), F.col(by).alias("b"), F.unix_micros(at).alias("t"), F.col(price).alias("p")), "k", "b", ["p"], "last")
    starts = rows.withColumn("start", F.when(F.col("last").isNull() | ~F.col("last.p").eqNullSafe(F.col("p")), F.col("b"))).drop("last")
    placed = cut(starts.repartitionByRange("k", "b").withColumn("part", F.spark_partition_id()))
    edges = placed.groupBy("k", "part").agg(F.max("start").alias("edge"))
    before = F.max("edge").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(F.col("k").alias("k2"), F.col("part").alias("part2"), before.alias("before"))
    inside = F.max("start").over(Window.partitionBy("part", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    runs = placed.withColumn("inside", inside).join(edges, F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("part2")))
    runs = runs.select("k", "b", "t", "p", F.coalesce("inside", "before").alias("run"))
    sorted_runs = runs.repartition("k", "run").sortWithinPartitions("k", "run", "b")
    gap = int(days * 86_400_000_000)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, price, by)}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0
        for batch in batches:
            kept = []
            for k, r, t in zip(batch["k"].tolist(), batch["run"].tolist(), batch["t"].tolist(), strict=True):
                k = None if k != k else k  # a null key among numbers
                writes = (k, r) != run or t - last > gap
                if writes:
                    run, last = (k, r), t
                kept.append(writes)
            part = batch[kept]
            yield pd.DataFrame({key: part["k"], price: part["p"], by: part["b"]})

    return sorted_runs.mapInPandas(fold, f"{key} {kinds[key]}, {price} {kinds[price]}, {by} {kinds[by]}")
