"""Rows against small tables: exclusions, criteria, logs of what went out, caps; and status over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import normalize as N


def visible(df: DataFrame, excluded: DataFrame, now: Column) -> DataFrame:
    """Rows whose country isn't excluded (null never is) and whose day hasn't passed in Prague (null hasn't).

    An anti-join on the country; Spark broadcasts the exclusions by their size.
    """
    open_ = df.filter(F.col("departure_date").isNull() | (F.col("departure_date") >= N.prague_day(now)))
    return open_.join(excluded.select(F.col("country").alias("__x")).distinct(), F.col("country") == F.col("__x"), "left_anti")


def meet_criteria(df: DataFrame, criteria: DataFrame, now: Column, name: str = "name") -> DataFrame:
    """``df`` with ``name`` of each criteria row that a row meets; a row may meet several or none.

    Criteria: ``name, countries, boards array<string>, months array<int>, transport, within_days, most``; empty arrays
    and nulls ask for nothing. A null value meets only what asks for nothing. Passed days meet nothing. Criteria that
    name countries are joined on the country (exploded), the others on a constant, so that the join is an equi join;
    criteria are written by people, so their number is theirs, and Spark broadcasts them by size.
    """
    today = N.prague_day(now)
    keys = F.when(F.size("countries") > 0, F.transform("countries", lambda c: N.country(c))).otherwise(F.array(F.lit("*")))
    asked = criteria.select(F.col("name").alias(f"__{name}"), F.explode(F.array_distinct(keys)).alias("__country"), F.col("boards").alias("__boards"), F.col("months").alias("__months"), F.col("transport").alias("__transport"), F.col("within_days").alias("__within"), F.col("most").alias("__most"))
    rows = df.filter(F.col("departure_date").isNull() | (F.col("departure_date") >= today)).withColumn("__key", F.explode(F.array_compact(F.array(F.lit("*"), N.country(F.col("country"))))))
    met = rows.join(asked, F.col("__key") == F.col("__country"))
    fits = (
        ((F.size("__boards") == 0) | F.coalesce(F.array_contains("__boards", F.col("board")), F.lit(False)))
        & ((F.size("__months") == 0) | F.coalesce(F.array_contains("__months", F.month("departure_date")), F.lit(False)))
        & (F.col("__transport").isNull() | F.coalesce(F.col("transport") == F.col("__transport"), F.lit(False)))
        & (F.col("__within").isNull() | F.coalesce(F.datediff("departure_date", today).between(0, F.col("__within")), F.lit(False)))
        & (F.col("__most").isNull() | F.coalesce(F.col("price") <= F.col("__most"), F.lit(False)))
    )
    return met.filter(fits).select(*[c for c in df.columns if c != name], F.col(f"__{name}").alias(name))


def not_yet_told(candidates: DataFrame, log: DataFrame, now: Column, once: tuple[str, ...], drop_pct: float, after_days: int) -> DataFrame:
    """Candidates (key, type, price...) that the ``log`` (key, type, price, at, id) doesn't hold back.

    The latest log row by id of (key, type) decides: none lets pass; a type in ``once`` never passes again; others pass
    if the price fell by ``drop_pct`` percent or more, or ``after_days`` have gone by.
    """
    last = log.groupBy("key", "type").agg(F.max(F.struct("id", "price", "at")).alias("__l"))
    joined = candidates.join(last, ["key", "type"], "left")
    fell = (F.col("__l.price") - F.col("price")) * 100 >= F.col("__l.price") * drop_pct
    later = now >= F.col("__l.at") + F.expr(f"INTERVAL {after_days} DAYS")
    passes = F.col("__l").isNull() | (~F.col("type").isin(*once) & (F.coalesce(fell, F.lit(False)) | F.coalesce(later, F.lit(False))))
    return joined.filter(passes).select(*candidates.columns)


def capped(df: DataFrame, by: list[Column], most: int) -> tuple[DataFrame, Column]:
    """The first ``most`` rows in order (a top-k, merged from each task's own), and how many more there are."""
    rest = df.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n"))
    return df.orderBy(*by).limit(most), rest.scalar()


def run_status(runs: DataFrame, now: Column, look: int = 20, hours: int = 24) -> DataFrame:
    """Per source its newest run, and until when it backs off.

    Of the last ``look`` runs by id the newest that isn't about backing off decides: if it failed as BLOCKED, the
    source waits ``hours`` from its start; null if that is over.
    """
    w = Window.partitionBy("source").orderBy(F.desc("id"))
    recent = runs.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= look)
    real = ~F.coalesce(F.col("error_sample").startswith("BACKOFF"), F.lit(False))
    row = F.struct("id", "status", "error_sample", "started_at")
    agg = recent.groupBy("source").agg(F.max(row).alias("last"), F.max(F.when(real, row)).alias("real"))
    until = F.col("real.started_at") + F.expr(f"INTERVAL {hours} HOURS")
    blocked = (F.col("real.status") == "failed") & F.coalesce(F.col("real.error_sample").startswith("BLOCKED"), F.lit(False)) & (now < until)
    return agg.select("source", F.col("last.status").alias("status"), F.col("last.started_at").alias("started_at"), F.when(blocked, until).alias("backoff_until"))


def history_stats(prices: DataFrame, key: str, by: str, at: str, price: str, now: Column, days: int = 30) -> DataFrame:
    """Per key the first and last time seen, range, last price, and median of the last ``days`` with today."""
    recent = F.when(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"), F.col(price))
    agg = prices.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(price).alias("least"), F.max(price).alias("most"), F.max_by(price, by).alias("last_price"), F.median(recent).alias("median"))
    return agg.withColumn("days_tracked", F.datediff(N.prague_day(F.col("last_at")), N.prague_day(F.col("first_at"))))
