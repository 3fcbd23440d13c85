"""Percentiles of very large numeric columns: exact, from value counts that can be put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.ranks import values_at_ranks


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups, value, n)``: the mergeable summary. Null values count nowhere; null groups are groups."""
    return df.filter(df[value].isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: list[DataFrame], groups: list[str], value: str) -> DataFrame:
    """Summaries of separate days or partitions as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*groups, value).agg(F.sum("n").alias("n"))


def _rank(total: Column, percent: int) -> Column:
    """ceil(total * percent / 100), in integers."""
    return F.greatest(F.floor((total * percent + 99) / 100), F.lit(1)).cast("long")


def percentiles_of_counts(counts: DataFrame, groups: list[str], value: str, percents: tuple[int, ...] = (10, 50, 90, 99)) -> DataFrame:
    """``(groups, n, pP for each P)``: the first value whose cumulative frequency reaches ceil(P % of n).

    The rank error is zero, on merged summaries as well; what is given is always a value that occurs. An empty table
    gives no group.

    See ``values_at_ranks``: group-value counts are range-sorted, partition offsets are added to window running sums,
    and the first values that reach the target ranks are picked.
    """
    ranks = {f"p{p}": (lambda total, p=p: _rank(total, p)) for p in percents}
    return values_at_ranks(counts, groups, value, ranks).withColumnRenamed("total", "n")


def price_percentiles(prices: DataFrame, offers: DataFrame, groups: list[str], percents: tuple[int, ...] = (10, 50, 90, 99)) -> DataFrame:
    """Percentiles of the positive price by attributes of the offer; every row counts, written twice or not.

    Prices are counted per offer and value before they meet the offers, so that an offer with most of the rows comes
    to the join as its distinct prices.
    """
    per_offer = value_counts(prices.filter("price_per_person > 0"), ["offer_id"], "price_per_person")
    told = per_offer.join(offers.select(F.col("id").alias("offer_id"), *groups), "offer_id")
    counts = told.groupBy(*groups, "price_per_person").agg(F.sum("n").alias("n"))
    return percentiles_of_counts(counts, groups, "price_per_person", percents)
