"""Medians over a row's peers: leave-one-group-out per bucket, and range joins around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.history import twin_key, twin_minimum
from sojourn.operators.ranks import values_at_ranks


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equal keys, null equal to null; the keys of ``a`` stay."""
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(renamed, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def leave_out_median(df: DataFrame, bucket: list[str], match: str, id_: str, value: str, least: int) -> DataFrame:
    """``(id, peers, median)``: median of ``value`` over the other twin groups of the row's bucket.

    Twins (equal ``match``) count once with their least value, a row's own twins not at all; null bucket columns are
    values. Null median below ``least`` peers.

    No self-join: taking one value out of a sorted list moves the middle by one place at most, so the four values
    around the middle of each bucket answer for all its rows. A row that lies above the place j has the j-th value
    there, another one the next (with ties both are the same). The four come from range-sorted counts.
    """
    groups = twin_minimum(df, bucket, match, id_, value)
    counts = groups.groupBy(*bucket, value).agg(F.count(F.lit(1)).alias("n"))
    low, high = lambda t: F.floor(t / 2), lambda t: F.floor((t - 1) / 2) + 1  # places of the middle of t - 1 values
    middle = values_at_ranks(counts, bucket, value, {"__low": lambda t: F.greatest(low(t), F.lit(1)), "__low_next": lambda t: low(t) + 1, "__high": high, "__high_next": lambda t: high(t) + 1})
    own = _join_null_safe(df.select(id_, *bucket, twin_key(df[match], df[id_]).alias("twins")), groups.select(*bucket, "twins", F.col(value).alias("own")), [*bucket, "twins"], "inner")
    joined = _join_null_safe(own, middle, bucket, "inner")
    left = F.when(F.col("own") > F.col("__low"), F.col("__low")).otherwise(F.col("__low_next"))
    right = F.when(F.col("own") > F.col("__high"), F.col("__high")).otherwise(F.col("__high_next"))
    peers = F.col("total") - 1
    return joined.select(id_, peers.alias("peers"), F.when(peers >= least, (left + right) / 2).alias("median"))


def range_median(df: DataFrame, equal: list[str], match: str, id_: str, value: str, day: str, days: int, number: str, within: int, least: int, nullable: tuple[str, ...] = ()) -> DataFrame:
    """``(id, peers, median)`` over other twin groups with equal keys, ``day`` within ``days`` and ``number`` within
    ``within``; rows with a null among them have no peers, but in the keys named ``nullable`` null is a value.

    Days fall into bins as wide as the window; a row meets its bin and the two beside it, so the range join is an equi
    join on (keys, bin), which spreads a key over its bins. Twins are reduced per subject before the median.
    """
    rows = df.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*equal, day, number, value) if c not in nullable]))
    slim = rows.select(id_, *equal, twin_key(rows[match], rows[id_]).alias("twins"), F.unix_date(day).alias("d"), F.col(number).alias("k"), F.col(value).alias("v"))
    width = max(1, days)
    subject = slim.withColumn("bin", F.explode(F.array(*[F.floor(F.col("d") / width) + i for i in (-1, 0, 1)])))
    peer = slim.select(*[F.col(c).alias(f"p_{c}") for c in slim.columns], F.floor(F.col("d") / width).alias("p_bin"))
    on: list[Column] = [F.col(c).eqNullSafe(F.col(f"p_{c}")) if c in nullable else F.col(c) == F.col(f"p_{c}") for c in equal] + [F.col("bin") == F.col("p_bin"), F.col("twins") != F.col("p_twins")]
    met = subject.join(peer, reduce(lambda x, y: x & y, on)).filter((F.abs(F.col("d") - F.col("p_d")) <= days) & (F.abs(F.col("k") - F.col("p_k")) <= within))
    once = met.groupBy(id_, "p_twins").agg(F.min("p_v").alias("v"))
    agg = once.groupBy(id_).agg(F.count(F.lit(1)).alias("peers"), F.median("v").alias("m"))
    return agg.select(id_, "peers", F.when(F.col("peers") >= least, F.col("m")).alias("median"))


def first_rung(rungs: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Q1: name and value of the first rung that is positive, in order; null where none is."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for label, v in reversed(rungs):
        name, value = F.when(v > 0, label).otherwise(name), F.when(v > 0, v.cast("double")).otherwise(value)
    return name, value
