"""Canonical text and row fingerprints."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode composition (NFC), a whole Arrow batch at a time; null stays null."""
    return pc.utf8_normalize(text, form="NFC")


@F.arrow_udf(T.StringType())
def nfd(text: pa.Array) -> pa.Array:
    """Unicode decomposition (NFD), a whole Arrow batch at a time; null stays null."""
    return pc.utf8_normalize(text, form="NFD")


def without_space(text: Column) -> Column:
    """Every Unicode white-space character removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def _comparable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(df[name]))
    return df[name]


def row_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """64-bit fingerprint of ``columns``; null is a value of its own, text counts without white space and in NFC.

    All text columns cross to Arrow as one string; numbers, dates and nested values are hashed in the JVM. xxhash64
    passes over nulls, so a mask of them goes in as well.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    others = [c for c in columns if c not in texts]
    parts: list[Column] = []
    if texts:
        joined = F.concat(*[F.concat(F.coalesce(without_space(df[c]), F.lit("\u0000")), F.lit("\u0001")) for c in texts])
        parts.append(nfc(joined))
    parts += [_comparable(df, c) for c in others]
    mask = F.concat(F.lit(""), *[F.when(df[c].isNull(), "1").otherwise("0") for c in others])
    return F.xxhash64(*parts, mask)
