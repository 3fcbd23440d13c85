"""Compares a query with its SQL in DuckDB, as the driver does."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        import datetime as dt

        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def differences(df: DataFrame, sql: str, sf_dir: str) -> str:
    """'' if the rows are equal as bags, else what differs."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    theirs = Counter(tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours = Counter(tuple(_plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
