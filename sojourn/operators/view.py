"""A view of offers: facet filters, sorting, and their form in a URL."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import normalize as N

SORTS = ("real", "price", "departure")


@dataclass(frozen=True)
class View:
    """Empty lists and nulls don't filter; a null value fails a filter that is set."""

    countries: tuple[str, ...] = ()
    boards: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    airports: tuple[str, ...] = ()
    own: bool = False
    most: int | None = None
    first: str | None = None
    last: str | None = None
    least_pct: int = 0
    sort: str = field(default="real")

    def condition(self) -> Column:
        """All set filters, as one predicate that reaches the scan where its columns do."""
        parts: list[Column] = []
        for column, values in ((F.col("country"), self.countries), (F.col("board"), self.boards), (F.col("source"), self.sources), (N.nights_band(F.col("nights")), self.bands)):
            if values:
                parts.append(column.isin(*values))
        if self.airports or self.own:
            either = [F.upper("departure_airport").isin(*[a.upper() for a in self.airports])] if self.airports else []
            either += [F.col("transport") == "own"] if self.own else []
            parts.append(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), either))
        if self.most is not None:
            parts.append(F.col("price") <= self.most)
        if self.first:
            parts.append(F.col("departure_date") >= F.lit(self.first).cast("date"))
        if self.last:
            parts.append(F.col("departure_date") <= F.lit(self.last).cast("date"))
        if self.least_pct > 0:
            parts.append(F.col("real_pct") >= self.least_pct)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        """Filtered and sorted; ties by id."""
        order = {"real": F.desc_nulls_last("real_pct"), "price": F.asc("price"), "departure": F.asc_nulls_last("departure_date")}[self.sort]
        return df.filter(self.condition()).orderBy(order, "id")

    def active(self) -> int:
        """Filters that are set."""
        return sum(bool(getattr(self, f.name)) for f in fields(self) if f.name not in {"sort", "last"}) + bool(self.last and not self.first)

    def to_query(self) -> str:
        """Defaults aren't written."""
        plain = View()
        pairs = []
        for f in fields(self):
            v = getattr(self, f.name)
            if v != getattr(plain, f.name):
                pairs.append((f.name, ",".join(v) if isinstance(v, tuple) else int(v) if isinstance(v, bool) else v))
        return urlencode(pairs)

    @classmethod
    def from_query(cls, query: str) -> View:
        """Unknown names and bad values are ignored."""
        given = {k: v[-1] for k, v in parse_qs(query).items()}
        out = {}
        for f in fields(cls):
            v = given.get(f.name)
            if v is None:
                continue
            if f.name in {"most", "least_pct"}:
                if v.lstrip("-").isdigit():
                    out[f.name] = int(v)
            elif f.name == "own":
                out["own"] = v == "1"
            elif f.name in {"first", "last"}:
                if len(v) == 10 and v.replace("-", "").isdigit():
                    out[f.name] = v
            elif f.name == "sort":
                if v in SORTS:
                    out["sort"] = v
            else:
                out[f.name] = tuple(x for x in v.split(",") if x)
        return cls(**out)
