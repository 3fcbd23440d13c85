"""Landed payloads (JSON, HTML, XML, tokens) to rows. Pages are read from files; nothing is fetched."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of one normalized offer, whatever its source.
OFFER = (
    "source string, source_offer_key string, title string, country string, locality string, stars double, board string, transport string, "
    "departure_airport string, departure_date date, nights int, price_per_person int, price_total int, claimed_original_price int, "
    "claimed_discount_pct double, omnibus_lowest_price int, tour_operator string, url string"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(url, fetched_at, body)`` of whole files under ``path``, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"), F.decode("content", "utf-8").alias("body"))


def json_records(df: DataFrame, body: str, path: str, fields: str, ordinal: str = "ordinal") -> DataFrame:
    """The objects of the array at ``path`` ("a.b") of a JSON body, with ``fields`` (DDL), one row each.

    A body that isn't JSON, or has no such array, gives no row; a field of another type is null. ``ordinal`` is the
    place in the array. Other columns of ``df`` stay, unless a field has their name.
    """
    names = [f.name for f in T.StructType.fromDDL(fields)]
    # Values are read as text and cast, so that "7" and 7 are both numbers.
    inner = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    parsed = F.from_json(F.get_json_object(body, f"$.{path}"), inner)
    keep = [c for c in df.columns if c not in {*names, ordinal, body}]
    rows = df.select(*keep, F.posexplode(parsed).alias(ordinal, "__r"))
    return rows.select(*keep, ordinal, *[F.col("__r").getField(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(fields)])


def token_payload(token: Column) -> Column:
    """The JSON text in the middle part of a signed token (base64url), null unless it has three parts and is JSON."""
    parts = F.split(token, r"\.")
    middle = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.rpad(middle, (F.ceil(F.length(middle) / 4) * 4).cast("int"), F.lit("="))
    text = F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8")
    return F.when((F.size(parts) == 3) & F.try_parse_json(text).isNotNull() & text.startswith("{"), text)


def balanced(text: str, marker: str, aware: bool = True) -> str | None:
    """The bracketed value that begins at or after ``marker``; brackets in strings don't count if ``aware``."""
    at = text.find(marker)
    if at < 0:
        return None
    start = next((i for i in range(at + len(marker.rstrip("[{")), len(text)) if text[i] in "[{"), -1)
    if start < 0:
        return None
    depth, quoted, k = 0, False, start
    while k < len(text):
        c = text[k]
        if aware and quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif aware and c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[start : k + 1]
        k += 1
    return None


def embedded_json(marker: str, aware: bool = True):
    """Function of a text column that gives the bracketed JSON after ``marker``, or null."""

    @F.pandas_udf(T.StringType())
    def cut_out(text: pd.Series) -> pd.Series:
        return text.map(lambda t: balanced(t, marker, aware) if isinstance(t, str) else None).astype(object)

    return cut_out


def pushed_chunks(text: Column, call: str = r"self\.__next_f\.push\(\[1,\s*") -> Column:
    """S3: the string literals of repeated push calls, unescaped and put together in order."""
    literals = F.regexp_extract_all(text, F.lit(call + r'("(?:[^"\\]|\\.)*")'), F.lit(1))
    return F.array_join(F.transform(literals, lambda s: F.coalesce(F.try_variant_get(F.try_parse_json(s), "$", "string"), F.lit(""))), "")


def sitemap_urls(body: Column) -> Column:
    """The places that a sitemap or an index of sitemaps names, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def detail_ids(url: Column) -> tuple[Column, Column]:
    """Id and slug of a detail page's URL, null for others."""
    steps = F.split(F.regexp_replace(url, "/$", ""), "/")
    below = F.size(steps) - F.array_position(steps, "detail-zajezdu")  # steps after the section, wherever that is
    number = F.regexp_extract(F.element_at(steps, -1), r"^(\d+)\p{Alpha}*$", 1).try_cast("long")
    there = F.array_contains(steps, "detail-zajezdu") & (below >= 2) & number.isNotNull()
    return F.when(there, number), F.when(there, F.nullif(F.element_at(steps, -2), F.lit("")))


@F.pandas_udf(T.StringType())
def lodging_name(page: pd.Series) -> pd.Series:
    """Name of the first ld+json block about lodging, else the text of the first heading, else null."""
    return page.map(_lodging_name).astype(object)


class _Cards(HTMLParser):
    """Collects, for each element that a card pattern fits, the texts and attributes of what is in it."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, card: tuple[str, str], fields: dict[str, tuple[str, str, str | None]]):
        super().__init__(convert_charrefs=True)
        self.card, self.fields = card, fields
        self.cards: list[dict[str, str]] = []
        self.open: list[tuple[str, bool, list[str]]] = []
        self.current: dict[str, str] | None = None

    @staticmethod
    def fits(attrs: dict[str, str | None], name: str, value: str) -> bool:
        have = attrs.get(name)
        return have is not None and (have == value or value in have.split())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        is_card = self.current is None and self.fits(have, *self.card)
        if is_card:
            self.current = {}
        texts = []
        if self.current is not None:
            for field, (name, value, attribute) in self.fields.items():
                if field in self.current or not self.fits(have, name, value):
                    continue
                if attribute is None:
                    self.current[field] = ""
                    texts.append(field)
                elif have.get(attribute) is not None:
                    self.current[field] = have[attribute] or ""
        if tag not in self.VOID:
            self.open.append((tag, is_card, texts))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, was_card, _ = self.open.pop()
            if was_card and self.current is not None:
                self.cards.append(self.current)
                self.current = None
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.current is not None:
            for _, _, texts in self.open:
                for field in texts:
                    self.current[field] += data


class _Name(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts: list[str] = []
        self.heading: str | None = None
        self.into = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.into = "script"
            self.scripts.append("")
        elif tag == "h1" and self.heading is None:
            self.into, self.heading = "h1", ""

    def handle_endtag(self, tag: str) -> None:
        if tag == self.into:
            self.into = ""

    def handle_data(self, data: str) -> None:
        if self.into == "script":
            self.scripts[-1] += data
        elif self.into == "h1":
            self.heading = (self.heading or "") + data


def _lodging_name(page: str | None) -> str | None:
    if not isinstance(page, str) or not page.strip():
        return None
    parser = _Name()
    parser.feed(page)
    for script in parser.scripts:
        try:
            block = json.loads(script)
        except ValueError:
            continue
        kind = block.get("@type", "") if isinstance(block, dict) else ""
        name = block.get("name") if isinstance(block, dict) else None
        if "lodging" in (" ".join(kind) if isinstance(kind, list) else str(kind)).lower() and isinstance(name, str) and name.strip():
            return html.unescape(name.strip())
    return (parser.heading or "").strip() or None


@dataclass(frozen=True)
class CardSpec:
    """Which elements are cards, and which of their parts are fields: (attribute, value, attribute to take or None for text)."""

    card: tuple[str, str]
    fields: dict[str, tuple[str, str, str | None]]


def html_cards(df: DataFrame, body: str, spec: CardSpec, ordinal: str = "ordinal") -> DataFrame:
    """A row per card of an HTML body with the spec's fields as text (null where absent).

    Pages are parsed where they lie, in Arrow batches; other columns of ``df`` stay.
    """
    keep = [c for c in df.columns if c != body]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ordinal, T.IntegerType())] + [T.StructField(f, T.StringType()) for f in spec.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                parser = _Cards(spec.card, spec.fields)
                parser.feed(getattr(page, body) or "")
                parser.close()
                cards = parser.cards + ([parser.current] if parser.current else [])
                for k, card in enumerate(cards):
                    rows.append([getattr(page, c) for c in keep] + [k] + [" ".join(card[f].split()) if f in card else None for f in spec.fields])
            yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(run, schema)


def by_nights(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    """A JSON object keyed by nights as one row per entry: ``nights`` and ``value``."""
    keep = [c for c in df.columns if c not in {column, "nights", value}]
    entries = F.explode(F.map_entries(F.from_json(column, "map<string,string>")))
    return df.select(*keep, entries.alias("e")).select(*keep, F.col("e.key").try_cast("int").alias("nights"), F.col("e.value").alias(value))


def select_sources(names: str, known: list[str]) -> tuple[list[str], list[str]]:
    """``a,b,c`` as (known ones in their order, unknown ones)."""
    asked = [n.strip() for n in names.split(",") if n.strip()]
    return [n for n in known if n in asked], [n for n in dict.fromkeys(asked) if n not in known]
