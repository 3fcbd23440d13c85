"""Scalar normalizers of scraped text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every letter of the basic plane that decomposes into one base letter and combining marks (0300-036F), and the base.
_COMPOSED = [c for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all("̀" <= x <= "ͯ" for x in d[1:])]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _COMPOSED)

# Countries by their canonical name, and other names of some.
COUNTRIES = (
    "Řecko", "Turecko", "Egypt", "Španělsko", "Kypr", "Bulharsko", "Chorvatsko", "Itálie", "Tunisko", "Malta", "Portugalsko", "Albánie", "Černá Hora",
    "Maroko", "Spojené arabské emiráty", "Thajsko", "Zanzibar", "Kapverdy", "Dominikánská republika", "Mexiko", "Kuba", "Maledivy", "Mauricius",
    "Seychely", "Srí Lanka", "Indonésie", "Vietnam", "Madeira", "Kanárské ostrovy", "Slovinsko", "Francie", "Rakousko", "Maďarsko", "Slovensko",
    "Česká republika", "Gruzie", "Jordánsko", "Izrael", "Omán", "Katar", "Polsko", "Tanzanie", "Keňa", "Réunion", "Filipíny", "Kambodža", "Nepál",
    "Peru", "Japonsko", "Jihoafrická republika", "Madagaskar", "Namibie",
)
COUNTRY_ALIASES = {"sae": "Spojené arabské emiráty", "emiraty": "Spojené arabské emiráty", "bali": "Indonésie", "dominikana": "Dominikánská republika"}
# Departure cities and their airports.
AIRPORTS = {"praha": "PRG", "brno": "BRQ", "ostrava": "OSR", "pardubice": "PED", "viden": "VIE", "bratislava": "BTS", "budapest": "BUD", "katovice": "KTW", "krakov": "KRK", "wroclaw": "WRO"}
# Words of titles that don't tell hotels apart.
STOPWORDS = ("hotel", "resort", "spa", "aparthotel", "apartments", "wellness", "and")


def strip(text: Column) -> Column:
    """Lower case without accents; letters that don't decompose (ł, ø, ß) stay."""
    return F.regexp_replace(F.translate(F.lower(text), "".join(_COMPOSED), _BASES), "[\\u0300-\\u036f]", "")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]), key)


def _first_fit(text: Column, rules: list[tuple[Column, str]]) -> Column:
    out = F.lit("unknown")
    for fits, value in reversed(rules):
        out = F.when(fits, value).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(out)


def board(text: Column) -> Column:
    """AI, FB, HB, BB, none or unknown, by what the text says first in this order."""
    s = strip(text)
    return _first_fit(text, [(s.contains("all") & s.contains("inclusive"), "AI"), (s.contains("plna penze") | (s == "fb"), "FB"), (s.contains("polopenze") | (s == "hb"), "HB"), (s.contains("snidan") | (s == "bb"), "BB"), (s.contains("bez strav"), "none")])


def transport(text: Column) -> Column:
    """Flight, own, bus or unknown."""
    s = strip(text)
    return _first_fit(text, [(s.contains("letec") | s.contains("flight"), "flight"), (s.contains("vlastni") | s.contains("own"), "own"), (s.contains("autobus") | s.contains("bus"), "bus")])


def _country_part(text: Column) -> Column:
    return F.nullif(F.trim(F.get(F.split(text, "[/,–-]"), F.lit(0))), F.lit(""))


def known_country(text: Column) -> Column:
    """P4 strictly: the canonical country that the text before the first separator names, else null."""
    return _lookup({_plain(c): c for c in COUNTRIES} | COUNTRY_ALIASES, strip(_country_part(text)))


def country(text: Column) -> Column:
    """As :func:`known_country`, but an unknown name stays as it came."""
    return F.coalesce(known_country(text), _country_part(text))


def is_known_country(text: Column) -> Column:
    """P5."""
    return known_country(text).isNotNull()


def czk(text: Column) -> Column:
    """First run of three digits or more, blanks of every kind dropped; null if none or zero."""
    n = F.nullif(F.regexp_extract(F.regexp_replace(text, r"(?U)\s", ""), r"(\d{3,})", 1), F.lit("")).try_cast("int")
    return F.when(n > 0, n)


def cz_date(text: Column) -> Column:
    """An ISO date in the text, else d.m.yyyy, as ISO text; the calendar isn't asked."""
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    d, m, y = (F.regexp_extract(text, r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})", i) for i in (1, 2, 3))
    return F.when(iso != "", iso).when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))


def key_hash(*parts: Column) -> Column:
    """First 16 digits of the SHA-1 of the parts between bars, null as nothing."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def hotel_name(title: Column) -> Column:
    """Words of the title without accents, signs and stop words."""
    words = F.split(F.regexp_replace(strip(title), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)), " ")


def airport(text: Column) -> Column:
    """P10: three letters as they are, a known city by its airport, else null."""
    t = F.trim(text)
    return F.when(t.rlike("^[a-zA-Z]{3}$"), F.upper(t)).otherwise(_lookup(AIRPORTS, strip(t)))


def match_key(title: Column, country_: Column, departure: Column, nights: Column, board_: Column, airport_: Column) -> Column:
    """Identity of a term across sources; null where date, country, board or name is missing."""
    name = hotel_name(title)
    open_ = departure.isNull() | country_.isNull() | (F.coalesce(board_, F.lit("unknown")) == "unknown") | (name == "")
    return F.when(~open_, key_hash(name, country_, F.date_format(departure, "yyyy-MM-dd"), nights, board_, F.coalesce(airport(airport_), F.lit("*"))))


def hotel_key(title: Column, country_: Column) -> Column:
    """Identity of a hotel across terms and sources; null where country or name is missing."""
    name = hotel_name(title)
    return F.when(country_.isNotNull() & (name != ""), key_hash(name, country_))


def is_placeholder(title: Column) -> Column:
    """A title that is only "Hotel" and a number."""
    return title.rlike(r"^Hotel\s+\d+$")


def nights_band(nights: Column) -> Column:
    """0 to 5, 6 to 8, 9 to 12, 13 and more; null and negative have none."""
    return F.when(nights < 0, None).when(nights <= 5, "0-5").when(nights <= 8, "6-8").when(nights <= 12, "9-12").when(nights >= 13, "13+")


def month_of(day: Column) -> Column:
    """Yyyy-MM."""
    return F.date_format(day, "yyyy-MM")


def half_up(x: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(x + F.lit(0.5))


def per_night(price: Column, nights: Column) -> Column:
    """Price of a night, halves up; null below one night."""
    return F.when(nights >= 1, half_up(price / nights).cast("int"))


def first_of_range(text: Column) -> Column:
    """P20: start of "d. m. – d. m. yyyy" as a date; a start in a later month than the end is in the year before."""
    p = r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})?\s*[–-]\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"
    d1, m1, y1, m2, y2 = (F.regexp_extract(text, p, i).try_cast("int") for i in (1, 2, 3, 5, 6))
    year = F.coalesce(y1, F.when(m1 > m2, y2 - 1).otherwise(y2))
    return F.when(year.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year, m1, d1), "yyyy-MM-dd"))


def title_of_slug(slug: Column) -> Column:
    """P22."""
    return F.initcap(F.translate(slug, "-", " "))


def compact_date(text: Column) -> Column:
    """yyyyMMdd as a date."""
    return F.try_to_date(text, "yyyyMMdd")


def nights_between(first: Column, last: Column, days: Column) -> Column:
    """Nights between two days written as yyyyMMdd, else days less one; null if none is left."""
    n = F.coalesce(F.datediff(compact_date(last), compact_date(first)), days - 1)
    return F.when(n > 0, n.cast("int"))


#: Fixed value: how a label writes a day and a month.
LABEL_DAY = r"(\d{1,2})\.\s*(\d{1,2})\."


def trip_of_label(text: Column, now: Column) -> tuple[Column, Column]:
    """Departure and nights of a label with two "d. m." and no year.

    A month before that of ``now`` lies in the next year; an end in an earlier month than the start in the year after
    it. Both are null where the label has fewer than two days, and nights where the end isn't after the start.
    """
    days, months = (F.regexp_extract_all(text, F.lit(LABEL_DAY), F.lit(k)) for k in (1, 2))
    d1, d2, m1, m2 = (F.get(x, F.lit(k)).try_cast("int") for x in (days, months) for k in (0, 1))
    year = F.year(prague_day(now)) + F.when(m1 < F.month(prague_day(now)), 1).otherwise(0)
    date = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    start, end = date(year, m1, d1), date(year + F.when(m2 < m1, 1).otherwise(0), m2, d2)
    both = F.size(days) >= 2
    return F.when(both, start), F.when(both & (end > start), F.datediff(end, start))


def country_in_text(text: Column) -> Column:
    """The first country that a text names, in phrases of three words down to one; null if none."""
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    phrases = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda n: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " ")))))
    return F.get(F.filter(F.transform(phrases, lambda p: known_country(p)), lambda c: c.isNotNull()), F.lit(0))


def query_parameter(url: Column, name: str) -> Column:
    """P25: a parameter of a URL's query, decoded; null where it lacks or the URL is none."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def clean_space(text: Column) -> Column:
    """Blanks of every kind, also of no width, as single plain ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\u200b\\u200c\\u200d\\ufeff]", ""), r"(?U)\s+", " "))


def absolute_url(url: Column, base: str) -> Column:
    """P25: without fragment; a path gets ``base`` in front."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike("^https?://"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(bare, "^/+", "")))


def unescape(text: Column) -> Column:
    """The six common entities."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape(text: Column) -> Column:
    """Five characters for HTML, the ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def grouped_thousands(n: Column, blank: str = " ") -> Column:
    """Whole number with ``blank`` between thousands."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(blank))


def prague_day(at: Column, zone: str = "Europe/Prague") -> Column:
    """Calendar day there."""
    return F.to_date(F.from_utc_timestamp(at, zone))
