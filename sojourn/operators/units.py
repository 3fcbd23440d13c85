"""Quantities in different units brought to common ones: number and unit out of text, alias and factor by join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How units of money are written, the currency they belong to and the factor to its main unit.
UNIT_ALIASES = [
    ("kč", "CZK", "1"), ("czk", "CZK", "1"), ("kc", "CZK", "1"), ("korun", "CZK", "1"),
    ("tis. kč", "CZK", "1000"), ("tis. czk", "CZK", "1000"), ("tisíc kč", "CZK", "1000"),
    ("hal.", "CZK", "0.01"), ("hal", "CZK", "0.01"), ("haléřů", "CZK", "0.01"),
    ("eur", "EUR", "1"), ("€", "EUR", "1"), ("usd", "USD", "1"), ("$", "USD", "1"), ("gbp", "GBP", "1"), ("£", "GBP", "1"),
    ("pln", "PLN", "1"), ("zł", "PLN", "1"), ("huf", "HUF", "1"), ("ft", "HUF", "1"),
]
# Counts written as words.
COUNT_WORDS = {
    "jeden": 1, "jedna": 1, "jedno": 1, "dva": 2, "dvě": 2, "tři": 3, "čtyři": 4, "pět": 5, "šest": 6, "sedm": 7, "osm": 8,
}

#: Width of a step of the logarithm of a quotient.
STEP = 0.1
_SPACE = r"(?U)\s+"
#: The longest spelling first, so that "tis. kč" isn't read as "kč"; letters must not go on before or after.
_UNIT = "(?<![\\p{L}])(" + "|".join(sorted((a.replace(".", r"\.").replace("$", r"\$") for a, _, _ in UNIT_ALIASES), key=lambda a: -len(a))) + ")(?![\\p{L}])"
_AMOUNT = r"\d(?:[\d .,]*\d)?"


def unit_table(spark: SparkSession) -> DataFrame:
    """``(alias, currency, factor)``; as long as the constant above."""
    return spark.createDataFrame(UNIT_ALIASES, "alias string, currency string, factor string").withColumn("factor", F.col("factor").cast("decimal(12,4)"))


def money_units(spark: SparkSession, rates: DataFrame) -> DataFrame:
    """``(alias, factor, offset)`` of money in crowns; ``rates`` has ``currency, units, czk`` (so many units cost so much)."""
    rate = (F.col("czk").cast("decimal(18,6)") / F.col("units").cast("decimal(10,0)")).cast("decimal(20,8)")
    known = unit_table(spark).join(rates.select("currency", rate.alias("rate")), "currency")
    return known.select("alias", (F.col("factor") * F.col("rate")).cast("decimal(20,8)").alias("factor"), F.lit(0).cast("decimal(20,8)").alias("offset"))


def tidy(text: Column) -> Column:
    """Lower case, each run of white space one plain space."""
    return F.trim(F.regexp_replace(F.lower(text.cast("string")), _SPACE, " "))


def number_in(text: Column, signed: bool = False) -> Column:
    """First number of a tidy text as decimal(18,4), or null; with its sign only if ``signed``.

    Point or comma: of two kinds the later is the decimal sign; one kind that occurs more than once, or once before
    exactly three last digits, separates thousands; otherwise it is the decimal sign. Blanks separate thousands.
    """
    raw = F.replace(F.regexp_extract(text, (r"[-−]? ?" if signed else "") + _AMOUNT, 0), F.lit(" "), F.lit(""))
    below = raw.rlike("^[-−]")
    raw = F.regexp_replace(raw, "^[-−]", "") if signed else raw
    point, comma = F.instr(raw, ".") > 0, F.instr(raw, ",") > 0
    both = F.when(point & comma & raw.rlike(r"\.[^,]*$"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.translate(F.replace(raw, F.lit("."), F.lit("")), ",", "."))
    one = F.when(raw.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(raw, "[.,]", "")).otherwise(F.translate(raw, ",", "."))
    number = F.when(point & comma, both).otherwise(one).try_cast("decimal(18,4)")
    return F.when(below, -number).otherwise(number) if signed else number


def people_in(text: Column) -> Column:
    """Number of persons a text names, children included ("2+1", "3 ADT 1 CHD", "dva dospělí a dítě"), or null."""
    clean = tidy(text)
    figures = F.regexp_extract_all(clean, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    from_figures = F.aggregate(figures, F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    words = F.create_map(*[x for k, v in COUNT_WORDS.items() for x in (F.lit(k), F.lit(v))])
    tokens = F.split(clean, r"[^\p{L}]+")
    from_words = F.aggregate(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(words, w), F.lit(0))), F.lit(0), lambda a, x: a + x)
    child = F.when(clean.rlike(r"(^| )a dítě"), 1).otherwise(0)
    whole = F.when(F.size(figures) > 0, from_figures.cast("int")).otherwise(from_words + F.when(from_words > 0, child).otherwise(0))
    return F.when(whole > 0, whole)


def nights_in(text: Column) -> Column:
    """Nights a text names: "7", "7N", "7 nocí", "8 dní" (one less), "8 dní / 7 nocí", "2 týdny"; or null."""
    clean = tidy(text)

    def n(pattern: str) -> Column:
        return F.regexp_extract(clean, pattern, 1).try_cast("int")

    found = F.coalesce(n(r"(\d+) ?(?:n(?:oc\p{L}*|ight\p{L}*)?)(?!\p{L})"), n(r"(\d+) ?(?:dn\p{L}|dní|days?)") - 1, n(r"(\d+) ?(?:týd\p{L}+|weeks?)") * 7, n(r"^(\d+)(?:\.0+)?$"))
    return F.when(found > 0, found)


def in_base_unit(df: DataFrame, text: str, units: DataFrame, default_unit: str, unit_field: str | None = None, pattern: str = _UNIT, signed: bool = False) -> DataFrame:
    """``df`` plus ``amount``: the quantity of ``text`` in the base unit, decimal(38,10), or null if unreadable.

    ``units`` has ``alias, factor, offset`` (decimals): an amount is the number times the factor plus the offset. The
    unit is the one in the field ``unit_field`` if that names a known one, else the first in the text that ``pattern``
    finds (a known alias or none: then null), else ``default_unit``. Aliases are joined, so the table of units may be
    of any size; Spark broadcasts it by its size. ``units`` must name an alias once. Without ``signed`` an amount of
    zero is none (a price of zero is no price) and signs are not read. An ``amount`` column of ``df`` is replaced.
    """
    clean = tidy(df[text])
    written = F.regexp_extract(F.regexp_replace(clean, _AMOUNT, " "), pattern, 1)
    if pattern is _UNIT:
        written = F.when(F.regexp_extract(clean, "tis\\. ?(kč|czk)", 0) != "", F.lit("tis. kč")).otherwise(written)
    base = df.drop("amount").withColumn("__n", number_in(clean, signed)).withColumn("__unit", F.coalesce(F.nullif(written, F.lit("")), F.lit(default_unit)))
    known = lambda k: units.select(F.col("alias").alias(f"__unit{k}"), F.col("factor").alias(f"__factor{k}"), F.col("offset").alias(f"__offset{k}"))
    out = base.join(known(""), "__unit", "left")
    factor, offset = F.col("__factor"), F.col("__offset")
    if unit_field:
        out = out.withColumn("__unit_f", tidy(F.col(unit_field))).join(known("_f"), "__unit_f", "left")
        factor, offset = F.coalesce("__factor_f", factor), F.when(F.col("__factor_f").isNotNull(), F.col("__offset_f")).otherwise(offset)
    amount = (F.col("__n") * factor).cast("decimal(38,10)") + offset
    out = out.withColumn("amount", F.when(F.lit(signed) | (F.col("__n") > 0), amount.cast("decimal(38,10)")))
    return out.select(*[c for c in df.columns if c != "amount"], "amount")


def to_common(df: DataFrame, text: str, rates: DataFrame, default_unit: str, unit_field: str | None = None) -> DataFrame:
    """:func:`in_base_unit` for money, in crowns by ``rates`` (``currency, units, czk``)."""
    return in_base_unit(df, text, money_units(df.sparkSession, rates), default_unit, unit_field)


def per_person_for_stay(amount: Column, text: Column, persons: Column, nights: Column, unit_is_person: bool) -> Column:
    """Whole base-currency units for one person and the whole stay, rounded half up, or null where it stays open.

    What the text says goes first: a party's size in it ("za 2 os."), "per person", "per night"; a bare amount is per
    person or for the party as ``unit_is_person`` says, the party being ``persons``.
    """
    clean = tidy(text)
    party = F.regexp_extract(clean, r"(?:za|pro|\() ?(\d+) ?os(?:ob|\.|oby)?", 1).try_cast("int")
    by_night = clean.rlike(r"noc|night")
    total = clean.rlike("celkem")
    by_person = clean.rlike(r"(?:/ ?os|(?:za|na) osobu|per person)") | (by_night & ~total)
    heads = F.when(party.isNotNull(), party).when(by_person, 1).when(F.lit(unit_is_person) & ~total, 1).otherwise(persons)
    times = F.when(by_night, nights).otherwise(1)
    each = (amount * times).cast("decimal(30,8)") / F.when(heads > 0, heads).cast("decimal(10,0)")
    return F.floor(each + F.lit("0.5").cast("decimal(2,1)")).cast("long")


def totals_in_other_units(df: DataFrame, total: str, each: str, rates: DataFrame, most: int = 4) -> DataFrame:
    """Rows whose ``total`` isn't ``each`` times 1..``most`` in the base unit but is in another one, plus ``amount``.

    ``amount`` is the total in the base unit. Nothing says the unit but the figures themselves: the units of money are
    joined on their quotient. Its logarithm falls into a step of ``STEP``; a unit stands, with each multiple, under every step that
    rounding to whole units can lead to (a total of 1 may stand for 0.5 to 1.5), so the join finds all that fit. Of these
    the unit and the multiple count whose rounded value lies nearest (at most half a unit off; ties: the smaller
    multiple). Null, zero or negative figures and totals that fit no unit give no row; repeated rows their row each.
    """
    units = money_units(df.sparkSession, rates)
    factors = units.filter("offset = 0").select(F.col("factor").cast("double").alias("f")).distinct().filter("abs(f - 1) > 1e-9")
    ways = factors.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    at = F.floor(F.log(F.col("k") / F.col("f")) / STEP).cast("int")
    reach = math.ceil(math.log(2) / STEP) + 1
    ways = ways.withColumn("__step", F.explode(F.sequence(at - reach, at + reach))).groupBy("__step").agg(F.collect_list(F.struct("f", "k")).alias("__ways"))
    n, t = df[each].cast("long"), df[total].cast("long")
    odd = df.filter((n > 0) & (t > 0) & ~((t % n == 0) & (t / n <= most)))
    odd = odd.withColumn("__step", F.floor(F.log(F.col(total).cast("double") / F.col(each)) / STEP).cast("int")).join(ways, "__step")
    best = F.array_min(F.transform("__ways", lambda w: F.struct(F.abs(F.col(total) - F.col(each) * w["k"] / w["f"]).alias("off"), w["k"].alias("k"))))
    fits = odd.withColumn("__best", best).filter("__best.off <= 0.5 + 1e-6")
    return fits.select(*[c for c in df.columns if c != "amount"], (F.col("__best.k") * F.col(each)).cast("long").alias("amount"))
