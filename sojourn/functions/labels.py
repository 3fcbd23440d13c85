"""Texts that people read: percentages, references, terms and the like, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.functions import normalize as N

# Labels of boards and references, and what stands where nothing is known.
BOARD_LABELS = {"AI": "All inclusive", "UAI": "Ultra all inclusive", "FB": "Plná penze", "HB": "Polopenze", "BB": "Snídaně", "none": "Bez stravy", "unknown": "—"}
REFERENCE_LABELS = {"own": "30denní medián", "omnibus": "Omnibus 30denní min.", "hotel": "tento hotel"}
MINUS, DASH = "−", "—"


def _choice(value: Column, labels: dict[str, str], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, label in labels.items():
        out = out.when(value == name, label)
    return out.otherwise(otherwise)


def saving(pct: Column, zero_is_saving: bool) -> Column:
    """A saving with a minus, a rise with a plus; 0 is "−0 %" in messages (``zero_is_saving``) and "+0 %" on the page."""
    falls = pct >= 0 if zero_is_saving else pct > 0
    return F.concat(F.when(falls, MINUS).otherwise("+"), F.abs(pct).cast("string"), F.lit(" %"))


def reference_label(reference: Column, locality: Column, country: Column) -> Column:
    """What a discount is measured against; place names where they are known; null without a reference."""
    named = F.when(reference == "locality", F.coalesce(locality, F.lit("lokalita"))).when(reference == "market", F.coalesce(country, F.lit("trh")))
    return _choice(reference, REFERENCE_LABELS, named)


def tone(pct: Column) -> Column:
    """None, up (0 and below), mid, good (15 and above)."""
    return F.when(pct.isNull(), "none").when(pct <= 0, "up").when(pct >= 15, "good").otherwise("mid")


def term_range(day: Column, nights: Column, now: Column) -> Column:
    """X11: "08.07 – 15.07", with the year where it isn't the present one; the start alone without nights."""
    start, end = F.date_format(day, "dd.MM"), F.date_format(F.date_add(day, nights), "dd.MM")
    year = F.when(F.year(day) != F.year(now), F.concat(F.lit(" "), F.year(day).cast("string"))).otherwise("")
    return F.when(day.isNull(), "volný termín").when(nights.isNull(), F.concat(start, year)).otherwise(F.concat(start, F.lit(" – "), end, year))


def nights_label(nights: Column) -> Column:
    """X11: Czech plural of nights, nothing for null."""
    return F.when(nights.isNull(), "").otherwise(F.concat(nights.cast("string"), F.when(nights == 1, " noc").when(nights.between(2, 4), " noci").otherwise(" nocí")))


def board_label(board: Column) -> Column:
    """X11: boards by name; unknown codes as they are."""
    return F.when(board.isNull() | (board == ""), DASH).otherwise(_choice(board, BOARD_LABELS, board))


def departure_label(airport: Column, transport: Column) -> Column:
    """X11: the airport in capitals, else how else one gets there."""
    return F.when(F.trim(airport) != "", F.upper(airport)).when(transport == "own", "vlastní").when(transport == "bus", "bus").otherwise(DASH)


def sparkline_points(prices: Column, width: float = 64, height: float = 22, pad: float = 3) -> Column:
    """X10: "x,y x,y ..." of prices scaled to a box, to one decimal; a dearer price is higher, equal ones lie in the
    middle, a single one at the right. Null for no price."""
    n, least, most = F.size(prices), F.array_min(prices), F.array_max(prices)

    def number(v: Column) -> Column:
        tenth = N.half_up(v * 10)
        whole = F.floor(tenth / 10)
        return F.concat(whole.cast("string"), F.when(tenth % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenth - whole * 10).cast("string"))))

    def point(price: Column, i: Column) -> Column:
        x = F.when(n == 1, F.lit(width - pad)).otherwise(pad + i / (n - 1) * (width - 2 * pad))
        y = F.when(most == least, F.lit(height / 2)).otherwise(pad + (1 - (price - least) / (most - least)) * (height - 2 * pad))
        return F.concat(number(x), F.lit(","), number(y))

    return F.when(n > 0, F.array_join(F.transform(prices, point), " "))
