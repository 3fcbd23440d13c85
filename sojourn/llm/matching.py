"""Matching stays across sources without keys: blocking, similarity, and loopy belief propagation over the candidates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.session import cut, release

# Fixed values for words that too few rows have to tell by :func:`word_roles`: words of titles that don't tell hotels
# apart, and last words by which the hotels of one family differ.
NOISE_WORDS = ("hotel", "aparthotel", "the", "resort", "spa", "premium", "all", "inclusive", "adults", "only")
SIBLINGS = ("annex", "ii", "iii", "villas", "junior", "select")
#: Share of the rows, and number of rows, from which on a word's role is taken from the data.
COMMON, ENOUGH = 0.002, 200
_MARKS = "".join(chr(c) for c in range(0x0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] != chr(c))
_BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKS)

#: Log-odds of a match by how two values compare; their sum with ``PRIOR`` is what belief propagation starts from. Names
#: weigh most; a day or a night off is what sources do, so each costs little, but both at once need all else equal.
LEVELS = {
    "name": {"same": 5.0, "close": 3.5, "cut": 2.5, "far": 1.0, "unknown": -2.5},
    "place": {"same": 2.0, "close": 1.5, "unknown": 0.0, "other": -5.0},
    "term": {"same": 2.0, "night unknown": 1.0, "near": 0.0, "near, night unknown": -1.0, "both near": -4.2},
}
PRIOR = -2.5


def bare(text: Column) -> Column:
    """Lower case without accents (composed or not), entities and runs of white space; null stays null."""
    text = F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), "[\\u0300-\\u036f]+", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(text, _MARKS, _BARE)), r"(?U)\s+", " "))


def _features(df: DataFrame, key: str, source: str, title: str, place: str, date: str, nights: str) -> DataFrame:
    """``(id, source, words, cut, place, date, nights)`` of rows with a date; ``words`` are all words of the name."""
    t = F.coalesce(bare(df[title]), F.lit(""))
    placeholder = t.rlike(r"^hotel \d+$")
    t = F.regexp_replace(t, r"\(ex\.? [^)]*\)?|[★*]+| by [a-z]+$|\b[1-5] ?\*", " ")
    # "Place - TITLE" and "Title, place" carry the place as well.
    before = F.regexp_extract(t, r"^(.*\S) - \S", 1)
    after = F.regexp_extract(t, r"\S, (\S.*)$", 1)
    name = F.regexp_replace(F.regexp_replace(t, r"^.*\S - (?=\S)", ""), r", \S.*$", "")
    clipped = name.rlike(r"(…|\.)(\s|$)")
    words = F.filter(F.split(F.regexp_replace(name, r"[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.rlike(r"^\d$"))
    where = F.coalesce(bare(df[place]), F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))
    where = F.trim(F.regexp_replace(F.regexp_replace(where, r"^.* / ", ""), r"\(letovisko\)", ""))
    return df.filter(df[date].isNotNull()).select(
        df[key].alias("id"), df[source].alias("source"), F.when(placeholder, F.array().cast("array<string>")).otherwise(words).alias("words"),
        clipped.alias("cut"), F.nullif(F.regexp_replace(where, r"[^a-z0-9 ]+", " "), F.lit("")).alias("place"), df[date].alias("date"), df[nights].alias("nights"),
    )


def word_roles(rows: DataFrame) -> tuple[list[str], list[str]]:
    """``(noise, siblings)``: words that don't tell hotels apart, and last words that tell the hotels of a family apart.

    Told for words that ``COMMON`` of the rows and ``ENOUGH`` rows have, so at most some hundred times a name's words
    reach the driver. A source writes noise in its own manner, so rows with it hardly ever have a row of another source
    with the same words at the same place, day and nights; a word is noise if that is less than a quarter as frequent
    as among all rows. A last word is a sibling's if what is left without it is mostly a name at the same place itself.
    Rarer words have the roles of ``NOISE_WORDS`` and ``SIBLINGS``.
    """
    spot = F.element_at(F.split("place", " "), -1)
    keyed = rows.select("source", F.array_distinct("words").alias("words"), F.get("words", F.size("words") - 1).alias("last"), F.xxhash64(F.array_sort("words")).alias("name"), spot.alias("spot"), F.col("date"), F.col("nights"))
    keyed = keyed.filter(F.size("words") > 0)
    stays = keyed.groupBy("name", "spot", "date", "nights").agg((F.min("source") != F.max("source")).cast("int").alias("met"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    each = stays.select("n", "met", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("met")).alias("met"))
    total, met = stays.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("met")), F.lit(0))).first()
    least = max(ENOUGH, COMMON * total)
    common = {r["word"]: r for r in each.filter(F.col("n") >= least).collect()}
    noise = [w for w, r in common.items() if r["met"] * total * 4 < met * r["n"]] if met >= ENOUGH else []
    judged = set(common) if met >= ENOUGH else set()
    noise += [w for w in NOISE_WORDS if w not in judged]
    clean = rows.select(F.filter("words", lambda w: ~w.isin(*noise)).alias("words"), spot.alias("spot")).filter(F.size("words") > 0)
    names = clean.select(F.xxhash64(F.array_sort("words")).alias("name"), "spot").distinct()
    cut_off = clean.filter(F.size("words") > 1).select(F.get("words", F.size("words") - 1).alias("last"), F.xxhash64(F.array_sort(F.slice("words", 1, F.size("words") - 1))).alias("name"), "spot")
    known = names.withColumn("known", F.lit(1)).hint("shuffle_merge")
    lasts = cut_off.join(known, ["name", "spot"], "left").groupBy("last").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))
    told = lasts.filter(F.col("n") >= least).collect()
    siblings = [r["last"] for r in told if 2 * r["known"] >= r["n"]]
    return noise, siblings + [w for w in SIBLINGS if w not in {r["last"] for r in told}]


def _candidates(rows: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, each once: rows whose days and nights are compatible and that share a block.

    Blocks are (start of a name word, day) where the word comes first in one of the two names, (start of a name word,
    start of the place's last word, day), (end of a name word, start of the place's last word, day), (end of a name word, start of another, day), and (place, day) between names
    that aren't known and those that are. Days next to each other meet because one side stands in three days' blocks. Blocks are joined, not gathered, so that a large one is split over tasks.
    """
    first = F.substring(F.get("words", F.lit(0)), 1, 4)
    starts = F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, 4)))
    spot = F.substring(F.element_at(F.split("place", " "), -1), 1, 4)
    near = F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 1))
    nothing = F.array().cast("array<string>")
    # The end of one word with the start of another: a slip in the first letters leaves these.
    ends = F.transform("words", lambda w: F.right(w, F.lit(4)))
    crossed = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda j: F.when(i != j, F.concat(F.lit("d"), F.get(ends, i), F.lit("|"), F.substring(F.get("words", j), 1, 4))))))
    crossed = F.when(F.size("words") > 1, F.array_compact(crossed)).otherwise(nothing)
    placed = F.when(F.col("place").isNotNull(), F.concat(F.transform(starts, lambda s: F.concat(F.lit("b"), s, F.lit("|"), spot)), F.transform(F.array_distinct(ends), lambda s: F.concat(F.lit("e"), s, F.lit("|"), spot)))).otherwise(nothing)
    # A row without a name meets every row of its place, so those emit the place's block only if the other side lacks it.
    lone = F.when(F.col("place").isNotNull(), F.array(F.concat(F.lit("c"), F.coalesce(F.col("place"), F.lit(""))))).otherwise(nothing)
    unnamed = F.size("words") == 0
    slim = ("id", "date", "nights")
    left = rows.select(*slim, F.explode(F.when(unnamed, lone).otherwise(F.array_distinct(F.concat(F.transform(starts, lambda s: F.concat(F.lit("a"), s)), placed, crossed)))).alias("block"))
    right = rows.select(*slim, F.explode(F.array_distinct(F.concat(F.when(unnamed, nothing).otherwise(F.array(F.concat(F.lit("a"), first))), placed, crossed, F.when(unnamed, nothing).otherwise(lone)))).alias("block")).withColumn("date", F.explode(near))
    # Only ids, days, nights and a fingerprint of the block are shuffled; a collision adds a pair that scoring throws out.
    a, b = (side.select(F.col("id").alias(f"id_{k}"), F.col("nights").alias(f"nights_{k}"), F.xxhash64("block", "date").alias("block")) for side, k in ((left, "a"), (right, "b")))
    met = a.join(b.hint("shuffle_merge"), "block").filter("id_a <> id_b")
    met = met.filter(F.coalesce(F.abs(F.col("nights_a") - F.col("nights_b")) <= 1, F.lit(True)))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbours may swap), or most + 1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _word(a: str, b: str, cut_a: bool, cut_b: bool) -> int:
    """0 same, 1 an abbreviation or cut, 2 a slip of the pen, 3 two slips, 9 another word."""
    if a == b:
        return 0
    short, long = sorted((a, b), key=len)
    clipped = cut_a if short is a else cut_b  # only the shorter one can be what is left of the other
    if clipped and len(short) >= 1 and long.startswith(short):
        return 1
    if 2 <= len(short) <= 4 and len(long) - len(short) >= 2 and _abbreviates(short, long):
        return 1
    if (cut_a or cut_b) and len(short) >= 1 and len(short) <= 4 and short[0] == long[0] and len(long) <= 4:
        return 1  # both short for the same word, one of them cut
    if len(short) >= 4 and edits(a, b, 1) <= 1:
        return 2
    if len(short) >= 6 and edits(a, b, 2) <= 2:
        return 3
    return 9


def _abbreviates(short: str, long: str) -> bool:
    """Same first letter and the consonants of ``short`` in order, as in "bch", "vlg" or "gdn"."""
    if short[0] != long[0] or any(c in "aeiou" for c in short[1:]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def compare_names(a: list[str], b: list[str], cut_a: bool, cut_b: bool, siblings: tuple[str, ...] = SIBLINGS) -> str:
    """``same``, ``close``, ``cut``, ``far``, ``other`` or ``unknown``; every word must find its partner, in any order."""
    if not a or not b:
        return "unknown"
    if sorted(a) == sorted(b) or "".join(a) == "".join(b):
        return "same"
    if len(a) == len(b):
        for other in (b, b[1:] + b[:1], b[-1:] + b[:-1]):
            kinds = [_word(x, y, cut_a, cut_b) for x, y in zip(a, other, strict=True)]
            if 9 not in kinds:
                return "far" if 3 in kinds else "cut" if 1 in kinds else "close"
        return "other"
    if len(a) == 1 or len(b) == 1:  # run together, perhaps with a slip
        x, y = "".join(a), "".join(b)
        short, long, was = (x, y, cut_a) if len(x) < len(y) else (y, x, cut_b)
        if was and len(short) >= 5 and long.startswith(short) and not long.endswith(siblings):
            return "cut"
        if x.startswith(y) or y.startswith(x):
            return "other"
        slips = edits(x, y, 2) if min(len(x), len(y)) >= 6 else 9
        if slips <= 2:
            return "close" if slips < 2 else "far"
        if len(b) == 2 and "".join(b[::-1]) == x or len(a) == 2 and "".join(a[::-1]) == y:
            return "close"
    return "other"


def compare_places(a: str | None, b: str | None) -> str:
    """``same`` (also the end of the other), ``close`` (a slip), ``other`` or ``unknown``."""
    if not a or not b:
        return "unknown"
    x, y = a.split(), b.split()
    if x == y or x[-len(y) :] == y or y[-len(x) :] == x or "".join(x) == "".join(y):
        return "same"
    if min(len("".join(x)), len("".join(y))) >= 6 and edits("".join(x), "".join(y), 2) <= 2:
        return "close"
    n = min(len(x), len(y))
    p, q = "".join(x[-n:]), "".join(y[-n:])
    return "close" if min(len(p), len(q)) >= 4 and edits(p, q, 2) <= 2 else "other"


def _name_levels(siblings: tuple[str, ...]) -> Callable[..., Column]:
    @F.pandas_udf(T.IntegerType())
    def name_level(a: pd.Series, b: pd.Series, cut_a: pd.Series, cut_b: pd.Series) -> pd.Series:
        """Place of the level among those of names, -1 for other names; -2 where the caller knows it (null names)."""
        places = {v: i for i, v in enumerate(LEVELS["name"])} | {"other": -1}
        seen: dict[tuple, int] = {}
        out = []
        for key in zip(a, b, cut_a, cut_b, strict=True):
            if key[0] is None:
                out.append(-2)
                continue
            if key not in seen:  # names recur on many days
                seen[key] = places[compare_names(key[0].split(), key[1].split(), bool(key[2]), bool(key[3]), siblings)]
            out.append(seen[key])
        return pd.Series(out, dtype="int32")

    return name_level


@F.pandas_udf(T.IntegerType())
def _place_level(a: pd.Series, b: pd.Series) -> pd.Series:
    """Place of the level among those of places; -2 where the caller knows it (null places)."""
    places = {v: i for i, v in enumerate(LEVELS["place"])}
    seen: dict[tuple, int] = {}
    out = []
    for key in zip(a, b, strict=True):
        if key[0] is None:
            out.append(-2)
            continue
        if key not in seen:
            seen[key] = places[compare_places(*key)]
        out.append(seen[key])
    return pd.Series(out, dtype="int32")


def _compared(pairs: DataFrame, rows: DataFrame, siblings: tuple[str, ...] = SIBLINGS) -> DataFrame:
    """``(id_a, id_b, source_a, source_b, name, place, term, unnamed, stay)``: levels of each candidate as places among
    ``LEVELS``; pairs of other names are no candidates. Equal names and places are settled without Python."""
    slim = rows.select("id", "source", F.array_join("words", " ").alias("name"), "cut", "place", "date", "nights")
    for k in ("a", "b"):
        pairs = pairs.join(slim.withColumnsRenamed({c: f"{c}_{k}" for c in slim.columns}).hint("shuffle_merge"), f"id_{k}")
    at = {f: {v: i for i, v in enumerate(levels)} for f, levels in LEVELS.items()}
    known = F.when((F.col("name_a") == "") | (F.col("name_b") == ""), at["name"]["unknown"]).when(F.col("name_a") == F.col("name_b"), at["name"]["same"])
    placed = F.when(F.col("place_a").isNull() | F.col("place_b").isNull(), at["place"]["unknown"]).when(F.col("place_a") == F.col("place_b"), at["place"]["same"])
    pairs = pairs.withColumn("known", known).withColumn("placed", placed)
    ask = lambda given, c: F.when(F.col(given).isNull(), F.col(c))
    levels = pairs.withColumn("n", _name_levels(siblings)(ask("known", "name_a"), ask("known", "name_b"), "cut_a", "cut_b")).withColumn("p", _place_level(ask("placed", "place_a"), ask("placed", "place_b")))
    days, gap = F.datediff("date_a", "date_b") != 0, F.abs(F.col("nights_a") - F.col("nights_b"))
    t = at["term"]
    term = F.when(gap.isNull() & ~days, t["night unknown"]).when(gap.isNull(), t["near, night unknown"]).when((gap == 0) & ~days, t["same"]).when((gap > 0) & days, t["both near"]).otherwise(t["near"])
    out = levels.select(
        "id_a", "id_b", "source_a", "source_b", F.coalesce("known", "n").alias("name"), F.coalesce("placed", "p").alias("place"), term.alias("term"),
        F.when(F.col("name_a") == "", F.col("id_a")).when(F.col("name_b") == "", F.col("id_b")).alias("unnamed"), F.when((F.col("name_a") == "") | (F.col("name_b") == ""), F.substring(F.concat("name_a", "name_b"), 1, 3)).alias("stay"),
    )
    return out.filter("name >= 0")


def _scored(levels: DataFrame) -> DataFrame:
    """``(id_a, id_b, source_a, source_b, u)``: log-odds of each candidate.

    A row whose name isn't known fits every stay of its place and days: each of them gets its share of the odds.
    """
    u = F.lit(PRIOR)
    for field, weights in LEVELS.items():
        u = u + F.get(F.array(*[F.lit(w) for w in weights.values()]), F.col(field))
    scored = levels.withColumn("u", u)
    named, open_ = scored.filter("unnamed is null"), scored.filter("unnamed is not null")
    stays = open_.groupBy("unnamed").agg(F.count_distinct("stay").alias("stays"))
    open_ = open_.join(stays.hint("shuffle_merge"), "unnamed").withColumn("u", F.col("u") - 2 * F.log("stays"))
    columns = ["id_a", "id_b", "source_a", "source_b", "u"]
    return named.select(*columns).unionByName(open_.select(*columns))


def groups_of(links: DataFrame) -> DataFrame:
    """``(id, head)``: the least id of each record's connected group, by handing heads on until none changes."""
    both = cut(links.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionByName(links.select(F.col("id_b").alias("x"), F.col("id_a").alias("y"))))
    heads, held = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("head")), None
    while True:
        near = both.join(heads.select(F.col("x").alias("y"), F.col("head").alias("theirs")).hint("shuffle_merge"), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        after = cut(heads.join(near.hint("shuffle_merge"), "x").select("x", F.least("head", "theirs").alias("head"), (F.col("theirs") < F.col("head")).alias("moved")))
        heads = after.select("x", "head")
        if held is not None:
            release(held)
        held = after
        if after.filter("moved").isEmpty():
            return heads.withColumnRenamed("x", "id")


def propagate(pairs: DataFrame, tolerance: float = 1e-3, most_rounds: int = 300, damping: float = 0.3) -> DataFrame:
    """``(id_a, id_b, belief, converged)`` of ``(id_a, id_b, group_a, group_b, source_a, source_b, u)``: sum-product with one-to-one factors.

    A factor stands for a record and another source: of the records that it could match there, one group at most is
    the true one (copies that a source holds of one stay are one group and don't compete). The message of a factor to
    a pair is minus log(1 + the odds of the other groups); a pair's message to one of its two factors is its log-odds
    plus the other factor's message. Rounds go on until no message moves by ``tolerance``; ``converged`` says whether a
    pair's did, which is false only for pairs that still move after ``most_rounds``. Pairs of factors with one group
    have no rival and are left out of the rounds.

    A round shuffles the pairs by one record and then by the other; the sums of a factor are windows over its record's
    candidates, so no side is ever broadcast. ``STRIDE`` rounds are one job, whose result is written before the next.
    """
    def factors(df: DataFrame, me: str, other: str) -> DataFrame:
        """The messages of the factors of side ``me`` and another source to their pairs, as ``new_me``."""
        of_factor = Window.partitionBy(f"id_{me}", f"source_{other}")
        of_group = Window.partitionBy(f"id_{me}", f"source_{other}", f"group_{other}")
        # Odds that enter this record's factor: the pair's own and what the other side's factor said.
        df = df.repartition(f"id_{me}").withColumn("o", F.exp(F.least(F.col("u") + F.col(f"to_{other}"), F.lit(50.0))))
        df = df.withColumn("o", F.max("o").over(of_group)).withColumn("share", F.col("o") / F.count(F.lit(1)).over(of_group))
        return df.withColumn(f"new_{me}", -F.log1p(F.greatest(F.sum("share").over(of_factor) - F.col("o"), F.lit(0.0)))).drop("o", "share")

    state = pairs.withColumn("to_a", F.lit(0.0)).withColumn("to_b", F.lit(0.0))
    for me, other in (("a", "b"), ("b", "a")):
        of_factor = Window.partitionBy(f"id_{me}", f"source_{other}")
        state = state.repartition(f"id_{me}").withColumn(f"rival_{me}", F.min(f"group_{other}").over(of_factor) != F.max(f"group_{other}").over(of_factor))
    state = cut(state.withColumn("moved", F.lit(0.0)))
    calm = state.filter("not (rival_a or rival_b)")
    moving, held = state.filter("rival_a or rival_b"), None
    for _ in range(0, most_rounds, STRIDE):
        for _ in range(STRIDE):
            after = factors(factors(moving, "a", "b"), "b", "a")
            for me in ("a", "b"):
                after = after.withColumn(f"new_{me}", F.lit(damping) * F.col(f"to_{me}") + F.lit(1 - damping) * F.col(f"new_{me}"))
            after = after.withColumn("moved", F.greatest(F.abs(F.col("new_a") - F.col("to_a")), F.abs(F.col("new_b") - F.col("to_b"))))
            moving = after.drop("to_a", "to_b").withColumnsRenamed({"new_a": "to_a", "new_b": "to_b"})
        moving = cut(moving)
        if held is not None:
            release(held)  # the rounds before aren't needed any more
        held = moving
        moved = moving.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    columns = ["id_a", "id_b", "u", "to_a", "to_b", "moved"]
    belief = 1 / (1 + F.exp(-(F.col("u") + F.col("to_a") + F.col("to_b"))))
    return calm.select(*columns).unionByName(moving.select(*columns)).select("id_a", "id_b", belief.alias("belief"), (F.col("moved") < tolerance).alias("converged"))


#: Rounds of messages between two looks at whether they still move.
STRIDE = 4


def match_stays(df: DataFrame, key: str = "id", source: str = "source", title: str = "title", place: str = "locality", date: str = "departure_date", nights: str = "nights") -> DataFrame:
    """``(id_a, id_b, belief, converged)``, id_a < id_b, of pairs of different sources that may be the same stay.

    Only the four attributes count. A row without a date is in no pair; unknown nights or place are compatible with
    anything but prove nothing, and an unknown name (a placeholder title, or nothing left of it) is held against a
    pair. Names compare word by word: slips of one letter or two, other order, words run together, cut and abbreviated
    words are forgiven, a word more or another word is another hotel and no candidate, but for words that :func:`word_roles`
    finds to be noise. Repeated ids count once; equal
    rows under different ids pair like any others. An empty table gives an empty result.
    """
    raw = cut(_features(df, key, source, title, place, date, nights).dropDuplicates(["id"]))
    noise, siblings = word_roles(raw)
    rows = cut(raw.withColumn("words", F.filter("words", lambda w: ~w.isin(*noise))))
    release(raw)
    compared = cut(_compared(_candidates(rows), rows, tuple(siblings)))
    scored = cut(_scored(compared))
    release(rows)
    release(compared)
    heads = groups_of(scored.filter("source_a = source_b and u > 2"))
    pairs = scored.filter("source_a <> source_b")
    for me in ("a", "b"):
        own = heads.select(F.col("id").alias(f"id_{me}"), F.col("head").alias(f"head_{me}")).hint("shuffle_merge")
        pairs = pairs.join(own, f"id_{me}", "left").withColumn(f"group_{me}", F.coalesce(f"head_{me}", f"id_{me}")).drop(f"head_{me}")
    return propagate(pairs)
