"""What the review of round 1 found to be cut."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from sojourn.llm import languages, leakage, matching
from sojourn.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
tables_here = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


@tables_here
def test_mixture_is_dealt(spark, monkeypatch):
    from sojourn.llm import mixing

    trees = []
    split = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: trees.append(split(*a)) or trees[-1])
    rows = Q.p9_mixture(spark, SMALL).collect()
    assert len(trees[0]) == 16 and len({tuple(x) for x in trees[0]}) > 1
    sizes = trees[0].sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.position)
    assert len(places) > 8 and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_day_and_night_off(spark):
    day = dt.date(2026, 10, 28)
    rows = [(1, "a", "Mozhesrhu Pearl", "Monte Limafe", day, 13), (2, "b", "MozhesrhuPearl", "Monte Límáfe", day + dt.timedelta(1), 14), (3, "c", "Mozhesrhu Perl", "Sidi Stalina", day - dt.timedelta(1), 12)]
    df = spark.createDataFrame(rows, "id long, source string, title string, locality string, departure_date date, nights int")
    assert [(r.id_a, r.id_b) for r in matching.match_stays(df).filter("belief >= 0.5").collect()] == [(1, 2)]


@pytest.mark.parametrize("attribute", ['href="https://x.example/?' + "utm=letovisko&" * 40 + '"', "style='" + "margin: 0 auto; " * 40 + "'", "data-x=" + "y" * 500, 'class="a" ' * 60])
def test_long_tags_are_markup(attribute):
    assert leakage.plain([f"one <a {attribute}>two</a> three"])[0].split() == ["one", "two", "three"]
    assert leakage.plain([f"one<div {attribute}>two"])[0].split() == ["one", "two"]
    assert languages.sentences(f"Jedna <a {attribute}>dva</a> tři.")[0].split() == ["Jedna", "dva", "tři."]


def test_stray_brackets_keep_their_text():
    words = "price <b and then " + "many words " * 40 + "> end"
    assert leakage.plain([words])[0].split().count("many") == 40
    assert languages.sentences(words)[0].split().count("many") == 40
    long = "<a x=" * 200_000 + "<!-- " * 200_000
    assert leakage.plain([long]) and languages.sentences(long)  # linear
