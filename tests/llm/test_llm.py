"""The llm operators on small cases, against brute force, SQL or known answers."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sojourn.llm import languages as L
from sojourn.llm import leakage as K
from sojourn.llm import matching as M
from sojourn.llm import mixing as X
from sojourn.llm import percentiles as P
from sojourn.llm import queries as Q
from sojourn.llm import survivorship as S

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


@here
@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_equal_rows(spark, name):
    from oracle import differences

    assert differences(Q.QUERIES[name](spark, SMALL), Q.ORACLE[name], SMALL) == ""


@here
@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE])
def test_queries_run(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() > 0


# --- p2

OFFERS = "id long, source string, title string, locality string, departure_date date, nights int, belief double"
DAY = dt.date(2026, 7, 1)


def _offers(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], OFFERS)


def _pairs(df):
    return {(r.id_a, r.id_b): r.belief for r in df.collect()}


def test_matching_names_and_families(spark):
    rows = [
        (1, "a", "Vikskágys Coral", "Nea Festany", DAY, 7), (2, "b", "Hotel Vikskagys &amp; Coral 5*", "NEA FESTANY", DAY, 7), (3, "c", "Coral Vikskágys", "Albánie / Nea Festany", DAY + dt.timedelta(days=1), 7),
        (4, "d", "Vikskágys Coral Annex", "Nea Festany", DAY, 7), (5, "e", "VikskágysCoral", None, DAY, None), (6, "f", "Vikskágys Coral", "Nea Festany", DAY, 10), (7, "g", "Vikskágys Coral", "Nea Festany", None, 7),
        (8, "h", "", "", DAY, 7), (9, "i", None, None, DAY, 7), (10, None, "Vikskágys Coral", "Nea Festany", DAY, 7), (11, "j", "x" * 20_000, "y", DAY, 7),
    ]
    found = {k for k, v in _pairs(M.match_stays(_offers(spark, rows))).items() if v >= 0.5}
    assert {(1, 2), (1, 3), (2, 3), (1, 5), (2, 5)} <= found
    assert not any(4 in p or 7 in p or 11 in p for p in found)
    assert (1, 6) not in found


def test_matching_of_nothing_and_one_row(spark):
    assert M.match_stays(_offers(spark, [])).count() == 0
    assert M.match_stays(_offers(spark, [(1, "a", "Vikskágys Coral", "Nea", DAY, 7)] * 2)).count() == 0


def test_propagation_against_enumeration(spark):
    """A record with two rivals in another source: marginals of the one-to-one model, summed over all states."""
    u = {(1, 11): 2.0, (1, 12): 1.0, (2, 12): 1.5}
    rows = [(a, b, a, b, "s", "t", w) for (a, b), w in u.items()]
    pairs = spark.createDataFrame(rows, "id_a long, id_b long, group_a long, group_b long, source_a string, source_b string, u double")
    got = _pairs(M.propagate(pairs))
    total, marginal = 0.0, Counter()
    edges = list(u)
    for state in range(8):
        on = [edges[k] for k in range(3) if state >> k & 1]
        if len({a for a, _ in on}) == len(on) == len({b for _, b in on}):
            weight = np.exp(sum(u[e] for e in on))
            total += weight
            marginal.update({e: weight for e in on})
    for e in edges:  # a tree: belief propagation is exact
        assert got[e] == pytest.approx(marginal[e] / total, abs=2e-3)


def test_propagation_on_a_loop_says_that_it_converged(spark):
    """Two records and two rivals, all four pairs: a loop; equal odds leave equal beliefs below a half."""
    rows = [(a, b, a, b, "s", "t", 1.0) for a in (1, 2) for b in (11, 12)]
    schema = "id_a long, id_b long, group_a long, group_b long, source_a string, source_b string, u double"
    got = M.propagate(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.converged for r in got) and len({round(r.belief, 3) for r in got}) == 1 and got[0].belief < 0.5
    cut_short = M.propagate(spark.createDataFrame(rows, schema), tolerance=1e-12, most_rounds=1).collect()
    assert not any(r.converged for r in cut_short)
    assert M.propagate(spark.createDataFrame([], schema)).count() == 0


def test_groups_of_chained_copies(spark):
    links = [(5, 4), (4, 9), (9, 2), (20, 21), (30, 31), (31, 32), (32, 33), (33, 34), (34, 29)]
    df = spark.createDataFrame([(min(p), max(p)) for p in links], "id_a long, id_b long")
    got = {r.id: r.head for r in M.groups_of(df).collect()}
    assert got == {2: 2, 4: 2, 5: 2, 9: 2, 20: 20, 21: 20, 29: 29, 30: 29, 31: 29, 32: 29, 33: 29, 34: 29}
    assert M.groups_of(df.limit(0)).count() == 0


def test_roles_of_words_come_from_the_rows(spark):
    """One source writes "foo" now and then, all of them list a hotel's "beta" beside it: no list names either word."""
    rng = random.Random(1)
    rows = []
    for i in range(700):
        base = [f"{rng.choice('bdkmtr')}{rng.choice('aeiou')}x{i}q", "coral"]
        for last in ([], ["beta"]):
            day = DAY + dt.timedelta(days=rng.randrange(90))
            for source in "abc":
                words = base + last
                rows.append((source, ["foo", *words] if source == "a" and rng.random() < 0.7 else words, f"place {i % 40}", day, 7))
    df = spark.createDataFrame(rows, "source string, words array<string>, place string, date date, nights int")
    noise, siblings = M.word_roles(df)
    assert "foo" in noise and "coral" not in noise and "beta" not in noise
    assert "beta" in siblings and "coral" not in siblings
    noise, siblings = M.word_roles(df.limit(0))
    assert set(noise) == set(M.NOISE_WORDS) and set(siblings) == set(M.SIBLINGS)


def test_matching_broadcasts_nothing(spark, capsys):
    """However small a side looks, no join of the matching may broadcast it: what is small compressed may not be so in memory."""
    seen = []
    from sojourn.llm import matching

    def keep(df, cut=matching.cut):
        out = cut(df)
        df.explain()
        seen.append(capsys.readouterr().out)
        return out

    matching.cut, before = keep, matching.cut
    try:
        rows = [(i, "abc"[i % 3], f"Vikskagys {'Coral' if i % 2 else 'Annex'}", "Nea", DAY, 7) for i in range(30)]
        M.match_stays(_offers(spark, rows)).explain()
    finally:
        matching.cut = before
    plans = "".join(seen) + capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans


# --- p5


def test_survivors_fields_ties_nulls(spark):
    rows = [("k", "a", 1, None, 5), ("k", "b", 2, "u2", 7), ("k", "c", None, "u3", 6), ("one", "a", 1, "x", 1), (None, "a", 1, "x", 1), (None, "b", 1, "x", 1), ("e", "a", 3, None, 1), ("e", "a", 3, None, 1)]
    df = spark.createDataFrame(rows, "key string, source string, rank int, url string, seen int")
    fields = [S.Field("source", F.col("source"), F.col("source").isNotNull(), (-F.coalesce("rank", F.lit(99)),)), S.Field("url", F.col("url"), F.col("url").isNotNull(), (F.col("seen"),))]
    got = {r.key: (r.source, r.url) for r in S.survivors(df, "key", fields).collect()}
    assert got == {"k": ("a", "u2"), "e": ("a", None)}
    assert S.survivors(df.limit(0), "key", fields).count() == 0


def test_pages(spark):
    urls = {"https://w.example/nabidka/5#x": True, "https://w.example/detail.php?id=": False, "https://w.example/detail.php?id=4&termin=2": True, "https://w.example/404?from=detail": False, "https://w.example/vyhledavani?location=7": False, "": False, None: False, "https://w.example/hotel/4-a-b": True, "https://w.example/dovolena-recko/?page=4": False, "https://w.example/dovolena-x-z4/55/": True}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(S.is_page(F.col("u"))).collect()
    assert [r[0] for r in got] == list(urls.values())


# --- p7


def test_percentiles_of_merged_days(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", None]), rng.randrange(3), rng.choice([1, 5, 5, 7, 100, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, day int, v int")
    parts = [P.value_counts(df.filter(F.col("day") == d), ["g"], "v") for d in range(3)]
    got = {r.g: r for r in P.percentiles_of_counts(P.merge_counts(parts, ["g"], "v"), ["g"], "v", (0, 10, 50, 99, 100)).collect()}
    for g in ("x", None):
        vs = sorted(v for a, _, v in rows if a == g and v is not None)
        for p in (0, 10, 50, 99, 100):
            assert got[g][f"p{p}"] == vs[max(0, -(-len(vs) * p // 100) - 1)]
    assert P.percentiles_of_counts(P.value_counts(df.limit(0), ["g"], "v"), ["g"], "v").count() == 0


# --- p8

ITEM = "Sledovač zaznamenal u Miveza celkem 335 změn, poslední z nich ovlivnila Mevux v oblasti Pimaser. Kolik korun ušetří rodina Caforon, pokud vybere termín číslo 467 u kanceláře Mufe?"


def test_leaks(spark):
    words = ITEM.split()
    wrong = [w if k not in (3, 15) else "jinak" for k, w in enumerate(words)]
    far = [w if k % 4 else "jinak" for k, w in enumerate(words)]
    docs = {
        1: "Začátek. " + " ".join(words[:12]) + " konec", 2: "Začátek. " + " ".join(words[:11]) + " konec", 3: "A " + " ".join(wrong) + " b", 4: " ".join(far), 5: ITEM.upper().replace(" ", "​  "),
        6: "<p>" + " ".join(f"<b>{w}</b>" for w in words) + "</p>", 7: ITEM.replace("o", "о").replace("a", "а"), 8: "", 9: None, 10: "slovo " * 50_000 + ITEM + " slovo" * 50_000, 11: " ".join(words[:5]) + " kata logem " + " ".join(words[5:]),
    }
    df = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM), (8, "krátká"), (9, None), (10, "Zcela jiná otázka " * 5)], "item_id long, text string")
    got = {tuple(r) for r in K.leaking_items(df, items).collect()}
    assert got == {(d, 7) for d in (1, 3, 5, 6, 7, 10, 11)}
    assert {tuple(r) for r in K.leaking_items(df, items, block_chars=50).collect()} == got
    assert K.leaking_items(df, items.limit(0)).count() == 0
    assert K.leaking_items(df.limit(0), items).count() == 0


def _brute(item, doc, b):
    """Cell by cell: 12 words in a row, or a passage of 20 to 40 words with few enough wrong ones, from any start to any end."""
    exact = {tuple(item[k : k + b.exact]) for k in range(len(item) - b.exact + 1)}
    if any(tuple(doc[k : k + b.exact]) in exact for k in range(len(doc) - b.exact + 1)):
        return True
    if sum(w in set(doc) for w in item) < b.passage - 3:
        return False
    for start in range(len(item)):
        row = [(0, 0)] * (len(doc) + 1)  # wrong words, and minus the words of the document
        for end in range(start, min(len(item), start + 2 * b.passage)):
            below = [(row[0][0] + 1, row[0][1])]
            for c, w in enumerate(doc, 1):
                here = (row[c - 1][0] + (item[end] != w), row[c - 1][1] - 1)
                below.append(min(here, (row[c][0] + 1, row[c][1]), (below[-1][0] + 1, below[-1][1] - 1)))
            row = below
            for wrong, theirs in row:
                size = max(end + 1 - start, -theirs)
                if size >= b.passage and wrong <= b.share * size:
                    return True
    return False


def test_leaks_against_every_window():
    """The filter loses nothing: random passages with few wrong words, added ones of up to 400 letters among them."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvyz") for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]))) for _ in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([21, 34, 45]))] for _ in range(9)]

    def other():
        return rng.choice(vocabulary) if rng.random() < 0.7 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([30, 80, 120, 400])))

    docs = []
    for _ in range(200):
        passage = list(rng.choice(items))
        size = rng.choice([11, 12, 18, 19, 20, 21, 24, 31, 40])
        a = rng.randrange(max(1, len(passage) - size + 1))
        passage = passage[a : a + size]
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5])):
            k = rng.randrange(len(passage))
            passage[k : k + 1] = rng.choice([[], [other()], [passage[k], other()]])
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(30))] + passage + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])
    b = K.Bounds()
    index = K.Index(list(range(len(items))), [" ".join(i) for i in items], b)
    got = set(index.leaks([" ".join(d) for d in docs]))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if _brute(item, doc, b)}
    # Words that only spacing tells from the item's count as well.
    spaced = {(d, i) for d, i in got - want if _brute(items[i], K._respaced(docs[d], items[i]), b) or any(s in "".join(docs[d]) for s in index.strings[i])}
    assert len(want) > 60 and any(len(docs[d]) and max(map(len, docs[d])) >= 120 for d, _ in want)
    assert want <= got and got - want == spaced


@pytest.mark.parametrize("size", [1, 30, 80, 120, 400, 5000])
def test_leak_around_a_long_added_word(size):
    words = [f"slovo{chr(97 + k)}{chr(98 + k * 7 % 20)}" for k in range(22)]
    index = K.Index([7], [" ".join(words)], K.Bounds())
    added = "".join(random.Random(size).choice("xyzwq") for _ in range(size))
    doc = [*["jine"] * 9, *words[:11], added, *words[11:], *["dalsi"] * 9]
    assert index.leaks([" ".join(doc)]) == [(0, 0)]


def test_long_texts_in_pieces(monkeypatch):
    index = K.Index([7], [ITEM], K.Bounds())
    texts = ["slovo " * n + ITEM + " konec" * 40 for n in range(0, 60, 3)] + ["slovo " * 90, "", None, ITEM]
    whole = set(index.leaks(texts))
    monkeypatch.setattr(K, "PIECE", 200)
    assert set(index.leaks(texts)) == whole == {(k, 0) for k in [*range(20), 23]}
    weights = np.random.default_rng(0).normal(size=(1 << 18, 5)).astype(np.float32)
    lines = [" dobrý den " * 40, " a ", " " + "xyz" * 500 + " "]
    before = L._sums(weights, lines, L.Settings())
    monkeypatch.setattr(L, "PIECE", 50)
    assert np.allclose(before, L._sums(weights, lines, L.Settings()), atol=1e-4)


# --- p9


def test_split_tree():
    rng = np.random.default_rng(1)
    tree = X.split_tree(np.array([7, 0, 100, 13]), 6, rng)
    assert tree.sum(0).tolist() == [7, 0, 100, 13]
    assert tree.sum(1).max() - tree.sum(1).min() <= 1
    assert X.split_tree(np.array([0]), 3, rng).tolist() == [[0], [0], [0]]


@pytest.mark.skipif(not Path(X.VOCABULARY).exists(), reason="no vocabulary here")
def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big", "Big ", "small"] if i % 10 == 0 else ["big"]), f"slovo {i} " * rng.randrange(1, 9), "clash") for i in range(1500)]
    rows += [(5000, "big", rows[1][2], "x"), (5001, None, "t", "x"), (5002, "small", "", "x"), (5003, "small", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture = X.mix(docs, targets, shard_tokens=2000, block_tokens=50).toPandas()
    used = Counter(mixture["doc_id"])
    small = {r[0] for r in rows if r[1] == "small"}
    assert max(v for k, v in used.items() if k in small) <= 3
    assert max(v for k, v in used.items() if k not in small) == 1
    assert not {1, 5000} <= set(used)
    share = mixture.groupby("source")["tokens"].sum() / mixture["tokens"].sum()
    assert share["big"] == pytest.approx(0.6 / 0.9, abs=0.01)
    assert mixture.groupby(["source", "copy"])["doc_id"].apply(lambda s: s.is_unique).all()
    for _, shard in mixture.groupby("shard"):
        assert sorted(shard["position"]) == list(range(1, len(shard) + 1))
    again = X.mix(docs, targets, shard_tokens=2000, block_tokens=50).toPandas()
    key = ["doc_id", "copy"]
    pd.testing.assert_frame_equal(mixture.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))
    assert X.mix(docs.limit(0), targets).count() == 0
    report = {r.source: r for r in X.mix_report(X.mix(docs, targets), targets).collect()}
    assert report["absent"].tokens == 0 and report["big"].most_used == 1


# --- p10

SAMPLES = {
    "cs": ["Pokoje byly čisté, jen chyběla klimatizace ve druhém patře.", "Loni jsme platili méně a letos je to znatelně víc.", "Děti mají pobyt na přistýlce zdarma."],
    "sk": ["Izby boli čisté, iba klimatizácia na druhom poschodí chýbala.", "Vlani sme platili menej a tento rok je to citeľne viac.", "Deti majú pobyt na prístelke zadarmo."],
    "pl": ["Pokoje były czyste, brakowało tylko klimatyzacji na drugim piętrze.", "W zeszłym roku płaciliśmy mniej, a teraz jest wyraźnie drożej.", "Goście mają do dyspozycji kryty basen."],
    "de": ["Die Zimmer waren sauber, nur die Klimaanlage im zweiten Stock fehlte.", "Letztes Jahr zahlten wir weniger, heuer ist es spürbar mehr.", "Kinder schlafen im Zustellbett gratis."],
    "en": ["The rooms were clean, only the second floor had no air conditioning.", "Last year we paid less and now it is noticeably more.", "Children sleep on the extra bed free of charge."],
}


def test_kernel_is_the_share_of_common_grams():
    s = L.Settings()
    a, b = " dobrý den ", " dobrá zpráva "

    def grams(t):
        return {t[i : i + n] for n in s.grams for i in range(len(t) - n + 1)}

    slots, _, size = L.presence([b], s)
    assert L._kernel([a], slots, size, s)[0, 0] == pytest.approx(len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5, abs=0.02)


def test_languages_held_out_and_mixed(spark):
    rng = random.Random(8)
    docs = []
    for i in range(400):
        lang = list(SAMPLES)[i % 5]
        docs.append((i, " ".join(rng.sample(SAMPLES[lang], 2)), lang if rng.random() < 0.9 else rng.choice(list(SAMPLES))))
    docs += [(1000, SAMPLES["cs"][0] + "\n\n" + SAMPLES["de"][1] + " " + SAMPLES["cs"][1], "xx"), (1001, "PRG 3.6.2026 21 031 CZK\nVIE 1", None), (1002, "", "cs"), (1003, None, "cs"), (1004, " ".join(SAMPLES["pl"][:1] * 2000), "English")]
    found = L.label_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    main = {r.doc_id: r.lang for r in found if r.line_no == 0}
    assert sum(main[i] == list(SAMPLES)[i % 5] for i in range(400)) >= 398
    lines = defaultdict(set)
    for r in found:
        if r.line_no:
            lines[r.doc_id].add((r.line_no, r.lang))
    assert lines[1000] == {(1, "cs"), (2, "de"), (2, "cs")}  # the blank line between them has no number
    assert not {1001, 1002, 1003} & set(main)
    assert main[1004] == "pl"
    assert all(0 <= r.confidence <= 1 for r in found)


def test_label_notations(spark):
    labels = {"cs-CZ": "cs", "Čeština": "cs", "cze": "cs", "SK": "sk", "slo": "sk", "German": "de", "xx": None, "": None, None: None, "en_US": "en"}
    got = spark.createDataFrame([(v,) for v in labels], "l string").select(L.label_language(F.col("l"))).collect()
    assert [r[0] for r in got] == list(labels.values())


def test_languages_of_nothing(spark):
    assert L.label_documents(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_lines_are_counted_without_empty_ones():
    docs = [("\n".join(SAMPLES[k]), k) for k in SAMPLES for _ in range(20)]
    model = L.fit([t for t, _ in docs], [k for _, k in docs])
    text = "\n \n" + SAMPLES["pl"][0] + "\n\n\n\t\n" + SAMPLES["en"][1] + "\n\nPRG 4.5.2026 12 990 CZK\n" + SAMPLES["pl"][2] + "\n"
    got = [(line, lang) for _, line, lang, _, _ in L.segments([text], model, L.Settings())]
    assert got[0] == (0, "pl") and set(got[1:]) == {(1, "pl"), (2, "en"), (4, "pl")}
    assert list(L.segments(["", None, "PRG 1 CZK\nVIE 2", "\n\n"], model, L.Settings())) == []


def test_lead_bounds_what_goes_astray():
    least, differ = np.array([0.1, 0.9, 0.5, 0.3, 0.7]), np.array([True, False, False, True, False])
    assert L._lead(least, differ, 0.0) == 0.5
    assert L._lead(least, differ, 0.125) == 0.3
    assert L._lead(least[:0], differ[:0], 0.1) == 0.0


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "cs").when(F.col("id") % 100 == 1, "German").alias("lang"))
    s = L.Settings(docs=50)
    got = L.sample(df, "doc_id", "text", "lang", s)
    assert Counter(lang for _, lang in got) == {"cs": 50, "de": 20} and got == L.sample(df.repartition(7), "doc_id", "text", "lang", s)
