"""History, ranks, peers, ingest, view and payload operators on small cases."""

from __future__ import annotations

import base64
import datetime as dt
import json
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from sojourn.functions import labels
from sojourn.functions import normalize as N
from sojourn.operators import criteria as C
from sojourn.operators import history as H
from sojourn.operators import ingest as I
from sojourn.operators import peers as P
from sojourn.operators.ranks import number_rows, values_at_ranks, with_previous
from sojourn.operators.view import View
from sojourn.sources import lookups, packages, payloads, tours
from sojourn.streaming.heartbeat import heartbeat_stream

T0 = dt.datetime(2026, 5, 1)


def _one(spark, value, *functions, kind="string"):
    return list(spark.createDataFrame([(value,)], f"x {kind}").select(*[f(F.col("x")) for f in functions]).first())


@pytest.mark.parametrize(("raw", "want"), [("All Inclusive Light", "AI"), ("Plná penze", "FB"), ("POLOPENZE", "HB"), ("Snídaně", "BB"), ("bez stravy", "none"), ("hb", "HB"), ("?", "unknown"), ("", "unknown"), (None, "unknown")])
def test_board(spark, raw, want):
    assert _one(spark, raw, N.board) == [want]


@pytest.mark.parametrize(("raw", "known", "any_"), [("Řecko / Kréta", "Řecko", "Řecko"), ("EMIRÁTY", "Spojené arabské emiráty", "Spojené arabské emiráty"), ("Bali", "Indonésie", "Indonésie"), ("Atlantida – sever", None, "Atlantida"), ("", None, None), (None, None, None), ("/x", None, None)])
def test_country(spark, raw, known, any_):
    assert _one(spark, raw, N.known_country, N.country) == [known, any_]


def test_text_functions(spark):
    assert _one(spark, "Štěpán Łódź É", N.strip) == ["stepan łodz e"]
    assert _one(spark, "Hotel ★ Černý & Spa Resort", N.hotel_name) == ["cerny"]
    assert _one(spark, "12\xa0990 Kč", N.czk) == [12990]
    assert _one(spark, "od 5. 7.2026", N.cz_date) == ["2026-07-05"]
    assert _one(spark, "28. 12. – 3. 1. 2027", N.first_of_range) == [dt.date(2026, 12, 28)]
    assert _one(spark, "a​b\xa0 c", N.clean_space) == ["ab c"]
    assert _one(spark, "&lt;a&gt; &amp;amp;", N.unescape) == ["<a> &amp;"]
    assert _one(spark, "<a & 'b'>", N.escape) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert _one(spark, "modra-laguna", N.title_of_slug) == ["Modra Laguna"]
    assert _one(spark, -2.5, N.half_up, kind="double") == [-2]
    assert _one(spark, 1234567, N.grouped_thousands, kind="int") == ["1 234 567"]
    assert [N.absolute_url(F.lit(u), "https://h.example/") is not None for u in ("/a", "https://x/#b")] == [True, True]
    for nights, band in [(None, None), (-1, None), (0, "0-5"), (5, "0-5"), (6, "6-8"), (12, "9-12"), (13, "13+")]:
        assert _one(spark, nights, N.nights_band, kind="int") == [band]


def test_keys_of_nothing(spark):
    df = spark.createDataFrame([("Hotel Spa", "Řecko", dt.date(2026, 7, 1), 7, "AI", None), ("Modrá", None, dt.date(2026, 7, 1), 7, "AI", None), ("Modrá", "Řecko", dt.date(2026, 7, 1), None, "unknown", None)], "t string, c string, d date, n int, b string, a string")
    rows = df.select(N.match_key(*[F.col(c) for c in "tcdnba"]).alias("m"), N.hotel_key(F.col("t"), F.col("c")).alias("h")).collect()
    assert [(r.m is None, r.h is None) for r in rows] == [(True, True), (True, True), (True, False)]


def _history(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(hours=rng.randrange(24 * 40)), rng.choice([100, 100, 200])) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, k int, at timestamp, price int")


def test_heartbeat_against_a_fold(spark):
    rows, df = _history(spark)
    want, last = set(), {}
    for i, k, at, p in sorted(rows):
        if k not in last or p != last[k][0] or at - last[k][1] > dt.timedelta(days=7):
            last[k] = (p, at)
            want.add((k, p, i))
    assert {tuple(r) for r in H.heartbeat(df, "k", "id", "at", "price").collect()} == want
    assert H.heartbeat(df.limit(0), "k", "id", "at", "price").count() == 0


def test_heartbeat_stream_equals_the_fold(spark, tmp_path):
    rows = sorted(_history(spark, 2)[0], key=lambda r: (r[2], r[0]))
    want, last = set(), {}
    for _, k, at, p in rows:
        if k not in last or p != last[k][0] or at - last[k][1] > dt.timedelta(days=7):
            last[k] = (p, at)
            want.add((k, at, p))
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], "id long, k int, at timestamp, price int").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    got = []
    for n in range(3):
        (tmp_path / "land").mkdir(exist_ok=True)
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            f.rename(tmp_path / f"land/{n}.parquet")
        stream = spark.readStream.schema("id long, k int, at timestamp, price int").parquet(str(tmp_path / "land"))
        query = heartbeat_stream(stream, "k", "at", "price").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    assert set(got) == want and len(got) == len(want)


def test_own_baseline_bounds(spark):
    now = dt.datetime(2026, 5, 16, tzinfo=dt.timezone.utc)
    rows = [(1, now - dt.timedelta(days=d), p) for d, p in ((8, 10), (5, 20), (3, 40))] + [(2, now - dt.timedelta(days=d), 10) for d in (7, 5, 2.5)] + [(3, now - dt.timedelta(hours=h), 5) for h in (1, 150, 160)]
    df = spark.createDataFrame(rows, "k int, at timestamp, p int")
    got = {r.k: (r.n, r.baseline) for r in H.own_baseline(df, "k", "at", "p", F.lit(now)).collect()}
    assert got == {1: (3, 20.0), 2: (3, None), 3: (2, None)}  # 23:00 UTC the day before is today in Prague


def _pool(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, None, f"m{rng.randrange(60)}"]), rng.randrange(50, 70), T0.date() + dt.timedelta(days=rng.randrange(90)), rng.randrange(5, 12)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, b string, m string, v int, d date, k int")


def _brute(rows, fits, least):
    out = {}
    for s in rows:
        least_of = {}
        for p in rows:
            if (p[2] or p[0]) != (s[2] or s[0]) and fits(s, p):
                g = p[2] or p[0]
                least_of[g] = min(p[3], least_of.get(g, 10**9))
        out[s[0]] = (len(least_of), median(least_of.values()) if len(least_of) >= least else None)
    return out


def test_leave_out_median_against_self_join(spark):
    rows, df = _pool(spark)
    got = {r.id: (r.peers, r.median) for r in P.leave_out_median(df, ["b"], "m", "id", "v", 8).collect()}
    assert got == _brute(rows, lambda s, p: s[1] == p[1], 8)
    few = {r.id: (r.peers, r.median) for r in P.leave_out_median(df.filter("id < 9"), ["b"], "m", "id", "v", 1).collect()}
    assert few == _brute(rows[:9], lambda s, p: s[1] == p[1], 1)


def test_range_median_against_self_join(spark):
    rows, df = _pool(spark)
    got = {r.id: (r.peers, r.median) for r in P.range_median(df, ["b"], "m", "id", "v", "d", 10, "k", 1, 4).collect()}
    want = _brute(rows, lambda s, p: s[1] is not None and s[1] == p[1] and abs((s[4] - p[4]).days) <= 10 and abs(s[5] - p[5]) <= 1, 4)
    assert got == {k: v for k, v in want.items() if v[0]}


def test_values_at_ranks_of_nothing(spark):
    assert values_at_ranks(spark.createDataFrame([], "g string, v int, n long"), ["g"], "v", {"a": lambda t: t}).count() == 0


def test_representatives_and_dedup(spark):
    df = spark.createDataFrame([(1, "m", 30, "a"), (2, "m", 10, "b"), (3, "m", 10, "c"), (4, None, 5, "d"), (5, None, 5, "e"), (6, "m", 40, "f"), (7, "m", 50, "g")], "id long, m string, p int, s string")
    got = {r.id: [a.id for a in r.alternatives] for r in H.representatives(df, "m", "id", "p", ["s"]).collect()}
    assert got == {2: [3, 1, 6], 4: [], 5: []}
    assert {(r.m, r.id) for r in H.first_wins(df, "m", ["id"]).collect()} == {("m", 1), (None, 4)}
    assert {(r.m, r.id, r.p) for r in H.cheapest_wins(df, "m", "p", "id").collect()} == {("m", 1, 10), (None, 4, 5)}
    assert {tuple(r) for r in H.facets(df, ["m", "s"]).filter("facet = 'm'").collect()} == {("m", "m", 5)}


def test_streaks(spark):
    runs = {"a": "FFFS", "b": "FFF", "c": "FFFF", "d": "FFS", "e": "S" * 30}
    rows = [(s, 1000 - i, c == "F") for s, seq in runs.items() for i, c in enumerate(seq)]
    got = {r.s: r.alert for r in H.streaks(spark.createDataFrame(rows, "s string, id int, f boolean"), "s", "id", F.col("f")).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False}


OFFERS = "id long, source string, source_offer_key string, title string, country string, locality string, stars double, board string, transport string, departure_airport string, departure_date date, nights int, tour_operator string, url string, first_seen_at timestamp, last_seen_at timestamp, active boolean, misses int, match_key string, hotel_key string"


def _incoming(spark, *rows):
    told = "source string, source_offer_key string, title string, country string, locality string, stars double, board string, transport string, departure_airport string, departure_date date, nights int, tour_operator string, url string, ordinal int"
    return spark.createDataFrame([(s, k, t, "Řecko", None, 4.0, "AI", "flight", "PRG", d, 7, None, "u", i) for i, (s, k, t, d) in enumerate(rows)], told)


def test_ingest(spark):
    day = dt.date(2026, 7, 1)
    empty = spark.createDataFrame([], OFFERS)
    one = I.upsert(empty, _incoming(spark, ("a", "k1", "Modrá laguna", day), ("a", "k2", "Hotel 12", day), ("a", "k1", "Jiná", day)), F.lit(T0))
    got = {r.source_offer_key: r for r in one.collect()}
    assert (got["k1"].id, got["k2"].id, got["k1"].title) == (1, 2, "Modrá laguna")
    two = I.upsert(one, _incoming(spark, ("a", "k1", "Hotel 99", dt.date(2026, 1, 1)), ("a", "k3", "Nová", day)), F.lit(T0 + dt.timedelta(days=1)))
    got = {r.source_offer_key: r for r in two.collect()}
    assert got["k1"].title == "Modrá laguna" and got["k1"].departure_date is None and got["k1"].match_key is None and got["k3"].id == 3
    assert got["k1"].first_seen_at == T0 and got["k2"].last_seen_at == T0
    seen = spark.createDataFrame([("k1",)], "source_offer_key string")
    once = I.mark_missed(two, seen, "a")
    twice = {r.source_offer_key: (r.active, r.misses) for r in I.mark_missed(once, seen, "a").collect()}
    assert twice == {"k1": (True, 0), "k2": (False, 2), "k3": (False, 2)}
    assert {(r.misses) for r in I.mark_missed(two, seen, "b").collect()} == {0}
    now, last = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 9)], "k int, p int"), spark.createDataFrame([(1, 10, T0), (2, 10, T0 + dt.timedelta(days=1)), (4, 10, T0 + dt.timedelta(days=1))], "k int, p int, t timestamp")
    due = I.due_snapshots(now, last, "k", "p", "t", F.lit(T0 + dt.timedelta(days=7, seconds=1)))
    assert {r.k for r in due.collect()} == {1, 3, 4}
    assert {r.c for r in I.replace_set(spark.createDataFrame([("řecko",), ("Řecko",), ("Nikde",), (None,)], "c string"), "c").collect()} == {"Řecko"}


def test_view(spark):
    df = spark.createDataFrame([(1, "Řecko", "AI", "a", 7, "PRG", "flight", 100, dt.date(2026, 7, 1), 10), (2, "Egypt", "HB", "b", 3, None, "own", 50, None, None), (3, None, "AI", "a", None, "BRQ", None, 70, dt.date(2026, 8, 1), 30)], "id int, country string, board string, source string, nights int, departure_airport string, transport string, price int, departure_date date, real_pct int")
    ids = lambda v: [r.id for r in v.apply(df).collect()]
    assert ids(View()) == [3, 1, 2]
    assert ids(View(sort="price")) == [2, 3, 1]
    assert ids(View(sort="departure")) == [1, 3, 2]
    assert ids(View(airports=("prg",), own=True)) == [1, 2]
    assert ids(View(countries=("Řecko", "Egypt"), most=60)) == [2]
    assert ids(View(first="2026-07-15")) == [3]
    assert ids(View(bands=("6-8",), least_pct=5)) == [1]
    v = View(countries=("Řecko", "Egypt"), own=True, most=60, sort="price", last="2026-09-01")
    assert View.from_query(v.to_query()) == v and View().to_query() == "" and v.active() == 4
    assert View.from_query("most=x&sort=bad&nope=1&first=zzz") == View()


def test_payloads(spark, tmp_path):
    page = """<html><h1>Hlavní &amp; název</h1><script type="application/ld+json">{"@type": ["Thing", "LodgingBusiness"], "name": " Modrá "}</script>
    <div class="card big" data-id="7"><span data-testid="title">Hotel <b>A</b> &amp; B</span><a class="link" href="/x?y=1">d</a><img><p class="price">10 000 Kč</p></div>
    <div class="card"><span data-testid="title">C</span></div><script>window.data = {"a": "x]}{", "list": [1, {"b": 2}]};</script></html>"""
    (tmp_path / "p.html").write_text(page)
    df = payloads.read_payloads(spark, str(tmp_path))
    row = df.select(payloads.lodging_name("body").alias("n"), payloads.embedded_json("window.data = {")("body").alias("j"), payloads.embedded_json('"list": [', False)("body").alias("l")).first()
    assert row.n == "Modrá" and json.loads(row.j)["list"][1] == {"b": 2} and json.loads(row.l) == [1, {"b": 2}]
    spec = payloads.CardSpec(("class", "card"), {"title": ("data-testid", "title", None), "url": ("class", "link", "href"), "price": ("class", "price", None)})
    cards = payloads.html_cards(df.select("body", F.lit("s").alias("source")), "body", spec).orderBy("ordinal").collect()
    assert [(c.source, c.title, c.url, c.price) for c in cards] == [("s", "Hotel A & B", "/x?y=1", "10 000 Kč"), ("s", "C", None, None)]
    token = "h." + base64.urlsafe_b64encode(json.dumps({"nights": 7, "ž": "?>"}).encode()).decode().rstrip("=") + ".s"
    got = _one(spark, token, payloads.token_payload)[0]
    assert json.loads(got)["nights"] == 7
    assert [_one(spark, t, payloads.token_payload)[0] for t in ("a.b", "a.%%%.c", "", None)] == [None] * 4
    xml = "<urlset><url><loc> https://h/detail-zajezdu/recko/modra-laguna/12a </loc></url><url><loc>https://h/x?a=1&amp;b</loc></url></urlset>"
    urls = _one(spark, xml, payloads.sitemap_urls)[0]
    assert urls == ["https://h/detail-zajezdu/recko/modra-laguna/12a", "https://h/x?a=1&b"]
    assert spark.createDataFrame([(urls[0],)], "u string").select(*payloads.detail_ids(F.col("u"))).first() == (12, "modra-laguna")
    chunks = r'self.__next_f.push([1,"{\"deals\":[1,"])self.__next_f.push([1,"2]}"])'
    assert _one(spark, chunks, payloads.pushed_chunks) == ['{"deals":[1,2]}']
    nights = payloads.by_nights(spark.createDataFrame([(1, '{"7": "a", "x": "b"}'), (2, "bad")], "i int, j string"), "j").collect()
    assert [(r.i, r.nights, r.value) for r in nights] == [(1, 7, "a"), (1, None, "b")]
    assert payloads.select_sources("b, zz,a,b", ["a", "b", "c"]) == (["a", "b"], ["zz"])


def test_packages(spark):
    pack = {"tour_id": 5, "tour_name": " Modrá ", "detail": "5-modra", "country_name": "Řecko", "destination_name": "", "state_name": "Kréta", "accommodation_category": 3.5, "board_name": "Polopenze", "board_id": 1, "transport_name": "Letecky", "start": "2026-07-01", "nights": "7", "persons": 2, "package_price": 35980, "original_price": 74980}
    body = json.dumps({"packages": [pack, pack | {"tour_name": "Druhá"}, pack | {"package_price": 0, "tour_id": 6}, pack | {"start": None, "tour_id": 7}]})
    df = spark.createDataFrame([(body,), ('{"packages": []}',), ("nonsense",), (None,)], "body string")
    (offer,) = packages.party_packages(df, "body", "s", "https://h/hotel").collect()
    assert (offer.title, offer.price_per_person, offer.price_total, offer.claimed_original_price, offer.claimed_discount_pct, offer.stars, offer.board, offer.locality, offer.url) == ("Modrá", 17990, 35980, 37490, 52.0, 4.0, "HB", "Kréta", "https://h/hotel/5-modra")
    assert sorted(offer.asDict()) == sorted(x.split()[0] for x in payloads.OFFER.split(", "))
    per = {k: v for k, v in pack.items() if k != "package_price"} | {"unit_price": "9999.5", "package_price": "0.0", "package_discount": 120, "original_price": 9000, "provider_name": "P"}
    body = json.dumps({"packages": [per, per | {"unit_price": 9000}, per | {"tour_id": None, "item_id": "i"}]})
    offers = sorted(packages.person_packages(spark.createDataFrame([(body,)], "body string"), "body", "s", "https://h").collect(), key=lambda o: o.price_per_person)
    assert [(o.price_per_person, o.price_total, o.claimed_discount_pct, o.claimed_original_price, o.tour_operator) for o in offers] == [(9000, None, None, None, "P"), (10000, None, None, None, "P")]


def test_criteria(spark):
    now = F.lit(dt.datetime(2026, 5, 16, 12, tzinfo=dt.timezone.utc))
    day = dt.date(2026, 5, 30)
    df = spark.createDataFrame([(1, "Řecko", "AI", "flight", day, 900), (2, None, None, None, None, None), (3, "Egypt", "HB", "own", dt.date(2026, 5, 15), 10), (4, "Egypt", "HB", "own", dt.date(2026, 5, 16), 10), (5, "Egypt", "HB", "own", dt.date(2026, 5, 31), 10)], "id int, country string, board string, transport string, departure_date date, price int")
    excluded = spark.createDataFrame([("Řecko",), (None,)], "country string")
    assert {r.id for r in C.visible(df, excluded, now).collect()} == {2, 4, 5}
    criteria = spark.createDataFrame([("all", [], [], [], None, None, None), ("gr", ["řecko / x"], ["AI"], [5], "flight", 14, 900), ("soon", [], [], [], None, 14, None), ("cheap", ["Egypt", "egypt"], [], [], None, None, 10)], "name string, countries array<string>, boards array<string>, months array<int>, transport string, within_days int, most int")
    got = {(r.id, r.name) for r in C.meet_criteria(df, criteria, now).collect()}
    assert got == {(1, "all"), (2, "all"), (4, "all"), (5, "all"), (1, "gr"), (1, "soon"), (4, "soon"), (4, "cheap"), (5, "cheap")}
    assert C.meet_criteria(df, criteria, now).count() == 9


def test_log_cap_status(spark):
    now = F.lit(dt.datetime(2026, 5, 16, 12, tzinfo=dt.timezone.utc))
    t = lambda d: dt.datetime(2026, 5, 16, 12) - dt.timedelta(days=d)
    cands = spark.createDataFrame([("a", "drop", 9500), ("b", "drop", 9501), ("c", "new", 1), ("d", "new", 1), ("e", "drop", 10000)], "key string, type string, price int")
    log = spark.createDataFrame([(1, "a", "drop", 1, t(1)), (2, "a", "drop", 10000, t(1)), (3, "b", "drop", 10000, t(6.9)), (4, "c", "new", 100, t(90)), (5, "e", "drop", 10000, t(7)), (6, "d", "drop", 1, t(1))], "id int, key string, type string, price int, at timestamp")
    assert {r.key for r in C.not_yet_told(cands, log, now, ("new",), 5, 7).collect()} == {"a", "d", "e"}
    top, rest = C.capped(cands, [F.desc_nulls_last("price"), F.asc("key")], 2)
    assert [r.key for r in top.collect()] == ["e", "b"] and spark.range(1).select(rest).first()[0] == 3
    runs = spark.createDataFrame([(1, "s", "failed", "BLOCKED 403", t(0.5)), (2, "s", "partial", "BACKOFF", t(0.2)), (3, "u", "failed", "BLOCKED", t(0.5)), (4, "u", "ok", None, t(0.1)), (5, "v", "failed", "BLOCKED", t(1.5)), (6, "w", None, None, None)], "id int, source string, status string, error_sample string, started_at timestamp")
    got = {r.source: (r.status, r.backoff_until is not None) for r in C.run_status(runs, now).collect()}
    assert got == {"s": ("partial", True), "u": ("ok", False), "v": ("failed", False), "w": (None, False)}


def test_lookups(spark):
    one = lambda text: spark.createDataFrame([(text,)], "body string")
    countries = lookups.country_names(one('{"status": "success", "data": {"country": {"3": "Řecko", "4": "Alžírsko"}}}'), "body")
    hotels = lookups.hotel_pages(one("<urlset><url><loc>https://h.example/detail-zajezdu/recko/modra-laguna/12a</loc></url><url><loc>https://h.example/</loc></url></urlset>"), "body")
    assert [tuple(r) for r in hotels.collect()] == [(12, "Modra Laguna", "https://h.example/detail-zajezdu/recko/modra-laguna/12a")]
    term = {"master_id": 12, "price_from": {"CZK": 9000.4}, "date_from": "2026-07-01", "duration_night": 7, "country": "3", "boarding": "Polopenze", "boarding_id": 2, "discount_percent": 10, "rating": 4, "tour_operator": {"name": "T"}, "airport_code": "PRG"}
    body = json.dumps({"data": {"dates": [term, term, term | {"master_id": 99, "country": "4", "discount_percent": 0}, term | {"price_from": {}}, term | {"date_from": None}]}})
    got = {r.title: r for r in lookups.dated_terms(one(body), "body", countries, hotels, "s", "https://h.example").collect()}
    assert set(got) == {"Modra Laguna", "Hotel 99"}
    known = got["Modra Laguna"]
    assert (known.country, known.board, known.price_per_person, known.claimed_original_price, known.claimed_discount_pct, known.tour_operator, known.departure_date) == ("Řecko", "HB", 9000, 10000, 10.0, "T", dt.date(2026, 7, 1))
    assert (got["Hotel 99"].country, got["Hotel 99"].claimed_original_price, got["Hotel 99"].url) == (None, None, "https://h.example")
    hotel = {"detailUrl": "/recko/x?a=1", "hotelId": 5, "name": "X", "rating": {"count": 0.0}, "meal": "Snídaně", "adultPrice": {"amount": 15990.0}}
    tours = spark.createDataFrame([(1, dt.date(2026, 7, 1), 7, "Řecko", "Kréta")], "t int, departure_date date, nights int, country string, locality string")
    (x,) = lookups.tour_hotels(one(json.dumps({"hotels": [hotel, hotel, hotel | {"adultPrice": None}]})).withColumn("t", F.lit(1)), "body", tours, "t", "s", "https://h.example").collect()
    assert (x.title, x.stars, x.board, x.locality, x.url, x.price_per_person) == ("X", None, "BB", "Kréta", "https://h.example/recko/x?a=1", 15990)
    offers = spark.createDataFrame([("a", 1, "Hotel 1"), ("b", 1, "Hotel 1"), ("c", 2, "Hotel 2"), ("d", 1, "Jiný")], "source_offer_key string, hotel_id int, title string")
    prior = spark.createDataFrame([("a", "Modrá"), ("c", "Hotel 2")], "source_offer_key string, title string")
    assert {(r.source_offer_key, r.title) for r in lookups.named_hotels(offers, prior).collect()} == {("a", "Modrá"), ("b", "Modrá"), ("c", "Hotel 2"), ("d", "Jiný")}


def test_number_rows(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as k", "id as name").repartition(7)
    assert [(r.k, r.n) for r in number_rows(df, ["k"], "n").orderBy("k").collect()] == [(k, k + 1) for k in range(5000)]
    assert number_rows(df.limit(0), ["k"], "n").count() == 0


def test_previous_row_over_partitions(spark):
    """A key with most of the rows, small keys and a null key, cut at many places: the row before is that of a plain sort."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.choice([5, 5, 6, None])) for i in rng.sample(range(10_000), 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k int, id int, v int").repartition(5)
        got = {r.id: (r.b is None, r.b and r.b.v) for r in with_previous(df, "k", "id", ["v"], "b").collect()}
        beats = {r.id for r in H.heartbeat(df.withColumn("at", F.timestamp_micros(F.col("id").cast("long") * 3_600_000_000)), "k", "id", "at", "v", days=2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, written, kept = {}, {}, set()
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        assert got[i] == (k not in last, last.get(k))
        if k not in written or last[k] != v or i - written[k] > 48:
            written[k] = i
            kept.add(i)
        last[k] = v
    assert beats == kept
    assert with_previous(df.limit(0), "k", "id", ["v"], "b").count() == 0


def test_more_normalizers(spark):
    texts = {"Zájezd do severního Řecka, Kypr": None, "Last minute Dominikánská republika 7 nocí": "Dominikánská republika", "léto v Egyptě; Egypt levně": "Egypt", "": None, None: None, "123 ..": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.country_in_text(F.col("t"))).collect()
    for (text, want), r in zip(texts.items(), got, strict=True):
        assert r[0] == (want if want or not text or not text.startswith("Z") else "Kypr")
    urls = [("https://x.example/a?b=1&c=%C5%99", "ř"), ("https://x.example/a", None), ("no url", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(u,) for u, _ in urls], "u string").select(F.url_decode(N.query_parameter(F.col("u"), "c"))).collect()] == [c for _, c in urls]
    labels = [("Ne 30. 12. – So 6. 1.", dt.date(2026, 12, 30), 7), ("1. 2. – 8. 2.", dt.date(2027, 2, 1), 7), ("8. 6. – 8. 6.", dt.date(2026, 6, 8), None), ("31. 6. – 7. 7.", None, None), ("8. 6.", None, None), (None, None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in labels], "t string")
    got = df.select(*N.trip_of_label(F.col("t"), F.lit(dt.datetime(2026, 5, 16)))).collect()
    assert [tuple(r) for r in got] == [(d, n) for _, d, n in labels]
    days = [("20260630", "20260707", 3, 7), ("20260630", None, 8, 7), ("x", "20260707", 1, None), ("20260707", "20260701", 8, None)]
    df = spark.createDataFrame(days, "a string, b string, n int, want int")
    assert all(r[0] == r[1] for r in df.select(N.nights_between(F.col("a"), F.col("b"), F.col("n")), "want").collect())


def test_detail_pages(spark):
    urls = {"https://h/detail-zajezdu/recko/x/12a/": (12, "x"), "https://h/detail-zajezdu/12": (None, None), "https://h/detail-zajezdu/x/12-3": (None, None), "https://h/jine/x/12": (None, None), "": (None, None), None: (None, None)}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(*payloads.detail_ids(F.col("u"))).collect()
    assert [tuple(r) for r in got] == list(urls.values())


def test_range_median_null_as_value(spark):
    rows = [(i, "h", None if i < 6 else "AI", None, 100 + i, dt.date(2026, 7, 1), 7) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, hotel string, board string, match string, v int, day date, n int")
    args = (["hotel", "board"], "match", "id", "v", "day", 30, "n", 2, 4)
    assert P.range_median(df, *args).filter("id < 6").count() == 0
    got = {r.id: r.peers for r in P.range_median(df, *args, nullable=("board",)).collect()}
    assert got == {**{i: 5 for i in range(6)}, 6: 1, 7: 1}


def test_tours_and_hotels(spark):
    hotel = {"id": 7, "name": "Modrá", "starsCount": 4, "breadcrumbs": {"country": "Řecko", "destination": "Kréta"}}
    price = {"adultPrice": 9990, "total": 19980, "discount": 28280, "lowestPrice": 8990.4}
    tour = {"nightsCount": 7, "transportType": 1, "date": {"from": "2026-07-01T00:00:00"}, "price": price, "rooms": [{"meal": "Polopenze"}]}
    body = {"tours": [{"detailUrl": "/a/b", "hotel": hotel, "tour": tour}, {"detailUrl": "/other", "hotel": hotel, "tour": tour}, {"detailUrl": "/x", "hotel": {"name": "Bez ceny"}, "tour": {"price": {}}}, {"hotel": hotel, "tour": tour}, {"detailUrl": "https://y/z", "hotel": {"name": "Sám"}, "tour": {"price": {"adultPrice": "100"}}}]}
    df = spark.createDataFrame([(json.dumps(body),), ("no json",), (None,), ("{}",)], "body string")
    got = {r.title: r for r in tours.tour_offers(df, "body", "s", "https://h.example").collect()}
    r = got["Modrá"]
    assert (r.url, r.price_per_person, r.price_total, r.claimed_original_price, r.claimed_discount_pct, r.omnibus_lowest_price, r.board, r.transport, r.nights) == ("https://h.example/a/b", 9990, 19980, 24130, 59.0, 8990, "HB", "flight", 7)
    assert set(got) <= {"Modrá", "Sám"} and r.departure_date == dt.date(2026, 7, 1) and r.country == "Řecko"
    hotels = {"hotels": [{"hotelId": 3, "title": " Vila ", "noStars": 0, "priceInfo": {"regular": {"amount": 4999.5}, "group": {"amount": 9999}}, "destinations": [{"name": "Egypt"}, {"name": " Hurghada "}], "additionalInfo": {"boarding": "all inclusive", "transport": {"label": "letecky"}}}, {"hotelId": 3, "title": "zase", "priceInfo": {"regular": {"amount": 1}}}, {"hotelId": 4, "title": "", "priceInfo": {"regular": {"amount": 1}}}, {"hotelId": 5, "title": "jinde", "priceInfo": {"regular": {"amount": 7}}, "destinations": [{"name": "Nikde"}]}]}
    df = spark.createDataFrame([(json.dumps(hotels), "https://h/list")], "body string, url string")
    got = {r.source_offer_key: r for r in tours.hotel_offers(df, "body", "d", "url").collect()}
    assert set(got) == {"3", "5"} and got["5"].country is None and got["5"].locality is None
    r = got["3"]
    assert (r.title, r.country, r.locality, r.stars, r.price_per_person, r.price_total, r.board, r.transport, r.url, r.departure_date) == ("Vila", "Egypt", "Hurghada", None, 5000, 9999, "AI", "flight", "https://h/list", None)


def test_sparkline_points(spark):
    cases = [([100, 200, 150], "3,19 32,3 61,11"), ([5, 5], "3,11 61,11"), ([7], "61,11"), ([], None), (None, None), ([0, 1, 3, 3], "3,19 22.3,13.7 41.7,3 61,3")]
    got = spark.createDataFrame([(p,) for p, _ in cases], "p array<int>").select(labels.sparkline_points(F.col("p"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_released_rows_leave_the_shared_folder(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from sojourn.session import checkpoint_dir, cut, release

    there = lambda: {p.name for p in Path(urlparse(checkpoint_dir(spark)).path).glob("rdd-*")}
    before = there()
    first = cut(spark.range(10))
    second = cut(first.withColumn("x", F.col("id") * 2))
    assert len(there() - before) == 2
    release(first)
    assert len(there() - before) == 1 and second.agg(F.sum("x")).first()[0] == 90
