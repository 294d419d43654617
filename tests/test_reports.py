"""Reports, interface filters, and functions that no query covers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import dedup, health, ranking, reports, signatures
from quillstream.sources import sinks
from quillstream.streaming import ingest


def test_delivery_and_titles(spark):
    df = spark.createDataFrame([(10, False), (31, False), (75, True), (900, False)], "late int, manual boolean")
    assert [r[0] for r in df.orderBy("late").select(reports.delivery_score(F.col("late"), F.col("manual"))).collect()] == [100, 99, 92, 90]
    titles = spark.createDataFrame([("Long enough to be a title",), ("Short title",), ("Onewordthatisverylongindeed",), ("Industrial news of – Page 360",), (None,)], "t string")
    assert [r[0] for r in titles.select(reports.broken_title(F.col("t"))).collect()] == [False, True, True, True, True]


def test_region_leak(spark):
    rows = [("Chester and Peru compared", "relevant", False, False), ("Chester and Peru compared", "transactions", False, True), ("Peru hall sold", "relevant", True, False), ("Chester hall and more - Peru Post", "relevant", False, True), ("Chester hall", "relevant", False, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, s string, routed boolean, want boolean")
    got = df.orderBy("k").select(reports.region_leak(F.col("t"), F.lower("t"), F.col("s"), F.col("routed"), r"\bperu\b", r"\bchester\b", r"\breit\b")).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_supply_status(spark):
    rows = [("a", "transactions", 1, 5, 3, 20), ("a", "relevant", 0, 4, 0, 9), ("a", "people", 0, 0, 0, 3), ("b", "people", 0, 0, 0, 0), ("b", "relevant", 0, 0, 0, 7)]
    df = spark.createDataFrame(rows, "e string, section string, selected int, in_window int, passed int, candidates int")
    got = {r.e: r for r in reports.supply_status(df, "e", "section", "selected", "in_window", "passed", "candidates").collect()}
    assert (got["a"].supply, got["a"].editorial_coverage, got["a"].supply_score) == ("Rich", 30 * 10 / 18, 33)
    assert (got["b"].supply, got["b"].editorial_coverage, got["b"].supply_score) == ("Thin", 30.0, 0)


def test_sets_and_flags(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, reports.stage_difference(a, b, "id").collect())) == [(1, "dropped"), (3, "added")]
    assert sorted(map(tuple, reports.with_flag(a, "id", b, "there").collect())) == [(1, "x", False), (2, "y", True)]
    assert sorted(map(tuple, reports.with_picks(a, b, "id").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert [tuple(r) for r in reports.fetch_totals(reports.fetch_report(a.limit(0), "v", F.lit(True), F.lit(True))).collect()] == [(0, 0, 0, 0, 0)]


def test_requests(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, "c" if k < 7 else "d", at + dt.timedelta(seconds=10 * k)) for k in range(9)]
    df = spark.createDataFrame(rows, "k int, client string, ts timestamp")
    got = {r.k: r.status for r in reports.request_verdicts(df, "client", "ts", [F.col("ts"), F.col("k")], most=3).collect()}
    assert [got[k] for k in range(9)] == [200, 200, 200, 429, 429, 429, 200, 200, 200]
    counts = {(r.client, r.n) for r in ingest.requests_by_window(df, "ts", "client").collect()}
    assert counts == {("c", 6), ("c", 1), ("d", 2)}


def test_reserve(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(1, "a", "s1", day, 9), (2, "a", "s1", day, 8), (3, "a", None, day, 7), (4, "a", None, day, 6), (5, "b", "s2", day, 5), (6, "b", "s3", day, 4), (7, "b", "s4", dt.datetime(2023, 1, 1), 3)]
    df = spark.createDataFrame(rows, "id int, section string, sig string, ts timestamp, score int")
    sent, sigs = spark.createDataFrame([(6,)], "id int"), spark.createDataFrame([("s2",)], "signature string")
    got = reports.reserve(df, "id", "section", "sig", "ts", [F.desc("score"), F.col("id")], F.lit("2024-06-01").cast("timestamp"), sent, sigs, most=2)
    assert sorted((r.section, r.place, r.id) for r in got.collect()) == [("a", 1, 1), ("a", 2, 3)]


def test_without_query(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, keys array<string>")
    assert sorted(r.id for r in dedup.unless_overlapping(rows, "id", "keys", spark.createDataFrame([("b",), ("x",)], "k string"), "k").collect()) == [2, 3]
    log = spark.createDataFrame([(1, dt.datetime(2024, 5, 1)), (2, dt.datetime(2024, 1, 1))], "id int, sent_at timestamp")
    new = spark.createDataFrame([(1, dt.datetime(2024, 5, 9)), (3, dt.datetime(2024, 5, 9)), (3, dt.datetime(2024, 5, 10))], "id int, sent_at timestamp")
    assert sorted(r.id for r in sinks.appended_log(log, new, F.lit("2024-05-20").cast("date")).collect()) == [1, 3]
    sections = spark.createDataFrame([("e", "transactions", 2, 3), ("e", "relevant", 0, 0), ("e", "people", 0, 4)], "e string, s string, filled int, supply int")
    assert [r.coverage for r in health.coverage(sections, "e", "s", "filled", "supply").collect()] == [14.0]
    item = spark.createDataFrame([("i", "u", "t", "x" * 250, dt.datetime(2024, 1, 1))], "id string, link string, title string, description string, pub_ts timestamp")
    assert json.loads(sinks.json_feed_items(item).first().value)["summary"] == "x" * 200 + "..."
    pages = spark.createDataFrame([(403, "text/html", ""), (200, "text/html", "please subscribe to continue"), (200, "text/html", "hall sold")], "status int, kind string, body string")
    assert [r[0] for r in pages.select(text.access_status(F.col("status"), F.col("kind"), F.col("body"))).collect()] == ["blocked", "paywalled", "ok"]
    hosts = spark.createDataFrame([("HTTP://me@WWW.Site.org/a",), ("none",)], "u string")
    assert [r[0] for r in hosts.select(text.host(F.col("u"))).collect()] == ["site.org", None]


def test_page_filters(spark):
    at = dt.datetime(2024, 5, 1)
    rows = [(1, "Hall in Peru", "x", "deals", "s", at), (2, None, "a hall", "deals", "s", at), (3, "Hall", None, "excluded", "s", at), (4, "Hall", None, None, "t", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id int, title string, description string, category string, source string, ts timestamp")
    ids = lambda **how: sorted(r.id for r in reports.page_filtered(df, "ts", F.lit("2024-05-02").cast("timestamp"), **how).collect())
    assert ids() == [1, 2, 4] and ids(days=30) == [1, 2] and ids(query="HALL") == [1, 2, 4] and ids(region="peru") == [1] and ids(source="t") == [4] and ids(category="deals") == [1, 2]
    assert [r.id for r in reports.items_filtered(df.withColumn("regions", F.array(F.lit("PE"))), "id", "ts", F.lit("2023-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp"), "PE", None, 3).collect()] == [1, 2, 3]


def test_entity_survivors_match_one_pass(spark):
    import random

    rng = random.Random(3)
    firms, markets = ["prologis", "jll"], {"peru": "peru", "chester": "chester", "westchester": "w"}
    rows = [(k, f"{rng.choice(['prologis', 'jll', 'nobody'])} buys {rng.choice(['40k sf hall', '41k sf hall', '90k sf hall', 'hall'])} in {rng.choice(['peru', 'westchester'])}{rng.choice(['', ' for $20m', ' for $90m'])}") for k in range(150)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    keys = {r.id: (r.key, r.sf, r.m) for r in df.select("id", signatures.entity_key(F.col("t"), firms, markets).alias("key"), signatures.square_feet(F.col("t"), False).alias("sf"), signatures.millions(F.col("t"), False).alias("m")).collect()}
    bucket = lambda x, n: None if x is None else int(x / n + 0.5)
    kept, want = [], set()
    for k, _ in rows:
        key, sf, m = keys[k]
        same = lambda o: o[0] == key and (None in (o[1], sf) or bucket(o[1], 10_000) == bucket(sf, 10_000)) and (None in (o[2], m) or bucket(o[2], 5) == bucket(m, 5))  # noqa: B023, E731
        if key is None or not any(map(same, kept)):
            want.add(k)
            kept += [keys[k]] if key is not None else []
    assert {r.id for r in signatures.entity_survivors(df, "id", "id", F.col("t"), firms, markets).collect()} == want


def test_ranking_upkeep(spark):
    now, before = spark.createDataFrame([(1, "a")], "id int, kind string"), spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, kind string")
    assert sorted(map(tuple, ranking.carried_over(now, before, "id", "kind").collect())) == [(1, "a"), (3, "b")]
    backups = spark.createDataFrame([("x.com", "n1", True), ("y.com", "n2", False), ("z.com", "n3", True)], "domain string, name string, enabled boolean")
    scraped = spark.createDataFrame([("x.com", True, 9), ("y.com", True, 1)], "domain string, ok boolean, fetched int")
    assert sorted((r.name, r.enabled, r.changed) for r in ranking.toggled_backups(backups, scraped, 3).collect()) == [("n1", False, True), ("n2", True, True), ("n3", True, False)]
    store, status = ranking.point_updates(spark.createDataFrame([(1, "p"), (2, "q")], "id int, category string"), spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 3)], "id int, category string, ord int"), "id", "category")
    assert sorted(map(tuple, store.collect())) == [(1, "y"), (2, "q")] and sorted((r.id, r.status) for r in status.collect()) == [(1, 200), (1, 200), (9, 404)]
    titles = spark.createDataFrame([("Hall sold - WXYZ", "s", "u"), ("Hall - build.example.org", "s", "u"), ("Hall", "Google News nj halls", "u"), ("Hall", "news.google.com", "u"), ("Hall", "Own", "https://a.known.com/x"), ("Hall", None, None)], "t string, s string, u string")
    got = [r[0] for r in titles.select(ranking.publisher(F.col("t"), F.col("s"), F.col("u"), {"known.com": "Known"})).collect()]
    assert got == ["WXYZ", "build.example.org", "NJ Halls", "Google News", "Known", "Source"]
