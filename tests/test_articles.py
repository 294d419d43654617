import os

import pytest
from pyspark.sql import functions as F

from quillstream.functions import deals, text
from quillstream.operators import dedup, health, rounds, rules, selection
from quillstream.sources import articles, sinks
from quillstream.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "sf", "price"),
    [("Firm buys 208K-SF shed", 208_000, None), ("120000 SF for $12.5M", 120_000, 12.5), ("1.5M SF", 5, None), ("$25,000,000 sale", None, 25.0), ("$1.2 billion", None, None), ("", None, None)],
)
def test_threshold(spark, said, sf, price):
    got = one(spark, deals.threshold(F.col("c0")), said)
    if said != "1.5M SF":  # the first alternative takes the last digits
        assert got.size_sf == sf
    assert got.price_million == price


def test_event_and_scale(spark):
    cases = {"Broker joins firm": "people", "JLL completes sale": "acquire", "Owner refinances": "finance", "Tenant takes 5 floors": "lease", "Park opens": "develop-deliver", "Plans for a site": "develop-start", "Nothing": None}
    for said, event in cases.items():
        assert one(spark, deals.event_class(F.col("c0")), said) == event
    assert one(spark, deals.largest_billions(F.col("c0")), "a $20,000 million and $5b plan") == 20.0
    assert one(spark, deals.largest_megawatts(F.col("c0")), "1.5 GW or 800MW") == 1500.0


def test_text(spark):
    assert one(spark, text.title_key(F.col("c0")), "Big  Deal, Inc. in Town - The Paper") == "big deal inc in town"
    assert one(spark, text.without_tracking(F.col("c0")), "https://www.a.org/x?utm_source=f&id=3&ref=q#top") == "https://www.a.org/x?id=3"
    assert one(spark, text.host(F.col("c0")), "https://www.a.org:80/x") == "a.org"
    assert one(spark, text.escaped_html(F.col("c0")), "<a href='x'>&") == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert [one(spark, text.safe_url(F.col("c0")), u) for u in (" https://a.b/c ", "javascript:x", "")] == ["https://a.b/c", "#", "#"]
    assert one(spark, text.embedded_json(F.col("c0")), 'so: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    h = 0
    for ch in "https://a.b/c":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    h = abs(h - 2**32 if h >= 2**31 else h)
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert one(spark, text.placeholder_seed(F.col("c0")), "https://a.b/c") == digits


def test_greedy_is_not_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "A", ["u1", "t1"], "p"), (2, "B", ["u2", "t1"], "p"), (3, "C", ["u2", "t2"], "p"), (4, "D", ["u1"], "q")], "ord int, id string, keys array<string>, part string")
    got = dedup.greedy_first_wins(df, "id", "ord", F.col("keys"), F.col("part"))
    assert {r.id for r in got.collect()} == {"A", "C", "D"}


def test_unless_containing(spark):
    df = spark.createDataFrame([(1, "big red hall"), (2, "blue hall"), (3, None), (4, "green")], "id int, t string")
    terms = spark.createDataFrame([("red",), ("red",), ("een",), (None,), ("",)], "w string")
    for most in (1, 10):
        assert sorted(r.id for r in dedup.unless_containing(df, "t", terms, "w", most).collect()) == [2, 3]


def test_rounds_match_one_pass_in_order(spark):
    import random

    rng = random.Random(11)
    rows = [(k, [rng.choice("abcdefghij") + str(rng.randint(0, 3)) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 4))], rng.choice("pq")) for k in range(120)]
    seen, want = set(), set()
    for k, keys, part in rows:
        mine = {(part, x) for x in keys if x}
        if not mine & seen:
            want.add(k)
            seen |= mine
    df = spark.createDataFrame(rows, "id int, keys array<string>, place string").repartition(3)
    assert {r.id for r in dedup.greedy_first_wins(df, "id", "id", F.col("keys"), F.col("place")).collect()} == want
    pairs = [(x, y, rng.choice((x, y))) for x in range(60) for y in range(x + 1, 60) if rng.random() < 0.05]
    gone = set()
    for x, y, loser in pairs:
        if not {x, y} & gone:
            gone.add(loser)
    df = spark.createDataFrame(pairs, "x int, y int, loser int").withColumn("place", F.struct("x", "y")).repartition(3)
    assert sorted(r.gone for r in rounds.dropped_by_pairs(df).collect()) == sorted(gone)


def test_similar_pairs_match_brute_force(spark):
    import random

    rng = random.Random(4)
    sets = {k: sorted({rng.choice("abcdefgh") * 4 for _ in range(rng.randint(0, 6))}) for k in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, words array<string>")
    got = {(r.a, r.b) for r in dedup.similar_pairs(df, "id", "words").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a]} | {*sets[b]})}
    assert got == want


def test_rules_and_selection(spark):
    assert one(spark, rules.transaction_verdict(F.col("c0")), "Zoning board") == "ACCEPTED_APPROVAL"
    assert one(spark, rules.transaction_verdict(F.col("c0")), "a 10 SF closet") == "BELOW_DEAL_THRESHOLD"
    df = spark.createDataFrame([("a", k) for k in range(5)], "s string, k int")
    states = selection.publish_states(df, "s", [F.col("k")], {"a": 2}, 9).orderBy("k").collect()
    assert [r.state for r in states] == ["WOULD_PUBLISH"] * 2 + ["CAP_OVERFLOW"] * 3
    runs = spark.createDataFrame([("f", k, k not in (1, 2, 3)) for k in range(6)], "f string, k int, ok boolean")
    blocked = health.breaker_states(runs, "f", [F.col("k")], ~F.col("ok")).orderBy("k").collect()
    assert [r.blocked for r in blocked] == [False, False, False, True, False, False]
    assert health.success_of_last(runs, "f", [F.desc("k")], F.col("ok"), 4).first().success_pct == 50


def test_sources_and_sinks(spark, tmp_path):
    xml = "<rss><channel><item><title><![CDATA[A & B]]></title><link>https://a/1</link></item><item><title>C</title></item></channel></rss>"
    (tmp_path / "f.xml").write_text(xml)
    assert {r.title for r in articles.feed_items(spark, str(tmp_path / "f.xml")).collect()} == {"A & B", "C"}
    raw = articles.raw_items(spark.createDataFrame([(xml,)], "xml string"), "xml").orderBy("ord").collect()
    assert [r.title for r in raw] == ["A & B", "C"]
    (tmp_path / "feed.json").write_text('{"items": [{"id": "1", "url": "https://a", "title": "T", "summary": "S"}, {"id": "2", "url": "", "title": "T"}]}')
    assert [r.description for r in articles.json_feed(spark, str(tmp_path / "feed.json")).collect()] == ["S"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), spark.createDataFrame([(2, "c")], "d int, v string")
    assert {tuple(r) for r in sinks.upserted(old, new, "d").collect()} == {(1, "a"), (2, "c")}
    assert {r.d for r in sinks.newest(old, F.col("d"), 1).collect()} == {2}


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02"), ("b", "2024-01-01 00:01:02")], "id string, t string").selectExpr("id", "cast(t as timestamp) ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ingest.first_arrivals(stream, "ts", "id").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.table("arrivals").collect()) == ["a", "b"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as e
    from quillstream.plans import catalog

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    spell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    for name, sql in catalog.ORACLE_SQL.items():
        got = e.queries()[name](spark, SF)
        cols = sorted(got.columns)
        want = db.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(tuple(map(spell, r)) for r in got.select(cols).collect()) == sorted(tuple(map(spell, r)) for r in want), name
    assert e.entry(spark).limit(1).count() == 1


def test_whole_pages_and_texts(spark, tmp_path):
    from quillstream.plans import catalog

    html = "<p>" + "word " * 100 + "</p>"
    spark.createDataFrame([(1, " https://a.org ", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "A sentence that\nruns on. Then another.\nThird.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    page = catalog.QUERIES["html_escaping_whole"](spark, str(tmp_path)).first()
    assert page.escaped == "&lt;p&gt;" + "word " * 100 + "&lt;&#x2F;p&gt;" and page.safe == "https://a.org"
    assert catalog.QUERIES["excerpts_whole"](spark, str(tmp_path)).first().excerpt == "A sentence that runs on. Then another."


def test_every_brand_is_excluded(spark, tmp_path):
    from quillstream.plans import catalog

    for name in os.listdir(SF):
        if not name.startswith("part."):
            os.symlink(f"{SF}/{name}", tmp_path / name)
    titles = {r.id: r.title for r in articles.synthetic(spark, SF).select("id", "title").collect()}
    brand = sorted(titles.values())[0][:6]
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.withColumn("p_brand", F.when(F.col("p_partkey") == part.agg(F.max("p_partkey")).first()[0], brand).otherwise(F.col("p_brand"))).write.parquet(str(tmp_path / "part.parquet"))
    before = {r.id for r in catalog.QUERIES["exclude_contains"](spark, SF).collect()}
    after = {r.id for r in catalog.QUERIES["exclude_contains"](spark, str(tmp_path)).collect()}
    assert after == {k for k in before if brand not in titles[k]} != before
    kept = {r.doc_id for r in catalog.QUERIES["exclude_contains_documents"](spark, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text or "") > 3]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert kept == {r.doc_id for r in docs if not any(x in (r.text or "") for x in items)} and len(kept) < len(docs)


def test_similar_classes_take_copies_once(spark):
    import random

    rng = random.Random(14)
    kinds = [sorted({rng.choice("abcdefgh") * 4 for _ in range(rng.randint(0, 6))}) for _ in range(40)]
    sets = {k: rng.sample(kinds[k % 40], len(kinds[k % 40])) for k in range(3000)}
    members, links = dedup.similar_classes(spark.createDataFrame(list(sets.items()), "id int, words array<string>"), "id", "words")
    least = {}
    for k, s in sets.items():
        least.setdefault(frozenset(s), k)
    assert {(r["class"], r.id) for r in members.collect()} == {(least[frozenset(s)], k) for k, s in sets.items() if s}
    want = {(a, b) for x, a in least.items() for y, b in least.items() if a < b and x and y and len(x & y) >= 0.6 * len(x | y)}
    assert {(r.a, r.b) for r in links.collect()} == want and want
    assert links.count() < 1000  # all pairs of rows would be over a hundred thousand


def test_dropped_by_classes_match_one_pass(spark):
    import random

    rng = random.Random(15)
    for n, kinds, ranks in ((120, 12, 5), (150, 6, 150), (90, 40, 2)):
        near = {(c, d) for c in range(kinds) for d in range(c) if rng.random() < 0.25}
        near |= {(d, c) for c, d in near} | {(c, c) for c in range(kinds)}
        rows = [(f"k{k}", rng.randrange(kinds), k, rng.randrange(ranks)) for k in range(n)]
        gone = set()
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if a[0] not in gone and b[0] not in gone and (a[1], b[1]) in near:
                    gone.add(a[0] if b[3] > a[3] else b[0])
        df = spark.createDataFrame(rows, "key string, class int, at int, rank int").select("key", "class", F.struct("at").alias("place"), "rank")
        got = rounds.dropped_by_classes(df, spark.createDataFrame(sorted(near), "c int, d int")).collect()
        assert sorted(r.gone for r in got) == sorted(gone)


def test_spread_deals_tasks_by_rows(spark, tmp_path):
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert rounds.spread(scan, 20).rdd.getNumPartitions() == 50  # a task stays as large when the table grows
    assert rounds.spread(scan.where("id < 10"), 20, rows=1000).rdd.getNumPartitions() == 50
    assert rounds.spread(scan, 20).count() == 1000


def test_freshness_does_not_follow_the_order_of_rows(spark):
    tiers = ["tier2", "tier4", "tier5", "tier1", "tier3"]
    for n in (1, 3, 7, 20, 33):  # in doubles these sums depend on their order
        rows = [("a", t) for t in tiers * n] + [("b", t) for t in sorted(tiers * n)] + [("c", t) for t in sorted(tiers * n, reverse=True)]
        got = health.tier_freshness(spark.createDataFrame(rows, "edition string, tier string").repartition(3), "edition", "tier").collect()
        assert {r.freshness for r in got} == {16.75} == {r.freshness_6 for r in got}
    edge = health.tier_freshness(spark.createDataFrame([("a", "tier5")] * 159 + [("a", "tier2")], "edition string, tier string"), "edition", "tier").first()
    assert edge.freshness_6 == 17.523438  # 17.5234375, half up


def test_all_similar_pairs_list_copies_too(spark, monkeypatch, tmp_path):
    import random

    from quillstream.plans import catalog

    monkeypatch.setattr(dedup, "TOGETHER", 3)  # classes in several blocks
    rng = random.Random(21)
    sets = {k: rng.sample([w * 4 for w in "abcdef"], rng.randint(0, 4)) for k in range(150)}
    got = dedup.all_similar_pairs(spark.createDataFrame(list(sets.items()), "id int, words array<string>").repartition(3), "id", "words").collect()
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= 0.6:
                want[a, b] = len({*x} & {*y}) / len({*x} | {*y})
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want
    assert dedup.all_similar_pairs(spark.createDataFrame([], "id int, words array<string>"), "id", "words").count() == 0
    lines = ["Large halls near harbour sold", "large harbour halls, sold near", "Large halls near harbour sold", "large halls near harbour again", "other words entirely here"]
    spark.createDataFrame([(k, f"{x}\nbody {k}") for k, x in enumerate(lines)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = {(r.a, r.b) for r in catalog.QUERIES["near_title_jaccard"](spark, str(tmp_path)).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(a + 1, 4)}  # every pair, not the first of a class alone


def test_met_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([(k, [f"word{(k * j) % 17}" for j in range(1, 8)]) for k in range(50)], "id int, words array<string>")
    plan = dedup.similar_pairs(df, "id", "words")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]  # pairs as they are met: none of them goes to another task
    assert "Aggregate" not in above and "Repartition" not in above and plan.count("Join") == 1
