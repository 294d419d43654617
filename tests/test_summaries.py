"""Small reports and filters on rows with nulls, repeats and nothing at all."""

from datetime import date, datetime

from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import ranking, reports, summaries


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).select(column).first()[0]


def test_category_pivot(spark):
    df = spark.createDataFrame([("people",), (None,), ("",), ("else",), ("transaction",), ("people",)], "category string")
    row = summaries.category_pivot(df, "category").first()
    assert (row.total, row.people, row.not_relevant, row.transaction, row.excluded) == (6, 2, 2, 1, 0)
    assert summaries.category_pivot(df.limit(0), "category").first().total == 0


def test_feeds(spark):
    feeds = spark.createDataFrame([("a", "ok", 30, 0), ("Google News b", "failed", 0, 0), ("c", "ok", 10, 5)], "name string, status string, fetched long, kept long")
    configs = spark.createDataFrame([("a", "NJ", "A"), ("c", "ZZ", None)], "name string, region string, tier string")
    before = spark.createDataFrame([("a", ["x"] * 25)], "name string, history array<string>")
    rows = {r.name: r for r in summaries.configured(feeds, configs, before).collect()}
    assert rows["a"].history == ["x"] * 19 + ["ok"] and rows["a"].low_value and rows["a"].kept_rate == "0%"
    assert rows["Google News b"].region == "US" and rows["Google News b"].tier == "C" and rows["Google News b"].kept_rate == "N/A" and rows["c"].kept_rate == "50%"
    health = {r.region: tuple(r)[1:] for r in summaries.region_health(summaries.configured(feeds, configs, before), ["NJ", "US"]).collect()}
    assert health == {"NJ": (0, 1, 1, 1, 0), "US": (5, 2, 0, 1, 1)}
    total = summaries.scraper_summary(feeds.withColumn("type", F.when(F.col("name") == "c", "scraper"))).first()
    assert tuple(total) == (1, 1, 0, 10, 5)


def test_feedback_supply_and_reserve(spark):
    feedback = spark.createDataFrame([("approved", None), ("rejected", "old"), ("rejected", "old"), ("rejected", ""), (None, "x"), ("other", "x")], "action string, reason string")
    assert sorted(map(str, map(tuple, summaries.feedback_summary(feedback).collect()))) == ["('approved', None, 1)", "('rejected', 'old', 2)", "('rejected', None, 3)"]
    facts = spark.createDataFrame(
        [("relevant", None, True, None, None), ("transactions", True, None, True, None), ("transactions", True, None, None, None), ("availabilities", True, None, None, True), ("people", False, None, None, None), ("people", True, None, None, None), ("other", True, True, True, True)],
        "section string, in_region boolean, not_excluded boolean, routable boolean, industrial boolean",
    )
    reserve = spark.createDataFrame([("people",), ("people",)], "section string")
    assert {r.section: r.candidates for r in summaries.supply_candidates(facts, reserve).collect()} == {"relevant": 1, "transactions": 1, "availabilities": 1, "people": 3}
    pool = spark.createDataFrame([(1, "a", "s1"), (2, "a", "s2"), (3, "a", None), (4, "b", "s1")], "id int, section string, sig string")
    sent, sigs = spark.createDataFrame([(1,), (1,)], "id int"), spark.createDataFrame([("s1",), ("s2",), ("s1",)], "sig string")
    assert {tuple(r) for r in summaries.reserve_stats(pool, sent, sigs).collect()} == {("a", 3, 1, 1, 1), ("b", 1, 0, 1, 0)}


def test_shown_and_sent_titles(spark):
    items = spark.createDataFrame([("e", s, k) for s in ("relevant", "people", "week", "odd") for k in range(12)], "edition string, section string, place int")
    count = lambda kind: {r.section: r["count"] for r in summaries.shown(items, kind).groupBy("section").count().collect()}
    assert count("work") == {"relevant": 6, "people": 6, "week": 5} and count("goth") == {"relevant": 10, "people": 6}
    rows = spark.createDataFrame([(1, "a title that is long enough to count"), (2, "short"), (3, None)], "id int, t string")
    sent = spark.createDataFrame([("a title that is long enough to count", date(2024, 1, 10)), ("short", date(2024, 1, 10))], "title_key string, sent_at date")
    left = lambda day: {r.id for r in summaries.unless_sent_title(rows, F.col("t"), sent, F.lit(day)).collect()}
    assert left("2024-01-15") == {2, 3} and left("2024-02-15") == {1, 2, 3}
    verdicts = spark.createDataFrame([("a", True, 5), ("a", False, None), (None, None, 1)], "category string, approve boolean, tokens int")
    assert {tuple(r) for r in summaries.verdict_totals(verdicts).collect()} == {("a", 1, 1, 0, 5), ("unclassified", 0, 0, 1, 1)}


def test_mended_filters(spark):
    assert one(spark, text.without_marketing(F.col("c0")), "https://x.org/a?utm_any=1&b=2&mc_zz=3&gclid=4#top") == "https://x.org/a?b=2"
    assert one(spark, text.without_marketing(F.col("c0")), "https://x.org/?utm_id&fbclid=1") == "https://x.org/"
    for title in ("Hall", "𝔸 hall 🏭", "é", ""):
        units = title.encode("utf-16-be")
        assert one(spark, ranking.placeholder_index(F.col("c0"), 7), title) == sum(units[k] * 256 + units[k + 1] for k in range(0, len(units), 2)) % 7
    before = spark.createDataFrame([(1, "scraper", True), (2, "rss", False)], "id int, kind string, scraped boolean")
    now = before.limit(0)
    assert [r.id for r in ranking.carried_over(now, before, "id", "kind", F.col("scraped")).collect()] == [1]
    backups = spark.createDataFrame([("bloomberg.com", "n", True)], "domain string, name string, enabled boolean")
    scraped = spark.createDataFrame([("Bloomberg", True, 9)], "domain string, ok boolean, fetched int")
    assert [r.enabled for r in ranking.toggled_backups(backups, scraped, 3).collect()] == [False]
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), "a", None, "x", "s"), (2, datetime(2024, 1, 9), "a", "b", "x", "s"), (3, None, "a", "b", "x", "s")], "id int, ts timestamp, title string, description string, category string, source string")
    as_of = F.lit("2024-02-05").cast("timestamp")
    assert [r.id for r in reports.page_filtered(rows, "ts", as_of, sort="newest").collect()] == [2, 1, 3] and [r.id for r in reports.page_filtered(rows, "ts", as_of, sort="oldest").collect()] == [3, 1, 2]
    assert {r.id for r in reports.within_feed(rows, "ts", as_of).collect()} == {2, 3}
    ignored = spark.createDataFrame([(2,), (None,)], "id int")
    assert {r.id for r in reports.unless_ignored(rows, "id", F.concat_ws(" ", "title", "description"), ["B"], ignored).collect()} == {1}
    assert {r.id for r in reports.unless_ignored(rows, "id", F.col("title"), [], ignored).collect()} == {1, 3}
