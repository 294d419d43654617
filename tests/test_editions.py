import datetime
import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream.functions import display
from quillstream.operators import editions
from quillstream.plans import edition_queries

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def C(spark):
    return [F.col(f"c{k}") for k in range(4)]


def test_titles_and_dates(spark, C):
    assert one(spark, display.normal_title(C[0]), "News | Big Shed Sold! - CoStar Group") == "big shed sold"
    assert one(spark, display.normal_title(C[0]), None) == ""
    when = datetime.datetime(2024, 1, 15, 10, 30)
    for said in ("Mon, 15 Jan 2024 10:30:00 GMT", "Mon, 15 Jan 2024 05:30:00 -0500", "2024-01-15T10:30:00Z"):
        got = spark.createDataFrame([(said,)], "c0 string").select(F.date_format(display.parsed_date(C[0]), "yyyy-MM-dd HH:mm").alias("x")).first().x
        assert got == when.strftime("%Y-%m-%d %H:%M")
    for said in ("soon", "", None, "1985-01-01T00:00:00Z"):
        assert one(spark, display.parsed_date(C[0]), said) is None
    as_of = F.lit("2024-02-01").cast("timestamp")
    assert one(spark, display.valid_date(as_of, C[0], C[1]), "", "2024-01-15T10:30:00Z") is not None
    assert one(spark, display.valid_date(as_of, C[0], C[1]), "2024-03-15", "2024-01-15") is None


def test_shown(spark, C):
    assert one(spark, display.region(C[0]), "Shed in Newark and Tampa") == "NJ"
    assert one(spark, display.region(C[0], C[1]), "Shed in Tampa", "PA") == "PA"
    assert one(spark, display.keywords(C[0]), "Lease of a WAREHOUSE") == ["warehouse", "lease"]
    assert one(spark, display.followable(C[0]), "Acme Realty and acme Blue Harbor buy in Newark, NEWARK") == ["Acme Realty", "Blue Harbor", "Newark"]
    assert one(spark, display.deal_line(C[0], C[1]), "Shed in Edison, NJ", "120,500 SF for $12.5 million") == "Edison, NJ · 121K SF · $12.5M"
    assert one(spark, display.deal_line(C[0], C[1]), None, None) == ""
    for said, badge in (("150,000 SF", "150K SF"), ("$30.50 million", "$30.5M"), ("$1.20 billion", "$1.20B"), ("$3M", None), (None, None)):
        assert one(spark, display.big_deal(C[0]), said) == badge
    assert one(spark, display.excerpt(C[0]), "It cost $1.6B. Done! More.") == "It cost $1.6B. Done!"
    assert one(spark, display.excerpt(C[0], most=20), "a word and another word and more") == "a word and..."
    assert one(spark, display.adds_to_title(C[0], C[1]), "a b c", "a b c and so much more text") is True
    assert one(spark, display.fabricated(C[0], C[1], C[2]), "Sold for $12 million at 5%", "Sold for $12M", "5 % yield, 5% cap") is False
    assert one(spark, display.fabricated(C[0], C[1], C[2]), "Sold for $13 million", "Sold for $12M", None) is True
    assert one(spark, display.fabricated(C[0], C[1], C[2], ("acme",)), "Acme bought", "x", "y") is True
    assert one(spark, display.needs_description(*C), "A big shed was sold", "A big shed was sold The Paper", "x", "y") is True
    assert one(spark, display.needs_description(*C), "A shed", "", "WSJ", "y") is False
    for said, n in ((None, 200), ("x", 200), ("5000", 1000), ("-3", 1), ("12abc", 12)):
        assert one(spark, display.clamped(C[0], 1, 1000, 200), said) == n
    assert one(spark, display.clamped(C[0], 1, 365, 1, low_is_default=True), "0") == 1
    assert one(spark, display.shown_category(C[0]), "Transactions") == "transaction"


def places(t):
    bare = re.sub(r"\s+[-–—|]\s+[^-–—|]*$", "", t).lower()
    return set(re.findall(editions.PLACES, bare)), {m.replace(",", "") for m in re.findall(r"\$\s*(\d[\d,]*)", bare)}


def brute_survivors(rows):
    key = lambda t: re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]", " ", re.sub(r"\s+-\s+[^-]*$", "", t.lower()))).strip()
    words = lambda t: {w for w in key(t).split(" ") if len(w) > 3}
    gone = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if i in gone or j in gone or a[1] != b[1]:
                continue
            x, y = words(a[2]), words(b[2])
            if not x or not y or len(x & y) / len(x | y) < 0.6:
                continue
            if any(p and q and not p & q for p, q in zip(places(a[2]), places(b[2]), strict=True)):
                continue
            rank = lambda r: (any(s in r[3] for s in editions.PREFERRED), len(key(r[2])), r[4])
            gone.add(i if rank(b) > rank(a) else j)
    return {r[0] for k, r in enumerate(rows) if k not in gone}


def test_near_titles(spark):
    rows = [
        (1, "t", "Northern Partners acquire large warehouse portfolio", "blog", 1.0),
        (2, "t", "Northern Partners acquire large warehouse portfolios", "njbiz.com", 1.0),
        (3, "t", "Northern Partners acquire large warehouse portfolio near Newark", "blog", 5.0),
        (4, "t", "Northern Partners acquire large warehouse portfolio near Tampa", "blog", 4.0),
        (5, "t", "Northern Partners acquire large warehouse portfolio for $20 million", "blog", 4.0),
        (6, "t", "Northern Partners acquire large warehouse portfolio for $30 million", "blog", 4.0),
        (7, "p", "Northern Partners acquire large warehouse portfolio", "blog", 4.0),
        (8, "p", "Northern Partners acquire large warehouse portfolio", "blog", 4.0),
        (9, "p", "", "blog", 4.0),
    ]
    df = spark.createDataFrame([*rows, (10, "p", None, None, None)], "id long, section string, title string, source string, score double")
    got = {r.id for r in editions.near_title_survivors(df, "id", "id", "section", "title", "source", "score").collect()}
    assert got == brute_survivors(rows) | {10}
    assert editions.near_title_survivors(df.limit(0), "id", "id", "section", "title", "source", "score").count() == 0


def test_window_and_tiers(spark, C):
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(1, "2024-01-02 12:00:00"), (2, "2024-01-01 12:00:00"), (3, "2024-01-04 00:00:00"), (4, None)], "id long, s string").withColumn("ts", F.col("s").cast("timestamp"))
    ids = lambda n: {r.id for r in editions.adaptive_window(df, "ts", as_of, {"x": (F.lit(True), n)}).collect()}
    assert ids(1) == {1} and ids(2) == {1, 2}
    assert editions.adaptive_window(df.limit(0), "ts", as_of, {"x": (F.lit(True), 1)}).count() == 0
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 0), (5, "b", 0)], "id long, section string, tier int")
    assert {r.id for r in editions.filled_by_tiers(rows, "id", "section", "tier", [F.col("id")], {"a": 2, "b": 1}).collect()} == {1, 2, 4, 5}
    assert [one(spark, editions.cooldown_minutes(C[0].cast("int")), str(n)) for n in range(5)] == [0, 30, 60, 1440, 1440]


@pytest.mark.parametrize("name", sorted(edition_queries.QUERIES))
def test_query_against_sql(spark, name):
    got = edition_queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(map(str, map(tuple, got.select(*cols).collect())))
    if name not in edition_queries.SQL:
        assert rows
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    want = con.sql(edition_queries.SQL[name])
    assert sorted(want.columns) == cols
    assert rows == sorted(map(str, want.select(*cols).fetchall()))
