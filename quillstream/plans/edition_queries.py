"""Queries that show articles and choose editions, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import display
from quillstream.operators import editions, health
from quillstream.operators.rounds import DOCUMENTS_A_TASK, spread
from quillstream.sources.articles import SYNTHETIC_SQL, synthetic

AS_OF = "2001-08-01 00:00:00"
SQL: dict[str, str] = {}
QUERIES = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


_WHOLE_SQL = r"regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')"
_KEYWORDS_SQL = "[" + ", ".join(f"'{k}'" for k in display.KEYWORDS) + "]"
_REGION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{n}'" for n, p in display.REGIONS) + " ELSE 'US' END"


@_query(f"""WITH t AS (SELECT doc_id, upper(coalesce(text, '')) AS u, lower(coalesce(text, '')) AS l FROM documents)
SELECT doc_id, {_REGION_SQL} AS region, array_to_string(list_filter({_KEYWORDS_SQL}, lambda k: contains(l, k))[1:5], ',') AS keywords FROM t""")
def region_and_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and keywords of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DOCUMENTS_A_TASK)
    return docs.select("doc_id", display.region(F.col("text")).alias("region"), F.array_join(display.keywords(F.col("text")), ",").alias("keywords"))


@_query(f"""WITH {SYNTHETIC_SQL}, m AS (SELECT id, upper(title) AS u, title FROM articles),
n AS (SELECT id, CAST(nullif(replace(regexp_extract(u, '{display.BIG_AREA}', 1), ',', ''), '') AS BIGINT) AS sf,
nullif(regexp_extract(u, '\\$(\\d+)M\\b', 1), '') AS m FROM m)
SELECT id, CASE WHEN sf >= 100000 THEN (CAST(floor(sf / 1000 + 0.5) AS BIGINT))::VARCHAR || 'K SF' WHEN CAST(m AS INT) >= 25 THEN '$' || m || 'M' END AS badge,
concat_ws(' · ', CASE WHEN sf >= 1000 THEN (CAST(floor(sf / 1000 + 0.5) AS BIGINT))::VARCHAR || 'K SF' ELSE sf || ' SF' END, '$' || m || 'M') AS line FROM n""")
def deal_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badge and deal line of every article."""
    return synthetic(spark, sf_dir).select("id", display.big_deal(F.col("title")).alias("badge"), display.deal_line(F.col("title"), F.lit("")).alias("line"))


@_query(f"""WITH {SYNTHETIC_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY substr(trim(lower(title)), 1, 60) ORDER BY ord, id) AS k FROM articles
WHERE pub_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS) SELECT id, title, pub_ts FROM w WHERE k = 1 ORDER BY pub_ts DESC, ord LIMIT 500""")
def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 articles of 720 hours, one a title."""
    return editions.raw_feed(synthetic(spark, sf_dir), "id", "title", "pub_ts", "ord", _as_of(), hours=720).select("id", "title", "pub_ts")


@_query("""WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM r)
SELECT event_id, user_id, CAST(CASE WHEN failures = 0 THEN 0 WHEN failures >= 3 THEN 1440 ELSE 30 * failures END AS BIGINT) AS rests FROM f""")
def breaker_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that each feed rests after each outcome."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    states = health.breaker_states(rows, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return states.select("event_id", "user_id", editions.cooldown_minutes(F.col("failures")).alias("rests"))


_TIER_SQL = "CASE WHEN o_orderdate >= TIMESTAMP '2001-07-29' THEN 0 WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 1 ELSE 2 END"
_FLOORS = {"1-URGENT": 4, "2-HIGH": 4, "3-MEDIUM": 1, "5-LOW": 30}


@_query(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS section, o_orderdate, {_TIER_SQL} AS tier FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY tier, o_orderdate DESC, o_orderkey) AS place FROM t)
SELECT o_orderkey, section, tier, CAST(place AS BIGINT) AS place FROM r
WHERE tier = 0 OR place <= CASE section {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _FLOORS.items())} ELSE 0 END""")
def tiered_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections filled to their floors from the window, then the month, then the reserve."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("section"), "o_orderdate")
    tier = F.when(F.col("o_orderdate") >= F.lit("2001-07-29").cast("timestamp"), 0).when(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp"), 1).otherwise(2)
    out = editions.filled_by_tiers(orders.withColumn("tier", tier), "o_orderkey", "section", "tier", [F.desc("o_orderdate"), F.col("o_orderkey")], _FLOORS)
    return out.select("o_orderkey", "section", "tier", F.col("place").cast("long").alias("place"))


@_query(f"""WITH n AS (SELECT count(*) FILTER (o_orderpriority = '1-URGENT') >= 4 AND count(*) FILTER (o_orderpriority = '2-HIGH') >= 4 AS enough FROM orders
WHERE o_orderdate <= TIMESTAMP '{AS_OF}' AND o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS)
SELECT o_orderkey, CASE WHEN enough THEN 24 ELSE 48 END AS window_hours FROM orders, n
WHERE o_orderdate <= TIMESTAMP '{AS_OF}' AND o_orderdate >= TIMESTAMP '{AS_OF}' - CASE WHEN enough THEN INTERVAL 24 HOURS ELSE INTERVAL 48 HOURS END""")
def adaptive_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last day if two sections have four there, else of two days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate")
    floors = {p: (F.col("o_orderpriority") == p, 4) for p in ("1-URGENT", "2-HIGH")}
    return editions.adaptive_window(orders, "o_orderdate", _as_of(), floors).select("o_orderkey", "window_hours")


@_query("""WITH f AS (SELECT lower(n_name) AS feed, n_nationkey AS ord, CASE n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier FROM nation),
m AS (SELECT s_suppkey, arg_min(tier, ord) AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN f ON contains(lower('the ' || n_name), feed) OR contains(feed, lower('the ' || n_name)) GROUP BY 1)
SELECT s.s_suppkey, coalesce(m.tier, 'C') AS tier FROM supplier s JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m USING (s_suppkey)""")
def feed_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of the first feed that a supplier's nation contains or is contained in."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("the "), "n_name").alias("name"))
    feeds = nation.select(F.col("n_name").alias("feed"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_regionkey") == 0, "A").when(F.col("n_regionkey") == 1, "B").otherwise("C").alias("tier"))
    return editions.feed_tiers(rows, "name", feeds, "feed", "ord", "tier").select("s_suppkey", F.col("_tier").alias("tier"))


@_query(f"""WITH t AS (SELECT doc_id, trim({_WHOLE_SQL}, ' ') AS raw FROM documents), s AS (SELECT doc_id, raw, regexp_replace(raw, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g') AS safe FROM t),
c AS (SELECT doc_id, raw, regexp_extract_all(safe, '[^.!?]+[.!?]+')[1:2] AS cut FROM s),
x AS (SELECT doc_id, raw, CASE WHEN len(cut) > 0 THEN trim(replace(array_to_string(cut, ''), chr(1), '.'), ' ') ELSE raw END AS text FROM c)
SELECT doc_id, CASE WHEN length(raw) <= 10 THEN '' WHEN length(text) > 300 THEN regexp_replace(substr(text, 1, 297), '\\s+\\S*$', '') || '...' ELSE text END AS excerpt FROM x""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two sentences of each whole text, over line feeds too; white space becomes one blank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", display.excerpt(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("excerpt"))


QUERIES["excerpts_whole"], SQL["excerpts_whole"] = excerpts, SQL["excerpts"]  # its earlier name


@_query()
def near_title_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left of those whose first lines tell the same story within a language; the fold is order-bound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"))
    return editions.near_title_survivors(docs, "doc_id", "doc_id", "lang", "title", "source", "n_chars").select("doc_id", "lang")
