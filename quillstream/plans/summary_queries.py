"""Queries of small reports, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import classifiers, reports, sections, summaries
from quillstream.plans.classifier_queries import _BRIEFS, BRIEF_ENGINE, _briefs, _engine_sql
from quillstream.plans.gate_queries import _q
from quillstream.sources.briefs import BRIEFS_SQL, briefs

SQL: dict[str, str] = {}
QUERIES = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_ENGINE = f"WITH {_BRIEFS}, {_engine_sql(BRIEF_ENGINE)}"


@_query(f"""SELECT count(*) AS total, {", ".join(f"count(*) FILTER (category = {_q(c)}) AS {c.replace(' ', '_')}" for c in summaries.CATEGORIES)} FROM ({_ENGINE})""")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by the eight categories of the health page, as the rule engine gives them."""
    return summaries.category_pivot(classifiers.engine_classified(_briefs(spark, sf_dir), BRIEF_ENGINE), "category")


@_query(f"""SELECT category, count(*) FILTER (tier = 'A') AS approved, count(*) FILTER (tier = 'C') AS rejected, count(*) FILTER (tier IS NULL OR tier = 'B') AS undecided, CAST(sum(length(reason)) AS BIGINT) AS tokens FROM ({_ENGINE}) GROUP BY category""")
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by category with what they cost; tier A stands for a yes, C for a no."""
    rows = classifiers.engine_classified(_briefs(spark, sf_dir), BRIEF_ENGINE)
    return summaries.verdict_totals(rows.select("category", F.when(F.col("tier") == "A", True).when(F.col("tier") == "C", False).alias("approve"), F.length("reason").alias("tokens")))


_FEEDS_SQL = """f AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'Google News ' ELSE 'NATION_' END || (user_id % 40) AS name, CASE WHEN count(*) FILTER (event_type = 'error') > 4 THEN 'failed' ELSE 'ok' END AS status, count(*) AS fetched,
  count(*) FILTER (event_type = 'purchase' AND value > 80) AS kept FROM events GROUP BY ALL)"""


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("user_id") % 3 == 0, "Google News ").otherwise("NATION_"), F.col("user_id") % 40)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(name.alias("name")).agg(F.count_if(F.col("event_type") == "error").alias("_e"), F.count(F.lit(1)).alias("fetched"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 80)).alias("kept"))
    return rows.select("name", F.when(F.col("_e") > 4, "failed").otherwise("ok").alias("status"), "fetched", "kept")


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    configs = nation.select(F.col("n_name").alias("name"), F.element_at(F.array(*map(F.lit, ["NJ", "PA", "FL", "US", "XX"])), (F.col("n_regionkey") + 1).cast("int")).alias("region"), F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("tier"))
    before = nation.select(F.col("n_name").alias("name"), F.array_repeat(F.lit("ok"), (F.col("n_nationkey") % 23).cast("int")).alias("history"))
    return summaries.configured(_feeds(spark, sf_dir), configs, before)


_CONFIGURED_SQL = f"""WITH {_FEEDS_SQL}, c AS (SELECT f.*, coalesce(['NJ', 'PA', 'FL', 'US', 'XX'][n_regionkey + 1], 'US') AS region, CASE WHEN n_nationkey IS NULL THEN 'C' WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS tier,
  least(20, coalesce(n_nationkey % 23, 0) + 1) AS outcomes FROM f LEFT JOIN nation ON n_name = name)"""


@_query(f"{_CONFIGURED_SQL} SELECT name, status, fetched, kept, region, tier, CAST(outcomes AS INTEGER) AS outcomes, CAST(round(100.0 * kept / fetched) AS BIGINT) || '%' AS kept_rate, fetched > 20 AND kept = 0 AS low_value FROM c")
def configured_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with what their configuration and the run before know of them."""
    return _configured(spark, sf_dir).select("name", "status", "fetched", "kept", "region", "tier", F.size("history").alias("outcomes"), "kept_rate", "low_value")


@_query(f"""{_CONFIGURED_SQL} SELECT CASE WHEN region IN ('NJ', 'PA', 'FL', 'US') THEN region ELSE 'US' END AS region, CAST(sum(kept) AS BIGINT) AS kept, count(*) AS feeds, count(*) FILTER (kept = 0 AND fetched > 0) AS zero_kept,
count(*) FILTER (NOT contains(name, 'Google News')) AS direct, count(*) FILTER (contains(name, 'Google News')) AS searched FROM c GROUP BY 1""")
def region_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept articles and feeds of each region, direct ones and searches."""
    return summaries.region_health(_configured(spark, sf_dir), ["NJ", "PA", "FL", "US"])


@_query(f"WITH {_FEEDS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(fetched), 0) AS BIGINT) AS fetched, CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept FROM f WHERE starts_with(name, 'NATION')")
def scraper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of scraped feeds."""
    return summaries.scraper_summary(_feeds(spark, sf_dir).withColumn("type", F.when(F.startswith("name", F.lit("NATION")), "scraper").otherwise("rss")))


_FEEDBACK_SQL = "fb AS (SELECT CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' END AS action, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reason FROM labels)"


@_query(f"WITH {_FEEDBACK_SQL} SELECT action, NULL::VARCHAR AS reason, count(*) AS n FROM fb WHERE action IS NOT NULL GROUP BY action UNION ALL SELECT action, reason, count(*) FROM fb WHERE action = 'rejected' AND reason <> '' GROUP BY ALL")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved and rejected documents of the labels, rejections by reason."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return summaries.feedback_summary(labels.select(F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").alias("action"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("reason")))


@_query("SELECT DISTINCT source FROM documents WHERE coalesce(source, '') <> ''")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all documents, in order."""
    return summaries.distinct_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@_query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_[^=&]*|mc_[^=&]*|fbclid|gclid)(?:=[^&]*)?(?:&|$))+', '\1', 'g'), '[?&]$', '') AS bare FROM pages")
def strip_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages without the parameters of campaigns."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.without_marketing(F.col("url")).alias("bare"))


_IGNORED = ["moratorium", "Helicopter", "sloth"]


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT *, lower(title || ' ' || coalesce(description, '')) AS t FROM briefs) SELECT ord FROM x WHERE NOT ({" OR ".join(f"contains(t, {_q(w.lower())})" for w in _IGNORED)}) AND ord NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def unless_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that a reader ignores neither by topic nor one by one."""
    ignored = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return reports.unless_ignored(briefs(spark, sf_dir), "ord", sections.text_of(F.col("title"), F.col("description")), _IGNORED, ignored).select("ord")


@_query(f"""WITH {BRIEFS_SQL}, k AS (SELECT ord, pub_ts, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM briefs), s AS (SELECT DISTINCT key FROM k WHERE pub_ts >= DATE '1998-07-07' AND pub_ts < TIMESTAMP '1998-07-21' AND length(key) >= 25 AND ord % 5 = 0)
SELECT ord FROM k WHERE key NOT IN (SELECT key FROM s)""")
def sent_title_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title was not sent in the fortnight before a day; every fifth article stands for a sent one."""
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    rows = briefs(spark, sf_dir)
    sent = rows.where((F.col("ord") % 5 == 0) & (F.col("pub_ts") < F.lit("1998-07-21").cast("timestamp"))).select(key.alias("title_key"), F.col("pub_ts").alias("sent_at"))
    return summaries.unless_sent_title(rows, key, sent, F.lit("1998-07-21")).select("ord")
