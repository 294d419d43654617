"""Queries of the growing store and of pages, with SQL of the same rows where order does not bind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import scorer_title
from quillstream.operators import pages, signatures
from quillstream.operators.rounds import scratch, written
from quillstream.operators.store import KeyIndex, repeats_over_sends
from quillstream.plans.gate_queries import _q
from quillstream.plans.report_queries import _GROUPS, _STATES
from quillstream.sources.briefs import BRIEFS_SQL, briefs

SQL: dict[str, str] = {}
QUERIES = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_LINK, _HEADING = r'href="([^"]+)"', r"<h[1-6][^>]*>([^<]+)</h[1-6]>"


def _places(pattern: str) -> str:
    """Starts (from 0) and texts of all matches: what stands between them and before them is added up."""
    return f"""list_transform(range(1, len(regexp_extract_all(html, {_q(pattern)})) + 1), lambda k: {{
  'start': CAST(list_sum(list_transform(string_split_regex(html, {_q(pattern)})[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(html, {_q(pattern)})[1:k - 1], lambda x: length(x))), 0) AS INTEGER),
  'size': length(regexp_extract_all(html, {_q(pattern)})[k]), 'value': regexp_extract_all(html, {_q(pattern)}, 1)[k]}})"""


@_query(f"""WITH p AS (SELECT page_id, {_places(_LINK)} AS links, {_places(_HEADING)} AS heads FROM pages),
l AS (SELECT page_id, unnest(links) AS l, heads FROM p),
m AS (SELECT page_id, l.start AS char_at, l.value AS link, trim(list_filter(heads, lambda h: h.start >= l.start - 500 AND h.start + h.size <= l.start + 500)[1].value) AS title FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY char_at) AS k FROM m)
SELECT page_id, char_at, link, title FROM f WHERE k = 1 AND length(title) >= 16""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all pages with the heading beside them."""
    return pages.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", _LINK, "1-6")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles (id, batch, keys) with the keys that a store knows them by; a year is a batch."""
    rows = briefs(spark, sf_dir)
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    keys = F.array(F.concat(F.lit("u:"), F.regexp_extract("url", "[^?]*", 0)), F.concat(F.lit("t:"), scorer_title(F.col("title"))), F.concat(F.lit("s:"), signatures.deal_signature(text, _GROUPS, _STATES)))
    return written(rows.select(F.col("ord").alias("id"), F.year("pub_ts").alias("batch"), keys.alias("keys")))


@_query()
def store_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are new when the years come one after the other into a store that starts empty; bound by order, tested against one pass."""
    rows = batches(spark, sf_dir)
    index = KeyIndex(spark, scratch(spark, "key-index"))
    kept = None
    for (year,) in sorted(rows.select("batch").distinct().collect()):
        new = index.admit(str(year), rows.where(F.col("batch") == year), "id", "id", F.col("keys"))
        kept = new if kept is None else kept.unionByName(new)
    return (rows.limit(0) if kept is None else kept).select("id", "batch")


_SIGS = "list_filter([CASE WHEN ord % 3 > 0 THEN 'p' || (ord % 701) END, CASE WHEN ord % 4 = 0 THEN 'q' || (ord // 7 % 311) END], lambda x: x IS NOT NULL)"


@_query(f"""WITH {BRIEFS_SQL}, s AS (SELECT CAST(date_trunc('week', pub_ts) AS DATE) AS send, ord AS item, {_SIGS} AS sigs FROM briefs), e AS (SELECT send, item, unnest(sigs) AS sig FROM s), f AS (SELECT sig, min(send) AS first FROM e GROUP BY sig),
r AS (SELECT send, item, bool_or(first < send) AS repeated FROM e JOIN f USING (sig) GROUP BY send, item) SELECT s.send, s.item, coalesce(r.repeated, false) AS repeated FROM s LEFT JOIN r ON s.send = r.send AND s.item = r.item""")
def repeats_over_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article's signature was sent in an earlier week."""
    ord_ = F.col("ord")
    sigs = F.array_compact(F.array(F.when(ord_ % 3 > 0, F.concat(F.lit("p"), ord_ % 701)), F.when(ord_ % 4 == 0, F.concat(F.lit("q"), F.floor(ord_ / 7) % 311))))
    rows = briefs(spark, sf_dir).select(F.date_trunc("week", F.col("pub_ts")).cast("date").alias("send"), ord_.alias("item"), sigs.alias("sigs"))
    return repeats_over_sends(rows, "send", "item", "sigs")
