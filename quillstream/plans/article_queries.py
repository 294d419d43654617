"""Queries over the article stream and the tables beside it, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import deals, text, words
from quillstream.functions.signals import decided
from quillstream.operators import dedup, health, rules, sections, selection
from quillstream.plans.gate_queries import _INDUSTRIAL, _PASSES, _TRANSACTIONS, _any, _has, _listing, _wrong
from quillstream.sources.articles import SYNTHETIC_SQL, synthetic

AS_OF = "2024-01-15 00:00:00"
SQL: dict[str, str] = {}
QUERIES = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AREA_SQL = deals.AREA
_DEALS_SQL = f"""WITH {SYNTHETIC_SQL},
m AS (SELECT *, upper(title) AS u FROM articles),
n AS (SELECT *, CAST(nullif(replace(regexp_extract(u, '{_AREA_SQL}', 1), ',', ''), '') AS DOUBLE)
                * CASE regexp_extract(u, '{_AREA_SQL}', 2) WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END AS area,
             CAST(nullif(replace(regexp_extract(u, '{deals.MILLIONS}', 1), ',', ''), '') AS DOUBLE) AS millions FROM m)"""


@_query(f"""{_DEALS_SQL} SELECT id, coalesce(round(area) >= 50000, false) AS meets_sf, coalesce(millions >= 10, false) AS meets_dollar,
CAST(round(area) AS BIGINT) AS size_sf, millions AS price_million FROM n""")
def deal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and price thresholds of every article."""
    return synthetic(spark, sf_dir).select("id", deals.threshold(F.col("title")).alias("t")).select("id", "t.*")


@_query(f"""{_DEALS_SQL} SELECT id, CASE WHEN area >= 100000 THEN 3 WHEN area >= 50000 THEN 2 WHEN area >= 25000 THEN 1 ELSE 0 END
+ CASE WHEN millions IS NOT NULL AND (contains(u, 'BILLION') OR contains(u, 'B ')) THEN 3 WHEN millions >= 25 THEN 2 WHEN millions >= 10 THEN 1 ELSE 0 END AS deal_score FROM n""")
def deal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for size and price of every article."""
    return synthetic(spark, sf_dir).select("id", deals.deal_score(F.col("title")).alias("deal_score"))


@_query(f"""{_DEALS_SQL}, v AS (SELECT *, lower(title) AS t, NULL::BOOLEAN AS approved, round(area) AS sf, millions AS price FROM n),
w AS (SELECT *, {_any("t", words.POLITICAL)} AS political, {_INDUSTRIAL} IN {_PASSES} AS industrial, {_wrong("t")} AND NOT {_has("t", words.STRONG_ASSET)} AS wrong, {_listing("t")} AS listing FROM v),
x AS (SELECT *, {_TRANSACTIONS} AS reason, CASE WHEN area >= 100000 THEN 3 WHEN area >= 50000 THEN 2 WHEN area >= 25000 THEN 1 ELSE 0 END + CASE WHEN millions >= 25 THEN 2 WHEN millions >= 10 THEN 1 ELSE 0 END AS deal_score FROM w),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY deal_score DESC, pub_ts DESC, ord) AS INTEGER) AS rank FROM x WHERE starts_with(reason, 'ACCEPTED'))
SELECT source, rank, id, title, deal_score, reason FROM r WHERE rank <= 10""")
def transaction_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best transactions of each source by the section's whole filter, by deal score and then date."""
    no_verdict = F.lit(None).cast("boolean")
    rows = decided(synthetic(spark, sf_dir), {"text": F.lower("title")}, lambda text: {"reason": sections.transaction_verdict(text, no_verdict)})
    scored = rows.where(F.col("reason").startswith(sections.ACCEPTED)).withColumn("deal_score", deals.deal_score(F.col("title")))
    return selection.top_of_each(scored, "source", [F.desc("deal_score"), F.desc("pub_ts"), F.col("ord")], 10, "rank").select("source", "rank", "id", "title", "deal_score", "reason")


@_query(f"""{_DEALS_SQL} SELECT source, CASE WHEN round(area) >= 50000 OR millions >= 10 THEN 'ACCEPTED_THRESHOLD' ELSE 'BELOW_DEAL_THRESHOLD' END AS reason, count(*) AS n FROM n GROUP BY 1, 2""")
def rejection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by section and verdict."""
    return rules.funnel(synthetic(spark, sf_dir).withColumn("reason", rules.transaction_verdict(F.col("title"))), "source", "reason")


_EVENT_SQL = "CASE WHEN regexp_matches(l, '{people}') AND NOT regexp_matches(l, '{other}') THEN 'people' ".format(people=deals.PEOPLE, other=deals.NOT_PEOPLE) + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for n, p in deals.EVENTS) + " END"


@_query(f"WITH {SYNTHETIC_SQL}, m AS (SELECT *, lower(title) AS l FROM articles) SELECT id, {_EVENT_SQL} AS event FROM m")
def deal_event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that every article tells of."""
    return synthetic(spark, sf_dir).select("id", deals.event_class(F.col("title")).alias("event"))


@_query(f"""WITH {SYNTHETIC_SQL}, m AS (SELECT *, lower(title) AS l FROM articles), e AS (SELECT *, {_EVENT_SQL} AS event FROM m)
SELECT coalesce(event, 'none') AS category, place, count(*) AS n, min(pub_ts) AS first_ts, max(pub_ts) AS last_ts FROM e GROUP BY 1, 2""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by event and place."""
    rows = synthetic(spark, sf_dir).withColumn("category", F.coalesce(deals.event_class(F.col("title")), F.lit("none")))
    return rows.groupBy("category", "place").agg(F.count(F.lit(1)).alias("n"), F.min("pub_ts").alias("first_ts"), F.max("pub_ts").alias("last_ts"))


@_query(f"""{_DEALS_SQL}, s AS (SELECT *, CAST(floor(area / 10000) AS BIGINT) AS bucket FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY place, bucket, CAST(floor(millions) AS BIGINT) ORDER BY pub_ts, ord) AS k FROM s)
SELECT id, place || '|' || bucket || '|' || CAST(floor(millions) AS BIGINT) AS signature FROM r WHERE k = 1""")
def deal_signature_firstwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each deal: place, size in tens of thousands, millions."""
    title = F.col("title")
    rows = synthetic(spark, sf_dir).withColumn("signature", F.concat_ws("|", "place", F.floor(deals.size_sf(title) / 10_000).cast("string"), F.floor(deals.price_millions(title)).cast("string")))
    return dedup.first_wins(rows, F.col("signature"), [F.col("pub_ts"), F.col("ord")]).select("id", "signature")


_TITLE_KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\s+[-–—|]\s+[^-–—|]*$', '')), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@_query(f"""WITH k AS (SELECT doc_id, sha1(coalesce(text, '')) AS id, {_TITLE_KEY_SQL.format("coalesce(split_part(text, chr(10), 1), '')")} AS title_key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS n FROM k) SELECT doc_id, id, title_key FROM r WHERE n = 1""")
def title_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each key of its first line, and its SHA-1."""
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("id"), text.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"))
    return dedup.first_wins(rows, F.col("title_key"), [F.col("doc_id")], null_passes=False)


_TRACK = "|".join(text.TRACKING_PARAMS)
_URL_SQL = rf"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:{_TRACK})=[^&]*(?:&|$))+', '\1', 'g'), '[?&]$', '')"


@_query(rf"SELECT page_id, {_URL_SQL} AS clean_url, lower({_URL_SQL}) AS url_key, regexp_replace(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), ''), '^www\.', '') AS host FROM pages")
def strip_tracking_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without tracking, their keys and hosts."""
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", text.without_tracking(url).alias("clean_url"), text.url_key(url).alias("url_key"), text.host(url).alias("host"))


@_query(r"""SELECT regexp_replace(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), ''), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host, as supplementary scrapers are chosen."""
    return _read(spark, sf_dir, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain,
nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages""")
def strip_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and title of every page."""
    html = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", text.plain_text(html).alias("plain"), F.nullif(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("title"))


@_query(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=["'']og[:]image["''][^>]+content=["'']([^"'']+)["'']', 1), ''),
nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+(?:property|name)=["'']og[:]image["'']', 1), '')) AS og_image,
coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=["'']description["''][^>]+content=["'']([^"'']+)["'']', 1), ''),
nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+(?:property|name)=["'']description["'']', 1), '')) AS description,
nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), '') AS first_image FROM pages""")
def og_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and description that pages declare."""
    html = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", text.meta_content(html, "og:image").alias("og_image"), text.meta_content(html, "description").alias("description"), F.nullif(F.regexp_extract(html, r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit("")).alias("first_image"))


@_query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), '`', '&#96;'), '/', '&#x2F;') AS escaped, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/\\s]') THEN trim(url) ELSE '#' END AS safe FROM pages")
def html_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole page escaped, and safe addresses."""
    return _read(spark, sf_dir, "pages").select("page_id", text.escaped_html(F.col("html")).alias("escaped"), text.safe_url(F.col("url")).alias("safe"))


QUERIES["html_escaping_whole"], SQL["html_escaping_whole"] = html_escaping, SQL["html_escaping"]  # its earlier name
_WORDS_SQL = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 3))"
_FIRST_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '\s+[-–—]\s+[^-–—]*$', ''), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@_query(f"""WITH t AS (SELECT doc_id, {_WORDS_SQL.format(_FIRST_SQL)} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(w) AS k FROM t), c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.w AS wa, b.w AS wb FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id
  AND 5 * least(len(a.w), len(b.w)) >= 3 * greatest(len(a.w), len(b.w))),
s AS (SELECT a, b, len(list_intersect(wa, wb)) AS i, len(wa) + len(wb) AS n FROM c)
SELECT a, b, i / (n - i) AS similarity FROM s WHERE i / (n - i) >= 0.6""")
def near_title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose first lines share three fifths of their longer words."""
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", text.long_words(text.scorer_title(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("words"))
    return dedup.all_similar_pairs(rows, "doc_id", "words")


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sent_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those listed as sent (here: labelled toxic)."""
    sent = _read(spark, sf_dir, "labels").where("toxic = 1")
    return dedup.unless_listed(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", sent, "doc_id")


@_query(f"WITH {SYNTHETIC_SQL} SELECT id, place FROM articles a WHERE NOT EXISTS (SELECT 1 FROM part p WHERE length(p.p_brand) > 3 AND contains(a.title, p.p_brand)) AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_custkey = a.author_id)")
def exclude_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without those of excluded authors or naming an excluded term; the terms are all distinct brands."""
    rows = synthetic(spark, sf_dir)
    terms = _read(spark, sf_dir, "part").where("length(p_brand) > 3")
    authors = _read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("author_id"))
    return dedup.unless_containing(rows.join(authors, "author_id", "left_anti"), "title", terms, "p_brand").select("id", "place")


@_query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 3 AND contains(d.text, b.text))")
def exclude_contains_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those that hold the whole text of a benchmark item."""
    terms = _read(spark, sf_dir, "benchmark").where("length(text) > 3")
    return dedup.unless_containing(_read(spark, sf_dir, "documents"), "text", terms, "text").select("doc_id", "source")


@_query(f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(value) AS total FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOURS GROUP BY 1")
def recency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the 72 hours up to a fixed time; the bounds reach the scan."""
    rows = _read(spark, sf_dir, "events").where(selection.within(F.col("ts"), F.lit(AS_OF).cast("timestamp"), 72))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total"))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY event_type ORDER BY time_bucket(INTERVAL 1 DAY, ts) ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS n_7 FROM events GROUP BY 1, 2")
def rolling_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and over the last seven days that have any."""
    daily = _read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("n_7", F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)))


@_query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def requests_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each client in fixed windows of a minute."""
    return _read(spark, sf_dir, "events").groupBy(F.window("ts", "60 seconds"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("window.start", "user_id", "n")


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT user_id, count(*) AS outcomes, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok_count FROM r WHERE k <= 20 GROUP BY 1)
SELECT *, CAST(round(ok_count / outcomes * 100) AS BIGINT) AS success_pct FROM s""")
def feed_health_success_last20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of each feed's last 20 outcomes (feeds are users, an error event fails)."""
    return health.success_of_last(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error")


@_query("""WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM r)
SELECT event_id, user_id, failures, failures >= 3 AS blocked FROM f""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row of each feed, and whether it is blocked then."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return health.breaker_states(rows, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "user_id", "failures", "blocked")


@_query("""SELECT r_name AS region, count(*) AS feeds, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS zero_kept, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS direct, round(sum(c_acctbal), 2) AS kept
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by region with conditional counts."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("feeds"), F.sum((F.col("c_acctbal") < 0).cast("long")).alias("zero_kept"), F.sum((F.col("c_mktsegment") == "BUILDING").cast("long")).alias("direct"), F.round(F.sum("c_acctbal"), 2).alias("kept"))


@_query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ['Unspecified'] ELSE [n_name, 'R' || n_regionkey] END AS regions FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT c_custkey, unnest(regions) AS region FROM n) SELECT region, count(*) AS n, min(c_custkey) AS first_id FROM x GROUP BY 1""")
def region_explode_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by region where a row has several, or none."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("Unspecified"))).otherwise(F.array("n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
    return rows.select("c_custkey", F.explode(regions).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_id"))


@_query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unclassified' WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 0 THEN 'below_minimum' ELSE 'approved' END AS verdict, coalesce(l.toxic, 0) = 0 AS passes
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def verdict_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by an outer join; documents without one pass."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality", "toxic")
    rows = _read(spark, sf_dir, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("of"), "left")
    verdict = rules.first_match([("unclassified", F.col("of").isNull()), ("blocked", F.col("toxic") == 1), ("below_minimum", F.col("quality") == 0)], "approved")
    return rows.select("doc_id", verdict.alias("verdict"), (F.coalesce("toxic", F.lit(0)) == 0).alias("passes"))


@_query(f"""WITH {SYNTHETIC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pub_ts DESC, ord) AS k FROM articles)
SELECT id, source, CASE WHEN k <= CASE source WHEN '1-URGENT' THEN 5 ELSE 10 END THEN 'WOULD_PUBLISH' ELSE 'CAP_OVERFLOW' END AS state FROM r""")
def section_caps_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which articles fit their section's cap."""
    return selection.publish_states(synthetic(spark, sf_dir), "source", [F.desc("pub_ts"), F.col("ord")], {"1-URGENT": 5}, 10).select("id", "source", "state")


_TIER_SQL = "CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'tier1' WHEN 1 THEN 'tier2' WHEN 2 THEN 'tier3' WHEN 3 THEN 'tier4' ELSE 'tier5' END"


@_query(f"""WITH t AS (SELECT o_custkey AS edition, {_TIER_SQL} AS tier FROM orders), f AS (SELECT edition, count(*) AS items, CAST(sum(CASE tier WHEN 'tier1' THEN 100 WHEN 'tier2' THEN 85 WHEN 'tier3' THEN 50 WHEN 'tier4' THEN 30 ELSE 70 END) AS BIGINT) AS s FROM t GROUP BY 1)
SELECT edition, items, ((2000000 * s + 4 * items) // (8 * items)) / 1e6::DOUBLE AS freshness, CASE WHEN s >= 90 * items THEN 'A' WHEN s >= 80 * items THEN 'B' WHEN s >= 70 * items THEN 'C' WHEN s >= 60 * items THEN 'D' ELSE 'F' END AS grade FROM f""")
def freshness_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness and grade of each edition (an edition is a customer's orders)."""
    tier = F.concat(F.lit("tier"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    fresh = health.tier_freshness(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("edition"), tier.alias("tier")), "edition", "tier")
    return fresh.select("edition", "items", F.col("freshness_6").alias("freshness"), health.grade(4 * F.col("freshness")).alias("grade"))


@_query("SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END)::BIGINT AS {t}" for t in ("signup", "error", "click", "view", "purchase")) + ", count(*) AS total FROM events GROUP BY 1")
def penalty_pivot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type, a column each."""
    types = ("signup", "error", "click", "view", "purchase")
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(*(F.sum((F.col("event_type") == t).cast("long")).alias(t) for t in types), F.count(F.lit(1)).alias("total"))


@_query("SELECT event_id, event_type, props FROM events WHERE props IS NOT NULL AND regexp_matches(props, '(?s)\\{.*\\}')")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects salvaged from texts around them."""
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", text.embedded_json(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))).alias("props"))
    return rows.where("props is not null")


@_query("""WITH r AS (SELECT l_returnflag AS section, l_orderkey, l_linenumber, l_extendedprice AS score, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS place FROM lineitem WHERE l_quantity >= 20)
SELECT section, place, l_orderkey, l_linenumber, score FROM r WHERE place <= 50""")
def bounded_top50_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of each section."""
    rows = _read(spark, sf_dir, "lineitem").where("l_quantity >= 20").select(F.col("l_returnflag").alias("section"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    return selection.top_of_each(rows, "section", [F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")], 50)


@_query()
def greedy_multikey_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles kept when neither their deal nor their author came before within the place."""
    title = F.col("title")
    keys = F.array(F.concat(F.lit("s"), deals.size_sf(title).cast("string")), F.concat(F.lit("a"), F.col("author_id").cast("string")))
    return dedup.greedy_first_wins(synthetic(spark, sf_dir), "id", "ord", keys, F.col("place"))


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role, length(text) AS chars FROM r WHERE k <= 3")
def conversation_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation."""
    rows = selection.last_n(_read(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 3)
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@_query(f"WITH {SYNTHETIC_SQL} SELECT id, '<item><title>' || replace(replace(title, '&', '&amp;'), '/', '&#x2F;') || '</title><link>https:&#x2F;&#x2F;example.org&#x2F;' || ord || '</link><guid>' || id || '</guid></item>' AS value FROM articles")
def rss_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS items of every article."""
    from quillstream.sources.sinks import rss_items

    rows = synthetic(spark, sf_dir).withColumn("link", F.concat(F.lit("https://example.org/"), F.col("ord").cast("string")))
    return rows.select("id", F.struct("title", "link", "id").alias("x")).select("id", "x.title", "x.link").transform(lambda d: rss_items(d).select(F.regexp_extract("value", "<guid>(.*)</guid>", 1).alias("id"), "value"))
