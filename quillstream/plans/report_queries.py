"""Queries of reports, interface filters and reserves over the synthetic articles and events, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import deals, words
from quillstream.operators import ranking, reports, sections, signatures
from quillstream.operators.rounds import written
from quillstream.plans.gate_queries import _VERDICTS, _any, _first, _has, _q, _verdicts
from quillstream.sources.briefs import BRIEFS_SQL, REGIONS, briefs

SQL: dict[str, str] = {}
QUERIES = {}
AS_OF = "1998-06-01"
MACRO = r"\b(industrial market|warehouse demand|reit|supply chain|e-commerce|absorption|data center)\b"
EXCLUDED = r"\b(peru|kenya|egypt|westchester)\b"
PLACES = [("Brazil", r"\bbrazil\b"), ("Canada", r"\bcanada\b"), ("Chester", r"\bchester\b")]


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_KEPT = f"""WITH {_VERDICTS}, r AS (SELECT source, count(*) AS fetched, count(*) FILTER (relevant = 'ACCEPTED') AS kept, bool_and(transactions <> 'ACCEPTED_ACTION') AS ok FROM verdicts GROUP BY source)"""


@_query(f"{_KEPT} SELECT source, fetched, kept, CAST(round(100.0 * kept / fetched) AS BIGINT) AS kept_pct, fetched > 20 AND kept = 0 AS low_value, ok FROM r")
def feed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched and kept articles of every feed."""
    return reports.fetch_report(_verdicts(spark, sf_dir), "source", F.col("relevant") == "ACCEPTED", F.col("transactions") != "ACCEPTED_ACTION").select("source", "fetched", "kept", "kept_pct", "low_value", "ok")


@_query(f"{_KEPT} SELECT count(*) AS feeds, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(kept) AS BIGINT) AS kept FROM r")
def fetch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all feeds."""
    return reports.fetch_totals(reports.fetch_report(_verdicts(spark, sf_dir), "source", F.col("relevant") == "ACCEPTED", F.col("transactions") != "ACCEPTED_ACTION"))


_TEXT_SQL = "lower(title || ' ' || coalesce(description, ''))"
_REGION = _first([(n, _has("t", p)) for n, p in PLACES], "'National'")


@_query(f"WITH {BRIEFS_SQL}, x AS (SELECT {_TEXT_SQL} AS t FROM briefs), y AS (SELECT {_REGION} AS region FROM x) SELECT region, count(*) AS articles FROM y GROUP BY region")
def region_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by the first region that they name."""
    text = sections.text_of(F.col("title"), F.col("description"))
    rows = briefs(spark, sf_dir).select(reports.first_region(text, PLACES).alias("region"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("articles"))


_CORE = r"regexp_replace(lower(title), '\s+[-–—]\s+[^-–—]*$', '')"
_SCORED = f"""WITH {BRIEFS_SQL}, x AS (SELECT *, {_TEXT_SQL} AS t, {_CORE} AS core FROM briefs),
y AS (SELECT *, CASE WHEN coalesce(list_contains(tags, 'Brazil'), false) OR {_has("t", REGIONS.target_phrase)} THEN 1.0::DOUBLE WHEN {_has("t", MACRO)} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS points,
             length(trim(title)) < 20 OR NOT {_has("trim(title)", r"\s")} OR {_has("lower(title)", reports.PAGE_TITLE)} AS broken,
             {_has("t", EXCLUDED)} AND NOT coalesce(approved, false) AND NOT ({_has("core", EXCLUDED)} AND {_has("core", REGIONS.target_phrase)} AND ({_has("core", reports.COMPARES)} OR {_has("t", MACRO)}) AND category = 'relevant') AS strayed,
             {_has("t", words.JUNK)} AS junk, {_has("t", reports.INDUSTRIAL_SIGNAL)} AS signal, pub_ts AS day FROM x),
z AS (SELECT *, strayed OR junk AS leak, NOT (strayed OR junk) AND points < 1 AND NOT signal AS weak FROM y)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sections.text_of(F.col("title"), F.col("description"))
    rows = briefs(spark, sf_dir).withColumn("t", text)
    t = F.col("t")
    strayed = reports.region_leak(F.col("title"), t, F.col("category"), F.col("approved"), EXCLUDED, REGIONS.target_phrase, MACRO)
    rows = rows.withColumns({"points": reports.region_points(F.array_contains("tags", "Brazil"), t, REGIONS.target_phrase, MACRO), "broken": reports.broken_title(F.col("title")), "leak": strayed | t.rlike(words.JUNK)})
    return rows.withColumn("weak", ~F.col("leak") & (F.col("points") < 1) & ~t.rlike(reports.INDUSTRIAL_SIGNAL))


@_query(f"{_SCORED} SELECT ord, points, broken, leak, weak FROM z")
def item_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region points of every article, and whether it is broken, a leak or weak."""
    return _scored(spark, sf_dir).select("ord", "points", "broken", "leak", "weak")


@_query(f"""{_SCORED}, e AS (SELECT pub_ts AS day, count(*) AS items, count(*) FILTER (broken) AS broken, count(*) FILTER (leak) AS leak, count(*) FILTER (weak) AS weak, round(25 * avg(points), 6) AS regional,
    count(*) FILTER (ord % 11 = 0) AS dup_in_send, count(*) FILTER (ord % 17 = 0) AS repeat_cross_day FROM z GROUP BY pub_ts),
p AS (SELECT *, broken * 8 + dup_in_send * 6 + repeat_cross_day * 3 + weak * 3 + leak * 12 AS points, CAST(greatest(0, least(100, floor(30 + 25 + regional + 20 - (broken * 8 + dup_in_send * 6 + repeat_cross_day * 3 + weak * 3 + leak * 12) + 0.5))) AS INTEGER) AS score FROM e)
SELECT day, items, broken, dup_in_send, repeat_cross_day, weak, leak, points, regional, score,
CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM p""")
def edition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties, regional points, score and letter of each day's edition."""
    rows = _scored(spark, sf_dir).withColumn("day", F.col("pub_ts"))
    flags = {"broken": F.col("broken"), "dup_in_send": F.col("ord") % 11 == 0, "repeat_cross_day": F.col("ord") % 17 == 0, "weak": F.col("weak"), "leak": F.col("leak")}
    marks = reports.penalties(rows, "day", flags)
    sums = rows.groupBy("day").agg(F.count(F.lit(1)).alias("items"), F.round(25 * F.avg("points"), 6).alias("regional"))
    out = sums.join(marks, "day").withColumn("s", reports.content_score(F.lit(30.0), F.lit(25.0), F.col("regional"), F.col("points")))
    return out.select("day", "items", *flags, F.col("points").cast("long").alias("points"), "regional", "s.score", "s.grade")


@_query(f"""WITH {_VERDICTS}, u AS (UNPIVOT (SELECT ord, source, relevant, transactions, availabilities, people FROM verdicts) ON relevant, transactions, availabilities, people INTO NAME section VALUE reason),
s AS (SELECT ord % 97 AS edition, section, count(*) FILTER (ord % 3 = 0) AS in_window, count(*) FILTER (starts_with(reason, 'ACCEPTED') AND ord % 3 = 0) AS passed, count(*) FILTER (starts_with(reason, 'ACCEPTED') AND ord % 6 = 0) AS selected,
      count(*) FILTER (starts_with(reason, 'ACCEPTED')) // 4 AS candidates FROM u GROUP BY ALL),
w AS (SELECT *, CASE section WHEN 'transactions' THEN 10 WHEN 'relevant' THEN 8 ELSE 6 END AS weight,
      CASE WHEN selected > 0 THEN 'FILLED' WHEN in_window = 0 THEN 'NO_FRESH_SUPPLY' WHEN passed = 0 THEN 'QUALITY_REJECTED' ELSE 'SELECTION_GAP' END AS status FROM s),
g AS (SELECT edition, count(*) FILTER (candidates > 0) AS with_any, sum(candidates) AS candidates, coalesce(sum(weight) FILTER (status = 'FILLED'), 0) AS filled, coalesce(sum(weight) FILTER (status <> 'NO_FRESH_SUPPLY'), 0) AS could FROM w GROUP BY edition)
SELECT edition, CAST(candidates AS BIGINT) AS candidates, CASE WHEN with_any >= 3 AND candidates >= 25 THEN 'Rich' WHEN with_any <= 1 OR candidates < 8 THEN 'Thin' ELSE 'Normal' END AS supply,
CASE WHEN could > 0 THEN 30.0::DOUBLE * filled / could ELSE 30.0 END AS editorial_coverage, CAST(floor(100.0 * filled / 30 + 0.5) AS INTEGER) AS supply_score FROM g""")
def supply_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply, editorial coverage and supply score of editions."""
    names = ["relevant", "transactions", "availabilities", "people"]
    long = _verdicts(spark, sf_dir).select("ord", *names).unpivot("ord", names, "section", "reason")
    ok = F.col("reason").startswith(sections.ACCEPTED)
    counts = long.groupBy((F.col("ord") % 97).alias("edition"), "section").agg(
        F.count_if(F.col("ord") % 3 == 0).alias("in_window"), F.count_if(ok & (F.col("ord") % 3 == 0)).alias("passed"), F.count_if(ok & (F.col("ord") % 6 == 0)).alias("selected"), F.floor(F.count_if(ok) / 4).alias("candidates")
    )
    return reports.supply_status(counts, "edition", "section", "selected", "in_window", "passed", "candidates")


@_query(f"""WITH {BRIEFS_SQL}, c AS (SELECT *, nullif(regexp_extract(lower(title), {_q(r"(\d[\d,]*)\s*(?:sf|k)")}, 1), '') AS sig, length(title) AS score FROM briefs WHERE pub_ts <= TIMESTAMP '{AS_OF}' AND pub_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS),
f AS (SELECT * FROM c WHERE ord % 10 <> 0 AND (sig IS NULL OR sig <> '120,000')), n AS (SELECT *, row_number() OVER (PARTITION BY category, sig ORDER BY score DESC, ord) AS k FROM f WHERE sig IS NOT NULL),
p AS (SELECT ord, category, score FROM n WHERE k = 1 UNION ALL SELECT ord, category, score FROM f WHERE sig IS NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) AS INTEGER) AS place FROM p) SELECT category, place, ord FROM r WHERE place <= 25""")
def reserve_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reserve of each section: 25 of the last 90 days that were not sent."""
    rows = briefs(spark, sf_dir).withColumn("signature", F.nullif(F.regexp_extract(F.lower("title"), r"(\d[\d,]*)\s*(?:sf|k)", 1), F.lit(""))).withColumn("score", F.length("title"))
    sent = rows.where(F.col("ord") % 10 == 0).select(F.col("ord").alias("id"))
    sigs = spark.createDataFrame([("120,000",)], "signature string")
    as_of = F.lit(AS_OF).cast("timestamp")
    return reports.reserve(rows, "ord", "category", "signature", "pub_ts", [F.desc("score"), F.col("ord")], as_of, sent, sigs).select("category", "place", "ord")


@_query("""WITH w AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, epoch(ts)::BIGINT // 3600 ORDER BY ts, event_id) AS BIGINT) AS n FROM (SELECT event_id, user_id, ts FROM events))
SELECT event_id, CASE WHEN n > 2 THEN 429 ELSE 200 END AS status FROM w""".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(ts)) AS BIGINT)"))
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each event as a request: two an hour and user pass."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return reports.request_verdicts(rows, "user_id", "ts", [F.col("ts"), F.col("event_id")], 2, 3600).select("event_id", "status")


@_query(f"""WITH {BRIEFS_SQL}, f AS (SELECT * FROM briefs WHERE pub_ts >= TIMESTAMP '1997-01-01' AND pub_ts <= TIMESTAMP '{AS_OF}' AND (tags IS NULL OR len(tags) = 0 OR list_contains(tags, 'Peru')) AND source = '1-URGENT' ORDER BY ord LIMIT 200)
SELECT ord, pub_ts FROM f""")
def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 items that match, newest first."""
    rows = briefs(spark, sf_dir).withColumnRenamed("tags", "regions")
    return reports.items_filtered(rows, "ord", "pub_ts", F.lit("1997-01-01").cast("timestamp"), F.lit(AS_OF).cast("timestamp"), "Peru", "1-URGENT").select("ord", "pub_ts")


@_query(f"""WITH {BRIEFS_SQL} SELECT ord, title FROM briefs WHERE pub_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 700 DAYS AND (contains(lower(title), 'warehouse') OR coalesce(contains(lower(description), 'warehouse'), false))
AND contains(lower(title || ' ' || coalesce(description, '')), 'peru') AND category = 'relevant' AND source = '2-HIGH'""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page shows for a query, a region, a category and a source."""
    return reports.page_filtered(briefs(spark, sf_dir), "pub_ts", F.lit(AS_OF).cast("timestamp"), 700, "Warehouse", "Peru", "relevant", "2-HIGH").select("ord", "title")


_TOPICS = ["warehouse", "Data Center", "freight", "peru"]


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT ord, array_to_string(list_filter([{", ".join(map(_q, _TOPICS))}], lambda t: contains({_TEXT_SQL}, lower(t))), ',') AS topics FROM briefs) SELECT ord, topics FROM x WHERE topics <> ''""")
def tracked_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracked topics that articles hold."""
    rows = reports.topics_met(briefs(spark, sf_dir), "ord", sections.text_of(F.col("title"), F.col("description")), _TOPICS)
    return rows.select("ord", F.array_join("topics", ",").alias("topics"))


@_query(f"""WITH {BRIEFS_SQL}, d AS (SELECT *, pub_ts AS day, list_filter([nullif(regexp_extract(title, '[0-9,]+', 0), ''), nullif(regexp_extract(title, '[$][0-9]+', 0), '')], lambda x: x IS NOT NULL) AS sigs FROM briefs),
e AS (SELECT ord, day, unnest(sigs) AS sig FROM d), f AS (SELECT sig, min(day) AS first FROM e GROUP BY sig), g AS (SELECT ord, bool_or(first < day) AS repeats FROM e JOIN f USING (sig) GROUP BY ord)
SELECT ord, coalesce(repeats, false) AS repeats FROM d LEFT JOIN g USING (ord)""")
def cross_day_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a signature of an article stood in an edition of an earlier day."""
    part = lambda p: F.nullif(F.regexp_extract("title", p, 0), F.lit(""))
    rows = briefs(spark, sf_dir).withColumn("sigs", F.array_compact(F.array(part("[0-9,]+"), part("[$][0-9]+"))))
    return reports.sent_before(rows, "ord", "pub_ts", "sigs").select("ord", "repeats")


@_query(f"""WITH {_VERDICTS}, a AS (SELECT ord FROM verdicts WHERE starts_with(transactions, 'ACCEPTED')), b AS (SELECT ord FROM verdicts WHERE relevant = 'ACCEPTED')
SELECT ord, 'added' AS change FROM b WHERE ord NOT IN (SELECT ord FROM a) UNION ALL SELECT ord, 'dropped' FROM a WHERE ord NOT IN (SELECT ord FROM b)""")
def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the relevant section adds to and drops from the transactions."""
    rows = written(_verdicts(spark, sf_dir).select("ord", "transactions", "relevant"))  # verdicts are costly, and used four times
    return reports.stage_difference(rows.where(F.col("transactions").startswith("ACCEPTED")), rows.where("relevant = 'ACCEPTED'"), "ord")


@_query(f"""WITH {BRIEFS_SQL} SELECT ord, CASE WHEN date_diff('day', CAST(pub_ts AS DATE), DATE '{AS_OF}') > 180 THEN 'archive' WHEN date_diff('day', CAST(pub_ts AS DATE), DATE '{AS_OF}') > 90 THEN 'prune' ELSE 'keep' END AS retention,
CAST(nullif(replace(regexp_extract(lower(title), {_q(r"(\d+(?:,\d+)*)\s*(?:sq|sf|sq\.ft|square feet|sqft)")}, 1), ',', ''), '') AS BIGINT) AS stated_size, {_any("lower(coalesce(description, ''))", words.EMPTY_TALK)} AS says_nothing FROM briefs""")
def retention_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of every article, its size by the simple rule, and whether its description says nothing."""
    from quillstream.functions import gates, links

    rows = reports.retained(briefs(spark, sf_dir), "pub_ts", F.lit(AS_OF).cast("date"))
    return rows.select("ord", "retention", links.stated_size(F.col("title")).alias("stated_size"), gates.says_nothing(F.col("description")).alias("says_nothing"))


_NAMES = {"news.example.com": "The Example", "press.regional": "Regional Press"}
_WEIGHTS = ranking.Weights([(r"brazil|chester", 30), ("canada", 25)], {"newmark": 12, "cbre": 8}, {"news.example.com": 20, "other.test": 3}, ["helicopter", "sloth"])
_SF = r"regexp_extract(replace(regexp_extract(t, '([\d,.]+)\s*(?:million\s*)?(?:sf|sq\.?\s*f|square\s*f)', 1), ',', ''), '^\d*\.?\d*', 0)"
_AMOUNT = r"regexp_extract(replace(regexp_extract(t, '\$([\d,.]+)\s*(?:million|m(?:il|ln)?|billion|b(?:il|ln)?)\b', 1), ',', ''), '^\d*\.?\d*', 0)"


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT *, {_TEXT_SQL} AS t, lower(url) AS l FROM briefs), y AS (SELECT *, TRY_CAST({_SF} AS DOUBLE) AS sf, TRY_CAST({_AMOUNT} AS DOUBLE) AS amount, date_diff('hour', pub_ts, TIMESTAMP '{AS_OF}') AS hours FROM x)
SELECT ord, CAST(CASE WHEN contains(t, 'brazil') OR contains(t, 'chester') THEN 30 ELSE 0 END + CASE WHEN contains(t, 'canada') THEN 25 ELSE 0 END
+ CASE WHEN sf >= 500000 THEN 25 WHEN sf >= 100000 THEN 15 WHEN sf >= 50000 THEN 5 ELSE 0 END + CASE WHEN amount >= 100 THEN 25 WHEN amount >= 25 THEN 15 WHEN amount >= 10 THEN 5 ELSE 0 END
+ CASE WHEN contains(t, 'newmark') THEN 12 WHEN contains(t, 'cbre') THEN 8 ELSE 0 END + CASE WHEN contains(l, 'news.example.com') THEN 20 WHEN contains(l, 'other.test') THEN 3 ELSE 10 END
+ CASE WHEN length(description) > 50 THEN 5 ELSE 0 END + CASE WHEN hours < 12 THEN 10 WHEN hours < 24 THEN 5 ELSE 0 END - CASE WHEN contains(t, 'helicopter') OR contains(t, 'sloth') THEN 20 ELSE 0 END AS INTEGER) AS score FROM y""")
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every article."""
    score = ranking.article_score(F.col("title"), F.col("description"), F.col("url"), F.col("pub_ts"), F.lit(AS_OF).cast("timestamp"), _WEIGHTS)
    return briefs(spark, sf_dir).select("ord", score.cast("int").alias("score"))


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN title || ' - The Post' WHEN ord % 3 = 1 THEN title || ' | www.news.example.com' ELSE replace(title, ' - ', ' ') END AS h, lower(url) AS l FROM briefs),
y AS (SELECT *, trim(regexp_extract(h, '[^|]*$', 0)) AS last, CASE WHEN contains(l, 'news.example.com') THEN 'The Example' WHEN contains(l, 'press.regional') THEN 'Regional Press' ELSE 'NJ Halls' END AS told FROM x)
SELECT ord, CASE WHEN ord % 3 = 0 THEN 'The Post' WHEN ord % 3 = 1 THEN 'The Example' WHEN contains(h, ' | ') AND regexp_matches(last, '^[A-Z]') AND length(last) BETWEEN 2 AND 60 THEN last ELSE told END AS publisher FROM y""")
def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher of every article; a last part that begins with a digit is no name."""
    rows = briefs(spark, sf_dir).withColumn("h", F.when(F.col("ord") % 3 == 0, F.concat("title", F.lit(" - The Post"))).when(F.col("ord") % 3 == 1, F.concat("title", F.lit(" | www.news.example.com"))).otherwise(F.replace("title", F.lit(" - "), F.lit(" "))))
    return rows.select("ord", ranking.publisher(F.col("h"), F.lit("Google News nj halls"), F.col("url"), _NAMES).alias("publisher"))


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT *, CASE WHEN ord % 3 > 0 THEN regexp_extract(url, '[^?]*', 0) || ord % 500 ELSE '' END AS link, lower(title) AS head FROM briefs),
a AS (SELECT ord, row_number() OVER (PARTITION BY link ORDER BY ord) AS k FROM x WHERE link <> ''), b AS (SELECT ord, row_number() OVER (PARTITION BY head ORDER BY pub_ts DESC, ord) AS k FROM x WHERE link = '' AND head <> '')
SELECT ord FROM a WHERE k = 1 UNION ALL SELECT ord FROM b WHERE k = 1""")
def pipeline_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles left when links go first and titles stand in for missing ones."""
    rows = briefs(spark, sf_dir)
    link = F.when(F.col("ord") % 3 > 0, F.concat(F.regexp_extract("url", "[^?]*", 0), (F.col("ord") % 500).cast("string"))).otherwise("")
    return ranking.deduplicated(rows, link, F.lower("title"), "ord", "pub_ts").select("ord")


@_query(f"""WITH {BRIEFS_SQL} SELECT ord, CAST(list_sum(list_transform(string_split(title, ''), lambda c: unicode(c))) % 3 AS INTEGER) AS image FROM briefs""")
def placeholder_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholder image of every article."""
    return briefs(spark, sf_dir).select("ord", ranking.placeholder_index(F.col("title"), 3).alias("image"))


_GROUPS = [{"brazil": "south", "peru": "south", "chester": "chester"}, {"canada": "north", "westchester": "north"}]
_STATES = {"state-ke": r"\bkenya\b", "state-eg": r"\b(?:egypt|e\.g\.)"}
_FIRMS = ["prologis", "newmark", "cbre", "jll"]
_MARKETS = {"peru": "peru", "chester": "chester", "westchester": "w-chester", "canada": "canada", "brazil": "brazil"}
_DIGITS = lambda p: f"CAST(nullif(replace(regexp_extract(t, {_q(p)}, 1), ',', ''), '') AS DOUBLE)"
_EVENT = f"CASE WHEN {_has('t', deals.PEOPLE)} AND NOT {_has('t', deals.NOT_PEOPLE)} THEN 'people' " + " ".join(f"WHEN {_has('t', p)} THEN {_q(n)}" for n, p in deals.EVENTS) + " END"


def _place_sql(names: dict[str, str]) -> str:
    hit = f"regexp_extract(t, {_q(r'\b(' + '|'.join(names) + r')\b')}, 1)"
    return f"CASE {hit} " + " ".join(f"WHEN {_q(n)} THEN {_q(m)}" for n, m in names.items()) + " END"


_SIGNED = f"""WITH {BRIEFS_SQL}, x AS (SELECT ord, title, lower(title || ' ' || coalesce(description, '')) AS t FROM briefs),
y AS (SELECT *, coalesce(floor({_DIGITS(signatures.THOUSANDS_SF)} * 1000 + 0.5), {_DIGITS(signatures.WRITTEN_SF)}) AS sf0, floor({_DIGITS(signatures.MILLION_SF)} * 1000000 + 0.5) AS sf1,
  coalesce(floor({_DIGITS(signatures.BILLIONS)} * 1000 + 0.5), floor({_DIGITS(signatures.MILLIONS)} + 0.5)) AS m0, floor({_DIGITS(signatures.WRITTEN_DOLLARS)} / 1000000 + 0.5) AS m1,
  list_sort(list_distinct(list_filter([{", ".join(map(_place_sql, _GROUPS))}], lambda p: p IS NOT NULL))) AS named,
  list_sort(list_filter([{", ".join(f"CASE WHEN {_has('t', p)} THEN {_q(n)} END" for n, p in _STATES.items())}], lambda p: p IS NOT NULL)) AS states, {_EVENT} AS event FROM x),
z AS (SELECT *, coalesce(sf0, sf1) AS sf, coalesce(m0, m1) AS m, CASE WHEN len(named) > 0 THEN named ELSE states END AS places FROM y)"""
_FIRM_SQL = "CASE " + " ".join(f"WHEN {_has('t', rf'\b{f}\b')} THEN {_q(f)}" for f in _FIRMS) + " END"
_MARKET_SQL = "CASE " + " ".join(f"WHEN {_has('t', rf'\b{n}\b')} THEN {_q(_MARKETS[n])}" for n in sorted(_MARKETS, key=lambda n: -len(n))) + " END"


@_query(f"""{_SIGNED} SELECT ord, CASE WHEN len(places) > 0 AND (sf IS NOT NULL OR m IS NOT NULL) THEN CAST(CAST(coalesce(floor(sf / 10000 + 0.5), 0) AS BIGINT) AS VARCHAR) || 'sf_' || CAST(CAST(coalesce(m, 0) AS BIGINT) AS VARCHAR) || 'm_' || array_to_string(places, '|') END AS signature,
'entdeal_' || {_FIRM_SQL} || '_' || {_MARKET_SQL} || '_' || event AS entity_key FROM z""")
def deal_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deal signature and the entity key of every article."""
    rows = briefs(spark, sf_dir).select("ord", sections.text_of(F.col("title"), F.col("description")).alias("t"))
    return rows.select("ord", signatures.deal_signature(F.col("t"), _GROUPS, _STATES).alias("signature"), signatures.entity_key(F.col("t"), _FIRMS, _MARKETS).alias("entity_key"))


def entity_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles left when each deal of a firm in a market is told once."""
    return signatures.entity_survivors(briefs(spark, sf_dir), "ord", "ord", sections.text_of(F.col("title"), F.col("description")), _FIRMS, _MARKETS)


QUERIES["entity_key_dedup"] = entity_key_dedup  # a choice in order: the tests compare it with one pass


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT ord, lower(title) AS t, replace(regexp_replace(lower(title), '\\s+[-–—|]\\s+.*$', ''), '-', ' ') AS bare FROM briefs),
y AS (SELECT ord, nullif(trim(regexp_extract(bare, {_q(r"\bin ([a-z][a-z .']*?)(?:\s{2,}|,| for | to |$)")}, 1)), '') AS town,
  CASE {" ".join(f"WHEN contains(replace(t, '-', ' '), {_q(d)}) THEN {_q(d)}" for d in signatures.DESCRIPTORS)} END AS descriptor, {_EVENT} AS event FROM x),
c AS (SELECT *, count(*) OVER (PARTITION BY town, descriptor, event) - 1 AS others FROM y WHERE town IS NOT NULL AND descriptor IS NOT NULL AND event IS NOT NULL) SELECT ord, town, descriptor, event, others FROM c WHERE others > 0""")
def same_event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that share town, descriptor and event with others."""
    return signatures.same_event_flags(briefs(spark, sf_dir), "ord", "title")
