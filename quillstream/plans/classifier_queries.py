"""Queries of the classifiers over short synthetic articles and over whole documents, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import gates, words
from quillstream.operators import classifiers, final_gates
from quillstream.operators.classifiers import Engine
from quillstream.operators.final_gates import Markets
from quillstream.operators.rounds import DOCUMENTS_A_TASK, spread
from quillstream.plans.gate_queries import _CENTRE, _INDUSTRIAL, _BILLIONS, _MEGAWATTS, _PLACED, _placed, _PASSES, _any, _detention, _first, _has, _listing, _q, _wrong, gates_of
from quillstream.sources.briefs import BRIEFS_SQL, briefs

SQL: dict[str, str] = {}
QUERIES = {}
#: Hosts of the synthetic articles as publishers that the rules know.
HOSTS = [("news.example.com", "www.globest.com"), ("Daily.example.org:8080", "re-nj.com"), ("press.regional.example", "lvb.com"), ("other.test", "www.loopnet.com")]
FOREIGN = ["JAPAN", "EGYPT"]
BRIEF_ENGINE = Engine(sources=["globest.com", "re-nj.com", "lvb.com", "2-high"], overrides=["loopnet.com"], places=["brazil", "chester"], other_places=["peru", "kenya", "jordan"])
DOCUMENT_ENGINE = Engine(sources=["src"], overrides=["src19"])


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.col("url")
    for old, new in HOSTS:
        link = F.replace(link, F.lit(old), F.lit(new))
    return briefs(spark, sf_dir).select(F.col("ord").alias("id"), "title", "description", link.alias("link"), "source")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, all other lines the description."""
    title = F.substring_index("text", "\n", 1)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), DOCUMENTS_A_TASK)
    return docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("description"), F.lit(None).cast("string").alias("link"), "source")


_LINK = "url"
for _old, _new in HOSTS:
    _LINK = f"replace({_LINK}, {_q(_old)}, {_q(_new)})"
_COMMON = """SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS t, upper(coalesce(title, '') || ' ' || coalesce(description, '')) AS u, lower(coalesce(title, '')) AS h, lower(coalesce(link, '')) AS l,
lower(coalesce(source, '')) AS s, lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(link, '')) AS e, lower(coalesce(source, '') || ' ' || coalesce(link, '')) AS o FROM raw"""
_BRIEFS = f"{BRIEFS_SQL}, raw AS (SELECT ord AS id, title, description, {_LINK} AS link, source FROM briefs), a AS ({_COMMON})"
_DOCUMENTS = f"raw AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, NULL::VARCHAR AS link, source FROM documents), a AS ({_COMMON})"


def _count(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {_q(t)}) AS INTEGER)" for t in terms) + ")"


def _by_reason(values: dict) -> str:
    return "CASE reason " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in values.items() if v is not None) + " END"


def _engine_sql(e: Engine) -> str:
    ind, intent, size, price = _any("e", e.industrial), _any("e", e.intent), "(" + " OR ".join(_has("e", p) for p in words.ENGINE_SIZES) + ")", "(" + " OR ".join(_has("e", p) for p in words.ENGINE_PRICES) + ")"
    available, people, deal = _any("e", words.ENGINE_AVAILABLE), _any("e", words.ENGINE_PEOPLE), _any("e", words.ENGINE_DEALS)
    reason = _first(
        [
            ("SOURCE_OVERRIDE", _any("o", e.overrides)), ("UNAPPROVED_SOURCE", f"NOT {_any('o', e.sources)}"), ("EXCLUDED_KEYWORD", _any("e", e.excluded)), ("OUT_OF_MARKET", f"{_any('e', e.other_places)} AND NOT {_any('e', e.places)}"),
            ("PEOPLE_OF_FIRM", f"({_any('e', words.ENGINE_BROKERS)} OR ({_any('e', words.ENGINE_INVESTORS)} AND NOT available)) AND people"), ("DEAL_WITH_SIZE", "free AND size AND deal"),
            ("SIZE_IN_CONTEXT", "free AND size AND (ind OR intent)"), ("DEAL_WITH_PRICE", "free AND deal AND ind AND price"), ("AVAILABLE_INDUSTRIAL", "available AND ind"), ("MARKET_NEWS", "ind AND intent"),
            ("PEOPLE_IN_CONTEXT", "people AND (ind OR intent)"),
        ], "'NOT_RELEVANT'",
    )
    results = classifiers.ENGINE_RESULTS
    score = f"CASE WHEN reason = 'MARKET_NEWS' THEN (least({_count('e', e.industrial)} * 1.2::DOUBLE, 10) + least({_count('e', e.intent)} * 1.1::DOUBLE, 10)) / 2 ELSE {_by_reason({k: f'{v[1]}::DOUBLE' for k, v in results.items() if v[1] is not None})} END"
    return f"""f AS (SELECT *, {ind} AS ind, {intent} AS intent, {size} AS size, {price} AS price, {available} AS available, {people} AS people, {deal} AS deal, NOT {_any("e", words.ENGINE_OTHER_TRADE)} AND NOT {available} AS free FROM a),
g AS (SELECT *, {reason} AS reason FROM f)
SELECT id, reason, {_by_reason({k: _q(v[0]) for k, v in results.items()})} AS category, {score} AS score, {_by_reason({k: _q(v[2]) for k, v in results.items() if v[2]})} AS tier, {score} > 2 AS is_relevant FROM g"""


_BUILD_CONTEXT = _any("u", [k.upper() for k in words.BUILD_INDUSTRIAL])
_BUILD = _first(
    [
        ("POLITICAL_OR_FOREIGN", _any("u", [*(w.upper() for w in words.POLITICAL), *FOREIGN])), ("VIDEO", _has("l", words.BUILD_VIDEO)),
        ("CATALOGUE_WITHOUT_TARGET", f"({_has('h', words.BUILD_CATALOGUE)} OR {_has('l', words.BUILD_LOW_SIGNAL)}) AND NOT {_has('u', words.BUILD_TARGET)}"), ("NOT_INDUSTRIAL", "NOT industrial"),
        ("PEOPLE_WITHOUT_CONTEXT", f"{_has('u', words.BUILD_PEOPLE)} AND NOT context"), ("REGIONAL_IN_CONTEXT", f"near AND (context OR {_has('u', words.BUILD_REGIONAL_CONTEXT)})"), ("REGIONAL_WITHOUT_CONTEXT", "near"),
        ("PREFERRED_IN_CONTEXT", f"preferred AND (context OR {_has('u', words.BUILD_PREFERRED_CONTEXT)})"), ("PREFERRED_WITHOUT_CONTEXT", "preferred"), ("REGIONAL_SOURCE", _any("l", words.BUILD_REGIONAL)),
        ("INDUSTRIAL_CONTEXT", "context"), ("STRONG_SIGNAL", _has("u", words.BUILD_STRONG)),
    ], "'NO_CONTEXT'",
)
_BUILD_SQL = f"""b AS (SELECT *, {_BUILD_CONTEXT} AS context, {_INDUSTRIAL} IN {_PASSES} AS industrial,
  {_any("l", words.BUILD_REGIONAL_CLOSE)} OR {_any("s", [x.replace(".com", "") for x in words.BUILD_REGIONAL_CLOSE])} AS near, {_any("l", words.BUILD_PREFERRED)} OR {_any("s", words.BUILD_PREFERRED)} AS preferred FROM a),
c AS (SELECT id, {_BUILD} AS build_reason FROM b)
SELECT id, build_reason, build_reason IN ({", ".join(map(_q, classifiers.BUILD_INCLUDED))}) AS included FROM c"""

_NEW = _first(
    [
        ("SCRAPE_ARTIFACT_INDEX_PAGE", _has("h", words.INDEX_PAGE)), ("LOW_VALUE_ROUNDUP", _has("h", words.ROUNDUP)),
        ("SCRAPE_ARTIFACT_CATEGORY_STUB", "CASE WHEN len(parts) > 1 THEN trim(array_to_string(parts[:-2], ' - ')) ELSE trim(h) END IN ('industrial')"),
        ("REJECT_WRONG_PROPERTY_TYPE", f"{_wrong('t')} AND NOT {_has('t', words.STRONG_ASSET)}"),
        ("AVAIL_LOOPNET_LISTING", f"(contains(s, 'loopnet') OR {_has('h', words.LISTING_SITE)} OR contains(l, 'loopnet.com')) AND asset"),
        ("AVAIL_TITLE_LEASE_SALE", f"{_has('h', words.TITLE_MARKETED)} AND asset AND NOT {_has('h', words.COMPLETED)}"), ("AVAIL_BODY_LEASE_SALE", "marketed AND asset AND NOT completed"),
        ("AVAIL_NEW_SUPPLY", f"{_has('t', words.NEW_SUPPLY)} AND asset AND context"), ("PEOPLE_TITLE_SIGNAL", f"{_has('h', words.TITLE_MOVED)} AND firm"), ("PEOPLE_PROFILE_FORMAT", f"{_has('t', words.PROFILE)} AND firm"),
        ("AVAIL_LISTING_EVENT", f"{_listing('t')} AND asset AND NOT other"), ("TXN_DEAL_SIGNAL", "NOT other AND ((context AND (deal OR (dollars AND (feet OR asset)))) OR (deal AND feet))"),
        ("AVAIL_SOFT_MARKETING", "offered AND asset AND NOT completed"), ("PEOPLE_BODY_SIGNAL", "moved AND firm"), ("TXN_SF_IN_TITLE", "feet AND asset AND NOT marketed"),
        ("RELEVANT_CRE_SIGNAL", "context OR deal OR offered OR moved OR firm OR dollars OR feet OR industrial"),
    ], "'EXCLUDE_NO_CRE_SIGNAL'",
)
_NEW_SQL = f"""b AS (SELECT *, string_split_regex(h, '\\s+[-–—]\\s+') AS parts, {_has("t", words.SOME_PROPERTY)} AS asset, {_has("t", words.TRADED)} AS deal, {_has("t", words.CRE_CONTEXT)} AS context,
  {_has("t", words.DOLLARS[0])} OR {_has("t", words.DOLLARS[1])} AS dollars, {_has("t", words.SQUARE_FEET)} AS feet, {_has("t", words.ON_OFFER)} AS offered, {_has("t", words.MARKETED)} AS marketed, {_has("t", words.COMPLETED)} AS completed,
  {_has("t", words.MOVED)} AS moved, {_has("t", words.FIRM_NAMED)} AS firm, {_any("t", words.NOT_INDUSTRIAL)} AND NOT {_has("t", words.STILL_INDUSTRIAL)} AS other, {_INDUSTRIAL} IN {_PASSES} AS industrial FROM a),
c AS (SELECT id, {_NEW} AS reason FROM b)
SELECT id, reason AS category_reason, {_by_reason({k: _q(v) for k, v in classifiers.CATEGORY_OF.items()})} AS new_category FROM c"""


@_query(f"WITH {_BRIEFS}, {_engine_sql(BRIEF_ENGINE)}")
def rule_engine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason, category, score and tier that the rule engine gives every article."""
    return classifiers.engine_classified(_briefs(spark, sf_dir), BRIEF_ENGINE).select("id", "reason", "category", "score", "tier", "is_relevant")


@_query(f"WITH {_DOCUMENTS}, {_engine_sql(DOCUMENT_ENGINE)}")
def rule_engine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine over whole documents."""
    return classifiers.engine_classified(_documents(spark, sf_dir), DOCUMENT_ENGINE).select("id", "reason", "category", "score", "tier", "is_relevant")


@_query(f"WITH {_BRIEFS}, {_BUILD_SQL}")
def build_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a build takes an article or leaves it out."""
    return classifiers.build_gated(_briefs(spark, sf_dir), FOREIGN).select("id", "build_reason", "included")


@_query(f"WITH {_DOCUMENTS}, {_BUILD_SQL}")
def build_gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a build over whole documents."""
    return classifiers.build_gated(_documents(spark, sf_dir), FOREIGN).select("id", "build_reason", "included")


@_query(f"WITH {_BRIEFS}, {_NEW_SQL}")
def recategorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of every article given anew, with the rule that gave it."""
    return classifiers.recategorized(_briefs(spark, sf_dir)).select("id", "category_reason", "new_category")


@_query(f"WITH {_DOCUMENTS}, {_NEW_SQL}")
def recategorize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of whole documents."""
    return classifiers.recategorized(_documents(spark, sf_dir)).select("id", "category_reason", "new_category")


@_query(f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), y AS (SELECT *, {_INDUSTRIAL} AS reason FROM x)
SELECT doc_id, reason, reason IN {_PASSES} AS passes, {_wrong("t")} AS wrong_property, {_has("t", words.STRONG_ASSET)} AS strong_asset, {_detention("t")} AS detention, {_listing("t")} AS listing FROM y""")
def industrial_gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The industrial gate over whole documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DOCUMENTS_A_TASK)
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return gates_of(rows, "t").drop("t")


#: Markets of the synthetic articles.
MARKETS = Markets(target=r"\b(brazil|canada|chester)\b", macro=r"\b(interest rates?|absorption|supply chain|e-commerce|industrial portfolio|freight)\b", scrub_target=r"\b(brazil|chester)\b", trusted=["example.org", "1-urgent"], others=["peru", "kenya", "Egypt"])


def _final_sql(m: Markets) -> str:
    charity = f"({_has('h', words.SCRUB_CHARITY)} OR ({_has('h', words.SCRUB_NONPROFIT)} AND {_has('t', words.SCRUB_GIVING)}))"
    final = _first(
        [
            ("DC_OUT_OF_REGION", "verdict = 'reject-oor'"), ("DC_OUTSIDE_RELEVANT", "verdict IN ('allow-national-scale', 'allow-unknown-location') AND section <> 'relevant'"), ("NOT_INDUSTRIAL", "NOT industrial"),
            ("OTHER_MARKET", f"NOT target AND {_any('raw', m.others)}"), ("NO_REGION_SOURCE_OR_MACRO", f"NOT target AND NOT trusted AND NOT {_has('t', m.macro)}"), ("CATALOGUE_OUTSIDE_TARGET", "contains(h, 'loopnet') AND NOT target"),
        ], "'PASSES'",
    )
    scrub = _first(
        [
            ("BROKEN_TITLE", f"length(h) < 20 OR {_has('h', words.PAGE_INDEX)}"), ("EMPTY_TALK", _any("d", words.SCRUB_EMPTY_TALK)), ("JUNK", _has("t", words.SCRUB_JUNK)), ("CLIP", _has("h", words.SCRUB_CLIP)),
            ("STUDENTS", _has("h", words.SCRUB_STUDENTS)), ("CHARITY", charity), ("NOT_INDUSTRIAL", "NOT industrial"), ("OTHER_MARKET", f"{_any('t', m.others)} AND NOT {_has('t', m.scrub_target)}"),
        ], "'PASSES'",
    )
    clear, shared = [w for w in words.STRONG_PEOPLE_ACTIONS if w not in words.OF_COMPANIES_TOO], [w for w in words.STRONG_PEOPLE_ACTIONS if w in words.OF_COMPANIES_TOO]
    return f"""f AS (SELECT *, {_has("t", m.target)} AS target, {_any("l", m.trusted)} OR lower(coalesce(source, '')) IN ({", ".join(map(_q, m.trusted))}) AS trusted, {_INDUSTRIAL} IN {_PASSES} AS industrial,
  {_has("h", words.PEOPLE_TITLE)} AS signal, {_any("t", words.PERSON_ROLES)} AS role, {_any("t", words.INDUSTRY_NAMES)} OR {_has("t", words.AGENCY_TOKEN)} AS industry FROM e),
g AS (SELECT *, {_any("t", clear)} OR ({_any("t", shared)} AND ({_has("h", words.PERSON_TITLE)} OR role)) OR signal AS action FROM f),
h AS (SELECT *, NOT {_any("t", words.NOT_FOR_PEOPLE)} AND ((action AND (role OR industry)) OR ({_any("t", words.PEOPLE_PUFF)} AND role)) AS found FROM g)
SELECT id, {final} AS final_reason, {scrub} AS scrub_reason,
  CASE section WHEN 'relevant' THEN found AND (signal OR NOT {_any("t", words.DEAL_ACTIONS)}) WHEN 'transactions' THEN found AND signal ELSE false END AS to_people FROM h"""


@_query(f"""WITH {_PLACED}, c AS (SELECT *, {_BILLIONS} AS billions, {_MEGAWATTS} AS megawatts FROM placed),
e AS (SELECT ord AS id, source, category AS section, {_CENTRE} AS verdict, t, lower(trim(title)) AS h, lower(coalesce(description, '')) AS d, l, title || ' ' || coalesce(description, '') AS raw FROM c), {_final_sql(MARKETS)}""")
def last_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the final gate and the scrub before a send drop an article, and which articles are news of people."""
    rows = _placed(spark, sf_dir)
    verdict = gates.data_centre_verdict(F.col("text"), F.col("in_region"), F.col("elsewhere") > 0)
    rows = rows.select(F.col("ord").alias("id"), "title", "description", F.col("url").alias("link"), "source", F.col("category").alias("section"), verdict.alias("centre"))
    return final_gates.gated(rows, "centre", "section", MARKETS).select("id", "final_reason", "scrub_reason", "to_people")


@_query(f"""WITH {_DOCUMENTS}, e AS (SELECT id, source, 'relevant' AS section, 'not-dc' AS verdict, t, trim(h) AS h, lower(coalesce(description, '')) AS d, l, coalesce(title, '') || ' ' || coalesce(description, '') AS raw FROM a), {_final_sql(Markets())}""")
def last_gates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last gates over whole documents, with the markets as they are."""
    rows = _documents(spark, sf_dir).withColumns({"section": F.lit("relevant"), "centre": F.lit("not-dc")})
    return final_gates.gated(rows, "centre", "section").select("id", "final_reason", "scrub_reason", "to_people")
