"""Queries of the gates, regions, section filters and links over short synthetic articles, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import deals, gates, links, words
from quillstream.functions.signals import decided
from quillstream.operators import regions, sections
from quillstream.sources.briefs import BRIEFS_SQL, REGIONS, briefs

SQL: dict[str, str] = {}
QUERIES = {}
DOMAINS = ["example.com", "regional.example"]


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- SQL in pieces -------------------------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(t)})" for t in terms) + ")"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _hits(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(length({column}) - length(replace({column}, {_q(t)}, ''))) // {len(t)}" for t in terms) + ")"


def _first(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {holds} THEN {_q(name)}" for name, holds in rules) + f" ELSE {otherwise} END"


def _detention(t: str) -> str:
    return f"({_has(t, words.DETENTION_USE)} OR ({_has(t, words.DETENTION)} AND NOT {_has(t, words.DETENTION_OF_WATER[0])} AND NOT {_has(t, words.DETENTION_OF_WATER[1])}))"


def _wrong(t: str) -> str:
    return "(" + " OR ".join(_has(t, p) for p in words.WRONG_DEALS) + ")"


def _listing(t: str) -> str:
    return f"({_has(t, words.LISTING)} AND NOT {_has(t, words.DEAL_DONE)})"


_CORE = _any("t", words.CORE)
_INDUSTRIAL = _first(
    [
        ("JUNK", _has("t", words.JUNK)), ("PAGE_INDEX", _has("t", words.PAGE_INDEX)), ("DETENTION", _detention("t")),
        ("OFFICE_LED", f"{_has('t', words.OFFICE_LED)} AND NOT {_has('t', words.ASSET_NAMED)}"), ("OTHER_PROPERTY", f"{_any('t', words.NOT_INDUSTRIAL)} AND NOT {_any('t', words.KEPT_ANYWAY)}"),
        ("INDUSTRIAL_ALONE", f"contains(t, 'industrial') AND NOT {_any('t', [w for w in words.CORE if w != 'industrial'])} AND NOT {_has('t', words.PROPERTY_SIGNAL)}"), ("CORE_ASSET", _CORE),
        ("SUPPLY_CHAIN_ASSET", f"{_any('t', words.SUPPLY_CHAIN)} AND {_has('t', words.PHYSICAL_ASSET)}"), ("SUPPLY_CHAIN_ALONE", _any("t", words.SUPPLY_CHAIN)), ("MACRO", _any("t", words.MACRO)),
        ("VEHICLE_AD", f"{_any('t', words.DEAL_SIGNALS)} AND {_has('t', words.VEHICLE_AD)}"), ("DEAL_WITH_PROPERTY", f"{_any('t', words.DEAL_SIGNALS)} AND {_has('t', words.PROPERTY_CONTEXT)}"),
        ("DEAL_ALONE", _any("t", words.DEAL_SIGNALS)), ("LEASE_WITH_CONTEXT", f"{_any('t', words.LEASE_WORDS)} AND ({_has('t', words.LEASE_CONTEXT)} OR {_has('t', words.LAND_SIGNAL)})"),
        ("FIRM_AND_ROLE", f"{_any('t', words.FIRMS)} AND {_any('t', words.ROLES)}"),
    ], "'NO_SIGNAL'",
)
_PASSES = "(" + ", ".join(map(_q, gates.INDUSTRIAL_REASONS)) + ")"
_NUMBER = r"(\d[\d,]*(?:\.\d+)?)"


def _largest(unit: str, before: str, scale: str) -> str:
    return f"list_max(list_transform(regexp_extract_all(t, {_q(before + _NUMBER + unit)}, 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE) * {scale}))"


_BILLIONS = f"greatest({_largest(r'\s*(?:b|bn|billion)\b', r'\$\s*', '1.0')}, {_largest(r'\s*(?:m|mm|million)\b', r'\$\s*', '0.001')})"
_MEGAWATTS = f"greatest({_largest(r'\s*-?\s*(?:gw|gigawatts?)\b', '', '1000.0')}, {_largest(r'\s*-?\s*(?:mw|megawatts?)\b', '', '1.0')})"
_CENTRE = _first(
    [
        ("not-dc", f"NOT {_has('t', words.DATA_CENTRE)}"),
        ("allow-macro", f"{_has('t', words.CENTRE_POLICY)} OR NOT {_has('t', words.CENTRE_PROJECT)} OR ({_has('t', words.CENTRE_MARKET)} AND billions IS NULL AND megawatts IS NULL)"),
        ("allow-regional", "in_region"), ("allow-national-scale", "coalesce(billions, 0) >= 5 OR coalesce(megawatts, 0) >= 500"), ("reject-oor", "elsewhere > 0"),
    ], "'allow-unknown-location'",
)


def _at(pattern: str) -> str:
    return f"CASE WHEN {_has('h', pattern)} THEN strpos(h, regexp_extract(h, {_q(pattern)}, 0)) END"


_UPPER = [t.lower() for t in REGIONS.targets]
_FAILURE = _first(
    [
        ("GOV_AGENCY_NO_TARGET_PROPERTY", f"{_has('t', words.AGENCY)} AND NOT {_has('t', REGIONS.target_phrase)}"),
        ("SOURCE_LISTING_AGGREGATOR_NO_TARGET", f"({_has('h', words.CATALOGUE)} OR {_has('h', words.CATALOGUE_START)}) AND NOT {_has('t', REGIONS.target_phrase)}"),
        ("PRIMARY_LOCATION_NON_TARGET", "other_at IS NOT NULL AND (target_at IS NULL OR other_at < target_at)"),
        ("BUYER_ONLY_IN_TARGET", f"verb <> '' AND {_any('buyer', _UPPER)} AND NOT {_any('asset', _UPPER)}"),
    ], "NULL",
)
#: h: title, t: text, u: text in upper case; then counts, failure and the region.
_PLACED = f"""{BRIEFS_SQL},
b1 AS (SELECT *, lower(trim(title)) AS h, lower(title || ' ' || coalesce(description, '')) AS t, upper(title || ' ' || coalesce(description, '')) AS u, lower(url) AS l FROM briefs),
b2 AS (SELECT *, greatest(0, {_hits("u", REGIONS.targets)} - {_hits("u", REGIONS.collisions)}) AS hits, {_hits("u", REGIONS.excluded)} AS elsewhere, {_hits("u", REGIONS.also_excluded)} AS also,
          {_at(REGIONS.other_phrase)} AS other_at, {_at(REGIONS.target_phrase)} AS target_at, regexp_extract(h, {_q(words.BUYS)}, 0) AS verb,
          regexp_extract(l, '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS host FROM b1),
b3 AS (SELECT *, left(h, strpos(h, verb) - 1) AS buyer, substr(h, strpos(h, verb) + length(verb)) AS asset FROM b2),
b4 AS (SELECT *, {_FAILURE} AS failure, {_any("t", [x.lower() for x in REGIONS.foreign])} AS abroad, {_any("t", _UPPER)} AS named FROM b3),
placed AS (SELECT *, CASE WHEN failure IS NOT NULL OR abroad THEN false WHEN host <> '' AND NOT {_any("host", REGIONS.approved_hosts)} THEN false
                          WHEN {_any("l", REGIONS.regional_sources)} THEN NOT (elsewhere > hits AND elsewhere >= 1)
                          WHEN coalesce({_any("lower(tags[1])", _UPPER)}, false) THEN true ELSE (named AND hits >= elsewhere) OR (named AND elsewhere = 0) END AS in_region FROM b4)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with what is known of their places, and whether they are set in the target."""
    rows = regions.with_places(briefs(spark, sf_dir), REGIONS)
    title, description = F.col("title"), F.col("description")
    in_region = regions.is_target_region(title, description, F.col("url"), F.col("tags"), REGIONS, regions.place_of(rows))
    return rows.withColumns({"text": sections.text_of(title, description), "in_region": in_region})


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT ord, lower(title || ' ' || coalesce(description, '')) AS t FROM briefs), y AS (SELECT *, {_INDUSTRIAL} AS reason FROM x)
SELECT ord, reason, reason IN {_PASSES} AS passes, {_wrong("t")} AS wrong_property, {_has("t", words.STRONG_ASSET)} AS strong_asset, {_detention("t")} AS detention, {_listing("t")} AS listing FROM y""")
def industrial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an article is about industrial property or isn't, and the flags beside it."""
    text = sections.text_of(F.col("title"), F.col("description"))
    return gates_of(briefs(spark, sf_dir).select("ord", text.alias("t")), "t").drop("t")


def gates_of(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the reason of the industrial gate and the flags beside it."""
    return decided(rows, {"text": F.col(text)}, lambda text: {
        "reason": text.once("reason", gates.industrial_reason), "passes": text.once("reason", gates.industrial_reason).isin(gates.INDUSTRIAL_REASONS), "wrong_property": gates.wrong_property(text),
        "strong_asset": gates.strong_asset(text), "detention": gates.is_detention(text), "listing": gates.is_listing(text),
    })


@_query(f"""WITH {_PLACED} SELECT ord, CAST(hits AS INTEGER) AS target_hits, CAST(elsewhere AS INTEGER) AS other_hits, failure, in_region,
NOT (abroad OR (elsewhere + also > 0 AND hits = 0) OR elsewhere + also > hits) AS not_excluded,
CASE WHEN coalesce(description, '') = '' THEN true WHEN {_any("lower(title || ' ' || source)", REGIONS.own_names)} THEN true WHEN {_any("lower(description)", [x.lower() for x in REGIONS.foreign])} THEN false
     WHEN category = 'relevant' THEN NOT (elsewhere > 0 AND hits = 0) ELSE NOT (elsewhere > 0 AND elsewhere > hits) END AS passes_described FROM placed""")
def region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of region words, why an article fails by geography, and the gates for target and other regions."""
    rows = _placed(spark, sf_dir)
    place = regions.place_of(rows)
    described = regions.passes_with_description(F.col("title"), F.col("description"), F.col("source"), F.col("category"), REGIONS, place)
    return rows.select("ord", F.col("hits").alias("target_hits"), F.col("elsewhere").alias("other_hits"), "failure", "in_region", regions.not_excluded(F.col("text"), REGIONS, place).alias("not_excluded"), described.alias("passes_described"))


@_query(f"""WITH {_PLACED}, x AS (SELECT *, {_BILLIONS} AS billions, {_MEGAWATTS} AS megawatts FROM placed)
SELECT ord, billions, megawatts, {_CENTRE} AS verdict FROM x""")
def data_centre_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six verdicts on data centres, with the largest amount and power that a text names."""
    rows = _placed(spark, sf_dir)
    verdict = gates.data_centre_verdict(F.col("text"), F.col("in_region"), F.col("elsewhere") > 0)
    return rows.select("ord", deals.largest_billions(F.col("text")).alias("billions"), deals.largest_megawatts(F.col("text")).alias("megawatts"), verdict.alias("verdict"))


_AREA = f"CAST(nullif(replace(regexp_extract(u, {_q(deals.AREA)}, 1), ',', ''), '') AS DOUBLE) * CASE regexp_extract(u, {_q(deals.AREA)}, 2) WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END"
_SAID = f"CAST(nullif(replace(regexp_extract(u, {_q(deals.MILLIONS)}, 1), ',', ''), '') AS DOUBLE)"
_WRITTEN = f"CAST(nullif(replace(regexp_extract(u, {_q(deals.SPELT_OUT)}, 1), ',', ''), '') AS DOUBLE)"
_CLEAR = [w for w in words.PEOPLE_ACTIONS if w not in words.OF_COMPANIES_TOO]
_SHARED = [w for w in words.PEOPLE_ACTIONS if w in words.OF_COMPANIES_TOO]
_NO, _ADVISED = "approved = false", "approved = false AND elsewhere > 0"
_RELEVANT = _first([("RUBRIC_REJECT", _NO), ("POLITICAL_CONTENT", "political"), ("NOT_INDUSTRIAL", "NOT industrial"), ("NO_RELEVANT_KEYWORDS", f"NOT {_any('t', words.RELEVANT)}")], "'ACCEPTED'")
_TRANSACTIONS = _first(
    [
        ("RUBRIC_REJECT", _NO), ("POLITICAL_CONTENT", "political"), ("WRONG_PROPERTY_TYPE", "wrong"), ("NOT_INDUSTRIAL", "NOT industrial"), ("LISTING_EVENT_NOT_DEAL", "listing"),
        ("ACCEPTED_APPROVAL", _any("t", deals.APPROVAL_WORDS)), ("ACCEPTED_THRESHOLD", "sf >= 50000 OR price >= 10"), ("ACCEPTED_ACTION", f"{_any('t', words.DEAL_ACTIONS)} AND sf >= 50000"),
    ], "'BELOW_DEAL_THRESHOLD'",
)
_AVAILABLE = _first(
    [("RUBRIC_REJECT", _ADVISED), ("POLITICAL_CONTENT", "political"), ("ACCEPTED_LISTING", "listing AND industrial"), ("ACCEPTED_WORDS", _any("t", words.AVAILABLE)), ("NOT_INDUSTRIAL", "NOT industrial"), ("ACCEPTED_SIZE", "sf > 0")],
    "'SECTION_RULE_FAILED'",
)
_PEOPLE = _first(
    [
        ("RUBRIC_REJECT", _ADVISED), ("POLITICAL_CONTENT", "political"), ("EXCLUDED_BY_LIST", _any("t", words.NOT_FOR_PEOPLE)),
        ("CATEGORY_MISMATCH", f"NOT ({_has('h', words.PEOPLE_TITLE)} OR starts_with(h, 'people:') OR starts_with(h, 'people |') OR {_any('t', words.PEOPLE_BODY)}) AND {_any('t', words.DEAL_ACTIONS)}"),
        ("NO_PEOPLE_ACTION", f"NOT ({_any('t', _CLEAR)} OR ({_any('t', _SHARED)} AND ({_has('h', words.PERSON_TITLE)} OR {_any('t', words.PERSON_ROLES)})))"),
        ("NOT_INDUSTRIAL", f"NOT ({_any('t', words.INDUSTRY_NAMES)} OR {_has('t', words.AGENCY_TOKEN)})"),
    ], "'ACCEPTED'",
)
_VERDICTS = f"""{_PLACED},
v1 AS (SELECT *, {_any("t", words.POLITICAL)} AS political, {_INDUSTRIAL} IN {_PASSES} AS industrial, {_wrong("t")} AND NOT {_has("t", words.STRONG_ASSET)} AS wrong, {_listing("t")} AS listing,
              round({_AREA}) AS sf, {_SAID} AS said, {_WRITTEN} AS written FROM placed),
v2 AS (SELECT *, CASE WHEN said IS NOT NULL AND said <> 0 THEN said WHEN written >= 1e7 THEN written / 1e6 ELSE said END AS price FROM v1),
v3 AS (SELECT *, {_PEOPLE} AS people FROM v2),
verdicts AS (SELECT ord, source, category, {_RELEVANT} AS relevant, {_TRANSACTIONS} AS transactions, {_AVAILABLE} AS availabilities, people,
  in_region AND NOT political AND NOT wrong AND industrial AND ({_any("t", words.DEAL_ACTIONS)} OR {_any("t", deals.APPROVAL_WORDS)} OR sf IS NOT NULL OR {_has("t", r"\$\s*\d")}) AS routable,
  {_has("h", words.RESCUE_TITLE)} AND in_region AND people = 'ACCEPTED' AS rescued FROM v3)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_verdicts(_placed(spark, sf_dir))


@_query(f"WITH {_VERDICTS} SELECT ord, relevant, transactions, availabilities, people, routable, rescued FROM verdicts")
def section_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every section on every article, deals to route and people to rescue."""
    return _verdicts(spark, sf_dir).select("ord", "relevant", "transactions", "availabilities", "people", "routable", "rescued")


@_query(f"""WITH {_VERDICTS}, u AS (UNPIVOT (SELECT source, relevant, transactions, availabilities, people FROM verdicts) ON relevant, transactions, availabilities, people INTO NAME section VALUE reason)
SELECT source, section, reason, count(*) AS articles FROM u GROUP BY ALL""")
def feed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by feed, section and reason."""
    names = ["relevant", "transactions", "availabilities", "people"]
    long = _verdicts(spark, sf_dir).select("source", *names).unpivot("source", names, "section", "reason")
    return long.groupBy("source", "section", "reason").agg(F.count(F.lit(1)).alias("articles"))


_HOST, _PATH = "lower(regexp_extract(url, '^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))", "regexp_extract(url, '^(?i)[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
_BARE = r"regexp_replace(regexp_replace(url, '([?&])(?:(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|mc_cid|mc_eid|ref|source)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]$', '')"


@_query(f"""WITH {BRIEFS_SQL}, x AS (SELECT *, {_HOST} AS host, {_PATH} AS path, lower(title || ' ' || coalesce(description, '')) AS t, lower(url) AS l FROM briefs)
SELECT ord, host, host || path || regexp_extract(url, '[?][^#]*', 0) AS name, CASE WHEN {_any("host", words.LEFT_AS_IS)} OR {_any("path", words.LEFT_AS_IS)} THEN url ELSE {_BARE} END AS cleaned,
{_has("l", words.REFUSED_LINK)} AS refused, CASE WHEN {_has("l", words.REFUSED_LINK)} THEN false
  WHEN {_any("lower(source)", words.LIGHTLY_FILTERED)} OR {_any("l", [w.replace(" ", "") for w in words.LIGHTLY_FILTERED])} THEN NOT {_has("t", words.OFF_TOPIC)}
  ELSE (host IN ({", ".join(map(_q, DOMAINS))}) OR {" OR ".join(f"ends_with(host, '.{d}')" for d in DOMAINS)}) AND {_has("t", words.ON_TOPIC)} END AS taken FROM x""")
def link_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, names and clean forms of links, which are refused, and which articles are taken in."""
    rows = briefs(spark, sf_dir)
    url = F.col("url")
    taken = links.link_verdict(F.col("title"), F.col("description"), F.col("source"), url, DOMAINS)
    return rows.select("ord", links.host(url).alias("host"), links.host_path_query(url).alias("name"), links.cleaned(url).alias("cleaned"), links.is_refused(url).alias("refused"), taken.alias("taken"))
