"""Short synthetic articles whose words reach the gates and section filters; one an order, the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.regions import Regions
from quillstream.operators.rounds import spread, written

PHRASES = [
    "warehouse of 120,000 SF sold for $31 million", "developer breaks ground on industrial park", "office tower lease signed", "firm takes 12,000 sf office", "industrial heir tells his story",
    "industrial revolution remembered", "industrial demand rises, report says", "planning board approved logistics center", "freight rates climb again", "freight moves through new rail yards",
    "interest rate outlook for lenders", "pickup for sale after test drive", "land for sale", "building for sale on 12 acres", "tenant renews lease", "tenant leases 20,000 sqft hall", "Newmark broker honored",
    "CBRE named vice president of capital markets", "Prologis wins award", "JLL promotes managing director, logistics", "company announces move", "sloth found in warehouse", "Industrial - Page 36",
    "immigrants held in detention warehouse", "stormwater detention basin at distribution center", "self-storage unit portfolio acquired", "apartment complex with loading dock", "restaurant space for lease",
    "owner lists 40 acres site", "broker markets the industrial portfolio", "owner sells and lists the building", "governor visits warehouse", "helicopter crash at logistics hub", "data center campus planned, 600 MW",
    "data center project proposed for $7 billion", "data center moratorium debated", "data centers to watch", "data center complex planned", "data center facility of 80 MW under construction", "cold storage facility available now",
    "spec industrial building of 80K SF delivered", "residential broker joins redfin", "walmart taps supply chain chief", "saas platform raises $40 million to expand", "Industrial Development Authority meets",
    "flex space, 43K SF - LoopNet", "For Lease | 22,000 SF industrial", "bank opens branch", "recap of $14M loan for manufacturing facility", "nothing to see here", "score of the game", "hotel sale closed",
    "e-commerce growth and automation", "joint venture recapitalization", "office footprint quadrupled", "reit earnings and absorption", "55,000 SF warehouse acquired", "retail center sold for $9 million",
]
PLACES = ["Brazil", "Canada", "Chester", "Westchester", "Peru", "Kenya", "Egypt", "Jordan", "Japan", "India"]
HOSTS = ["news.example.com", "Daily.example.org:8080", "cache.example.net", "press.regional.example", "other.test"]
PATHS = ["/a/", "/redirect/", "/x?utm_source=m&id=", "/y?id=7&gclid="]
#: Two places are the target; one of the others holds one of their names.
REGIONS = Regions(
    targets=["BRAZIL", "CANADA", "CHESTER"], excluded=["WESTCHESTER", "PERU", "KENYA", "EGYPT"], foreign=["JAPAN"], target_phrase=r"\b(?:brazil|canada|chester)\b",
    other_phrase=r"\b(?:westchester|peru|kenya|egypt|jordan|japan|india)\b", also_excluded=["JORDAN"], approved_hosts=["example.com", "example.org", "example.net", "regional.example"],
    regional_sources=["press.regional"], own_names=["newmark"],
)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, title, description, url, source, tags, approved, category, pub_ts: written and read, as articles come from a store.

    Else Spark would put the making of a title in place of each use of it, and the code of a gate would grow too long.
    """
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("pub_ts"))
    rows = spread(rows)
    ord_ = F.col("ord")
    one, two, here, there = _pick(PHRASES, ord_ * 7 + F.floor(ord_ / 61)), _pick(PHRASES, ord_ * 13 + F.floor(ord_ / 64)), _pick(PLACES, ord_ * 3 + F.floor(ord_ / 32)), _pick(PLACES, ord_ * 5 + 1)
    title = F.when(ord_ % 4 == 0, F.concat(here, F.lit(" "), one)).when(ord_ % 4 == 1, F.concat(one, F.lit(" in "), here)).when(ord_ % 4 == 2, one).otherwise(F.concat(here, F.lit(" group buys "), there, F.lit(" "), one))
    description = F.when(ord_ % 9 == 0, F.lit(None).cast("string")).when(ord_ % 5 == 0, F.concat(two, F.lit(" near "), there)).otherwise(two)
    url = F.concat(F.lit("https://www."), _pick(HOSTS, F.floor(ord_ / 4)), _pick(PATHS, F.floor(ord_ / 32)), ord_.cast("string"))
    return spread(written(rows.select(
        "ord", title.alias("title"), description.alias("description"), url.alias("url"), "source", "pub_ts", F.when(ord_ % 16 == 0, F.array(there)).alias("tags"),
        F.when(ord_ % 6 == 0, False).when(ord_ % 6 == 1, True).alias("approved"), F.when(ord_ % 2 == 0, "relevant").otherwise("transactions").alias("category"),
    )))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _picked(values: list[str], index: str) -> str:
    return f"{_list(values)}[({index}) % {len(values)} + 1]"


_HERE, _THERE = _picked(PLACES, "o_orderkey * 3 + o_orderkey // 32"), _picked(PLACES, "o_orderkey * 5 + 1")
_ONE, _TWO = _picked(PHRASES, "o_orderkey * 7 + o_orderkey // 61"), _picked(PHRASES, "o_orderkey * 13 + o_orderkey // 64")
BRIEFS_SQL = f"""briefs AS (
  SELECT o_orderkey AS ord, o_orderpriority AS source, o_orderdate AS pub_ts,
         CASE o_orderkey % 4 WHEN 0 THEN {_HERE} || ' ' || {_ONE} WHEN 1 THEN {_ONE} || ' in ' || {_HERE} WHEN 2 THEN {_ONE} ELSE {_HERE} || ' group buys ' || {_THERE} || ' ' || {_ONE} END AS title,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN {_TWO} || ' near ' || {_THERE} ELSE {_TWO} END AS description,
         'https://www.' || {_picked(HOSTS, "o_orderkey // 4")} || {_picked(PATHS, "o_orderkey // 32")} || o_orderkey AS url,
         CASE WHEN o_orderkey % 16 = 0 THEN [{_THERE}] END AS tags, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN true END AS approved,
         CASE WHEN o_orderkey % 2 = 0 THEN 'relevant' ELSE 'transactions' END AS category
  FROM orders)"""
