"""Sources of articles: landed feeds, stored JSON, and the synthetic stream over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import given
from quillstream.operators.rounds import spread

VERBS = ["buys", "leases", "lists", "promotes", "develops"]


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of landed RSS (``item``) or Atom (``entry``) files."""
    schema = "title string, link string, guid string, description string, pubDate string, author string"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def raw_items(df: DataFrame, xml: str) -> DataFrame:
    """Items cut from raw XML by pattern, for feeds that no parser reads: title, link, guid, description, pub_date."""
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    items = df.select("*", F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("ord", "item"))
    return items.select(*df.columns, "ord", *(part(t).alias(t) for t in ("title", "link", "guid", "description", "pubDate"))).drop(xml)


def json_feed(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a stored JSON Feed; rows without an http address or a title are corrupt and go."""
    item = "id string, url string, title string, content_html string, content_text string, summary string, date_published string, category string, tags array<string>"
    items = spark.read.schema(f"items array<struct<{item.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).json(path).select(F.inline("items"))
    good = items.where(F.col("url").startswith("http") & (F.coalesce("title", F.lit("")) != ""))
    return good.withColumn("description", given(F.col("content_text"), F.col("content_html"), F.col("summary")))


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article an order: ord, id, title, place, source, pub_ts. Scans read the named columns only."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = spread(rows, rows=orders.count())  # after the join: a large one deals its rows by bytes
    whole = F.floor("o_totalprice").cast("long")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "K SF warehouse in ").otherwise(",000 SF industrial building in ")
    title = F.concat("c_name", F.lit(" "), verb, F.lit(" "), (whole % 900 + 10).cast("string"), kind, F.col("n_name"), F.lit(" for $"), (whole % 95 + 1).cast("string"), F.lit("M"))
    return rows.select(F.col("o_orderkey").alias("ord"), F.sha1(F.concat(F.lit("a"), F.col("o_orderkey").cast("string"))).alias("id"), title.alias("title"), F.col("n_name").alias("place"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("pub_ts"), F.col("c_custkey").alias("author_id"))


#: The same rows in SQL.
SYNTHETIC_SQL = """articles AS (
  SELECT o_orderkey AS ord, sha1('a' || o_orderkey) AS id,
         c_name || ' ' || CASE o_orderkey % 5 WHEN 0 THEN 'buys' WHEN 1 THEN 'leases' WHEN 2 THEN 'lists' WHEN 3 THEN 'promotes' ELSE 'develops' END || ' '
           || CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 + 10 AS VARCHAR)
           || CASE WHEN o_orderkey % 2 = 0 THEN 'K SF warehouse in ' ELSE ',000 SF industrial building in ' END
           || n_name || ' for $' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 95 + 1 AS VARCHAR) || 'M' AS title,
         n_name AS place, o_orderpriority AS source, o_orderdate AS pub_ts, c_custkey AS author_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
