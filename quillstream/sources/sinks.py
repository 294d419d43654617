"""Sinks: feeds as text, upserts by day, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import escaped_html


def rss_items(df: DataFrame) -> DataFrame:
    """One RSS item a row, as ``value`` for a text sink."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped_html(c), F.lit(f"</{name}>"))
    return df.select(F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")), tag("guid", F.col("id")), F.lit("</item>")).alias("value"))


def json_feed_items(df: DataFrame) -> DataFrame:
    """One JSON Feed item a row; the summary is the first 200 characters and an ellipsis."""
    text = F.coalesce("description", F.lit(""))
    summary = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return df.select(F.to_json(F.struct("id", F.col("link").alias("url"), "title", summary.alias("summary"), F.col("pub_ts").alias("date_published"))).alias("value"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` over ``old`` by key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest(df: DataFrame, by: Column, keep: int) -> DataFrame:
    """The rows of the newest ``keep`` values; only distinct values are ranked."""
    days = df.select(by.alias("_day")).distinct().orderBy(F.desc("_day")).limit(keep)
    return df.withColumn("_day", by).join(days, "_day", "left_semi").drop("_day")


def appended_log(log: DataFrame, new: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """A sent log without entries older than ``days``, and new ids that it lacks."""
    kept = log.where(F.col("sent_at") >= F.date_sub(as_of, days))
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("sent_at"))).where("_n = 1").drop("_n")
    return kept.unionByName(first.join(kept.select("id"), "id", "left_anti"))
