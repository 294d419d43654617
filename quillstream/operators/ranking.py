"""Scores of articles, names of publishers, and small upkeep of stores and feeds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes and amounts that are scored, over lower-cased text.
SIZE = r"([\d,.]+)\s*(?:million\s*)?(?:sf|sq\.?\s*f|square\s*f)"
AMOUNT = r"\$([\d,.]+)\s*(?:million|m(?:il|ln)?|billion|b(?:il|ln)?)\b"
BARE_HOST = r"^(?i)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)+$"


@dataclass(frozen=True)
class Weights:
    """What :func:`article_score` adds: regions by pattern, companies and hosts in order of precedence, words that cost."""

    regions: list[tuple[str, int]]
    companies: dict[str, int] = field(default_factory=dict)
    hosts: dict[str, int] = field(default_factory=dict)
    unwanted: list[str] = field(default_factory=list)
    high_sf: float = 100_000
    high_millions: float = 50


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), r"^\d*\.?\d*", 0)
    return found.try_cast("double")


def _first(text: Column, points: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for word, n in reversed(points.items()):
        out = F.when(text.contains(word.lower()), n).otherwise(out)
    return out


def article_score(title: Column, description: Column, url: Column, published: Column, as_of: Column, weights: Weights) -> Column:
    """Points for regions, size, price, the first company and host that are known, a description, recency, less unwanted words.

    An amount counts as it is said, in millions or billions alike.
    """
    text, link = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))), F.lower(F.coalesce(url, F.lit("")))
    sf, amount = _number(text, SIZE), _number(text, AMOUNT)
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 3600
    unwanted = F.lit(False)
    for word in weights.unwanted:
        unwanted = unwanted | text.contains(word.lower())
    parts = [F.when(text.rlike(pattern), n).otherwise(0) for pattern, n in weights.regions]
    parts.append(F.when(sf >= weights.high_sf * 5, 25).when(sf >= weights.high_sf, 15).when(sf >= weights.high_sf * 0.5, 5).otherwise(0))
    parts.append(F.when(amount >= weights.high_millions * 2, 25).when(amount >= weights.high_millions * 0.5, 15).when(amount >= weights.high_millions * 0.2, 5).otherwise(0))
    parts.append(F.coalesce(_first(text, weights.companies), F.lit(0)))
    parts.append(F.coalesce(_first(link, weights.hosts), F.when(~link.contains("news.google.com"), 10).otherwise(0)))
    parts.append(F.when(F.length(F.coalesce(description, F.lit(""))) > 50, 5).otherwise(0))
    parts.append(F.when(hours < 12, 10).when(hours < 24, 5).otherwise(0))
    parts.append(F.when(unwanted, -20).otherwise(0))
    return sum(parts, F.lit(0))


def publisher(title: Column, source: Column, url: Column, known: dict[str, str]) -> Column:
    """The publisher of an article: the title's last segment if it is a name, or a host; else a known domain in source or
    address, the feed of a news search, the source. ``known``: names by domain, in order of precedence.
    """
    parts = F.split(F.coalesce(title, F.lit("")), r"\s+[-–—|]\s+")
    last = F.when(F.size(parts) >= 2, F.trim(F.element_at(parts, -1)))
    host = F.regexp_replace(F.lower(last), r"^www\.", "")
    of_host = host
    for domain, name in reversed(known.items()):
        of_host = F.when((host == domain) | host.endswith(f".{domain}"), name).otherwise(of_host)
    of_host = F.when(host == "news.google.com", "Google News").otherwise(of_host)
    feed, link = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    by_domain = F.lit(None).cast("string")
    for domain, name in reversed(known.items()):
        by_domain = F.when(F.concat(feed, F.lit(" "), link).contains(domain), name).otherwise(by_domain)
    capital = lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    searched = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(feed, r"^google news\s+", "")), r"\s+"), lambda w: capital(w)), " ")
    return (
        F.when(last.rlike("^[A-Z]") & F.length(last).between(2, 60), last).when((F.length(last) <= 60) & last.rlike(BARE_HOST), of_host).when(by_domain.isNotNull(), by_domain)
        .when(feed.rlike(r"^google news\b"), searched).when((feed == "news.google.com") | link.contains("news.google.com"), "Google News").otherwise(F.coalesce(source, F.lit("Source")))
    )


def placeholder_index(title: Column, images: int) -> Column:
    """Which of ``images`` stands for a title: the sum of its UTF-16 units modulo their number."""
    above = lambda c: 0xD800 + 0xDC00 + F.floor((c - 0x10000) / 1024) + (c - 0x10000) % 1024  # noqa: E731  both units of a pair
    codes = F.transform(F.filter(F.split(F.coalesce(title, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    units = F.transform(codes, lambda c: F.when(c < 0x10000, c).otherwise(above(c)).cast("long"))
    return (F.aggregate(units, F.lit(0).cast("long"), lambda a, c: a + c) % images).cast("int")


def deduplicated(df: DataFrame, link_key: Column, title_key: Column, order_col: str, fetched: str) -> DataFrame:
    """The first row of each link; of rows without a link the newest of each title, the first of equally new ones."""
    rows = df.withColumn("_link", F.nullif(link_key, F.lit(""))).withColumn("_title", F.nullif(title_key, F.lit("")))
    linked = rows.where(F.col("_link").isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("_link").orderBy(order_col)))
    titled = rows.where(F.col("_link").isNull() & F.col("_title").isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("_title").orderBy(F.desc(fetched), order_col)))
    return linked.unionByName(titled).where("_k = 1").drop("_k", "_link", "_title")


def carried_over(now: DataFrame, before: DataFrame, key: str, of_kind: str, only: Column | None = None) -> DataFrame:
    """``now``, and of each kind that has no row there the rows of the run before; of those ``only`` such (as scraped ones)."""
    missing = (before if only is None else before.where(only)).join(now.select(of_kind).distinct(), of_kind, "left_anti")
    return now.unionByName(missing.join(now.select(key), key, "left_anti"))


def toggled_backups(backups: DataFrame, scraped: DataFrame, least: int) -> DataFrame:
    """Backup feeds (domain, name, enabled) with enabled as it should be: off where the domain's scraper works.

    ``scraped``: domain, ok, fetched; a scraper is its domain, or named by the domain's first part (bloomberg for bloomberg.com),
    so both are joined by that part.
    """
    part = lambda c: F.lower(F.substring_index(F.substring_index(c, " ", 1), ".", 1))
    known = backups.select("domain", part(F.col("domain")).alias("_part")).distinct()
    scraped = scraped.select(part(F.col("domain")).alias("_part"), "ok", "fetched").join(known, "_part")
    works = scraped.groupBy("domain").agg(F.bool_or(F.coalesce(F.col("ok") & (F.col("fetched") >= least), F.lit(False))).alias("_works"))
    out = backups.join(works, "domain", "left").withColumn("_on", ~F.coalesce("_works", F.lit(False)))
    return out.select("domain", "name", F.col("_on").alias("enabled"), (F.coalesce("enabled", F.lit(True)) != F.col("_on")).alias("changed"))


def point_updates(store: DataFrame, updates: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(store with the last update of each key in ``column``, updates with status 200, or 404 where the store lacks the key).

    ``updates``: key, column, ord.
    """
    last = updates.groupBy(key).agg(F.max_by(column, "ord").alias("_new"))
    out = store.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    there = store.select(key).distinct().withColumn("_there", F.lit(True))
    return out, updates.join(there, key, "left").withColumn("status", F.when(F.col("_there"), 200).otherwise(404)).drop("_there")
