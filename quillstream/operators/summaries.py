"""Small reports over articles, feeds, feedback and model verdicts: counts in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories that a health page counts, and how many items a section of each kind of edition shows.
CATEGORIES = ["relevant", "transaction", "availabilities", "people", "not relevant", "excluded", "unapproved source", "blacklisted"]
SHOWN = {
    "standard": {"relevant": 10, "transactions": 10, "availabilities": 10, "people": 10},
    "work": {"relevant": 6, "transactions": 6, "availabilities": 6, "people": 6, "week": 5},
    "goth": {"relevant": 10, "transactions": 8, "availabilities": 8, "people": 6},
}


def category_pivot(df: DataFrame, category: str) -> DataFrame:
    """One row: all articles and those of each of CATEGORIES; no category counts as not relevant, others as none."""
    c = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("not relevant"))
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c == name).alias(name.replace(" ", "_")) for name in CATEGORIES))


def scraper_summary(feeds: DataFrame) -> DataFrame:
    """One row over feeds (type, status, fetched, kept) of the type scraper."""
    s = feeds.where("type = 'scraper'")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), total("fetched"), total("kept"))


def configured(feeds: DataFrame, configs: DataFrame, previous: DataFrame, last: int = 20) -> DataFrame:
    """Feeds (name, status, fetched, kept) with region, tier and history of their configuration and of the run before.

    Feeds without a configuration have region US and tier C; ``history`` is the ``last`` outcomes with this one at its end.
    """
    rows = feeds.join(configs.select("name", F.col("region").alias("_region"), F.col("tier").alias("_tier")), "name", "left").join(previous.select("name", F.col("history").alias("_before")), "name", "left")
    history = F.concat(F.coalesce("_before", F.array().cast("array<string>")), F.array("status"))
    rate = F.when(F.col("fetched") > 0, F.concat(F.round(F.col("kept") / F.col("fetched") * 100).cast("long").cast("string"), F.lit("%"))).otherwise("N/A")
    return rows.select(
        "name", "status", "fetched", "kept", F.coalesce("_region", F.lit("US")).alias("region"), F.coalesce("_tier", F.lit("C")).alias("tier"), F.slice(history, F.greatest(F.size(history) - last + 1, F.lit(1)), last).alias("history"),
        rate.alias("kept_rate"), ((F.col("fetched") > 20) & (F.col("kept") == 0)).alias("low_value"),
    )


def region_health(feeds: DataFrame, regions: list[str], searched: str = "Google News") -> DataFrame:
    """(region, kept, feeds, zero_kept, direct, searched) of configured feeds; feeds of other regions count for the last one."""
    region = F.when(F.col("region").isin(regions), F.col("region")).otherwise(regions[-1])
    by_search = F.contains("name", F.lit(searched))
    return feeds.groupBy(region.alias("region")).agg(
        F.sum("kept").cast("long").alias("kept"), F.count(F.lit(1)).alias("feeds"), F.count_if((F.col("kept") == 0) & (F.col("fetched") > 0)).alias("zero_kept"), F.count_if(~by_search).alias("direct"), F.count_if(by_search).alias("searched")
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(action, reason, n) of feedback: approved and rejected in all (reason null), and rejections by reason."""
    counted = feedback.where(F.col("action").isin("approved", "rejected")).groupBy("action").agg(F.count(F.lit(1)).alias("n")).select("action", F.lit(None).cast("string").alias("reason"), "n")
    reasons = feedback.where("action = 'rejected' AND reason <> ''").groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(reasons)


def supply_candidates(facts: DataFrame, reserve: DataFrame) -> DataFrame:
    """(section, candidates): what the market gave, before any section's own filter, and what the reserve holds.

    facts: section, in_region, not_excluded, routable, industrial; reserve: section.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    given = (
        F.when(F.col("section") == "relevant", yes("not_excluded")).when(F.col("section") == "transactions", yes("in_region") & yes("routable"))
        .when(F.col("section") == "availabilities", yes("in_region") & yes("industrial")).when(F.col("section") == "people", yes("in_region")).otherwise(False)
    )
    return facts.where(given).select("section").unionByName(reserve.select("section")).groupBy("section").agg(F.count(F.lit(1)).alias("candidates"))


def reserve_stats(candidates: DataFrame, sent: DataFrame, sent_sigs: DataFrame, id_col: str = "id") -> DataFrame:
    """(section, candidates, sent_excluded, sig_excluded, kept): a candidate sent before goes first, then one with a signature sent before."""
    marked = candidates.join(sent.select(F.col(id_col)).distinct().withColumn("_sent", F.lit(True)), id_col, "left").join(sent_sigs.select("sig").distinct().withColumn("_told", F.lit(True)), "sig", "left")
    was_sent, was_told = F.coalesce("_sent", F.lit(False)), F.coalesce("_told", F.lit(False))
    return marked.groupBy("section").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(was_sent).alias("sent_excluded"), F.count_if(~was_sent & was_told).alias("sig_excluded"), F.count_if(~was_sent & ~was_told).alias("kept"))


def distinct_sources(df: DataFrame, source: str) -> DataFrame:
    """Sources in order, without empty ones."""
    return df.where(F.coalesce(F.col(source), F.lit("")) != "").select(source).distinct().orderBy(source)


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """(category, approved, rejected, undecided, tokens) of model verdicts (category, approve, tokens)."""
    return verdicts.groupBy(F.coalesce("category", F.lit("unclassified")).alias("category")).agg(
        F.count_if(F.coalesce("approve", F.lit(False))).alias("approved"), F.count_if(~F.coalesce("approve", F.lit(True))).alias("rejected"), F.count_if(F.col("approve").isNull()).alias("undecided"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")
    )


def shown(items: DataFrame, kind: str, section: str = "section", place: str = "place", by: tuple[str, ...] = ("edition",)) -> DataFrame:
    """Items that an edition of a kind (a key of SHOWN) shows: the first places of each section."""
    most = F.lit(0)
    for name, n in SHOWN[kind].items():
        most = F.when(F.col(section) == name, n).otherwise(most)
    ranked = items.withColumn("_k", F.row_number().over(Window.partitionBy(*by, section).orderBy(place)))
    return ranked.where(F.col("_k") <= max(SHOWN[kind].values())).where(F.col("_k") <= most).drop("_k")


def unless_sent_title(df: DataFrame, title_key: Column, sent: DataFrame, as_of: Column, days: int = 14, least: int = 25) -> DataFrame:
    """Rows whose title, of ``least`` characters or more, was not sent (title_key, sent_at) in the last ``days``."""
    recent = sent.where((F.col("sent_at") >= F.date_sub(F.to_date(as_of), days)) & (F.length("title_key") >= least)).select(F.col("title_key").alias("_told")).distinct()
    return df.withColumn("_key", title_key).join(recent, F.col("_key") == F.col("_told"), "left_anti").drop("_key")
