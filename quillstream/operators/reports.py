"""Reports on feeds, editions and reserves, and the filters of the programming interface and the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.health import COVERAGE_WEIGHTS, PENALTY_POINTS, grade

# A title that is a scraped index page; framings of comparison; words without which an item is weak.
PAGE_TITLE = r"[-–—]\s*page\s+\d+\b"
COMPARES = r"\b(and|vs\.?|versus|compared|comparison|approaches|both|either|between|outpaces?|leads?|trails?)\b"
INDUSTRIAL_SIGNAL = r"\b(warehouse|industrial|logistics|distribution|fulfillment|manufactur|lease|sublease|\bsf\b|square (foot|feet)|acre|\$\s?\d|port|cold storage|spec|build-to-suit|big.?box|last.?mile|developer|portfolio|tenant)\b"
#: Supply: rich from so many sections with candidates and candidates on; thin up to so many sections, or below so many.
RICH, THIN = (3, 25), (1, 8)


def fetch_report(df: DataFrame, feed: str, kept: Column, ok: Column) -> DataFrame:
    """Per feed: fetched, kept, kept_pct, low_value (more than 20 fetched, none kept), ok; failing feeds first, then by name."""
    out = df.groupBy(feed).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(kept).alias("kept"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("ok"))
    out = out.withColumn("kept_pct", F.round(100 * F.col("kept") / F.col("fetched")).cast("long")).withColumn("low_value", (F.col("fetched") > 20) & (F.col("kept") == 0))
    return out.orderBy("ok", feed)


def fetch_totals(report: DataFrame) -> DataFrame:
    """One row over a fetch report: feeds, ok, failed, fetched, kept."""
    return report.agg(F.count(F.lit(1)).alias("feeds"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))


def first_region(text: Column, regions: list[tuple[str, str]], otherwise: str = "National") -> Column:
    """The first region whose pattern a lower-cased text matches."""
    out = F.when(text.rlike(regions[0][1]), regions[0][0])
    for name, pattern in regions[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def region_points(tagged: Column, text: Column, target: str, macro: str) -> Column:
    """1 for an item tagged or set in the target, 0.4 for the national market, else 0."""
    return F.when(F.coalesce(tagged, F.lit(False)) | text.rlike(target), 1.0).when(text.rlike(macro), 0.4).otherwise(0.0)


def broken_title(title: Column) -> Column:
    """Whether a title is shorter than 20 characters, one word, or that of an index page."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (F.length(t) < 20) | ~t.rlike(r"\s") | F.lower(t).rlike(PAGE_TITLE)


def region_leak(title: Column, text: Column, section: Column, routed: Column, excluded: str, target: str, macro: str) -> Column:
    """Whether an item of another region leaked: named, not routed, and no comparison of regions among the relevant ones.

    The publisher after the last dash of a title is no evidence.
    """
    core = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+[-–—]\s+[^-–—]*$", "")
    mixed = core.rlike(excluded) & core.rlike(target) & (core.rlike(COMPARES) | text.rlike(macro)) & (section == "relevant")
    return text.rlike(excluded) & ~F.coalesce(routed, F.lit(False)) & ~mixed


def penalties(df: DataFrame, edition: str, flags: dict[str, Column]) -> DataFrame:
    """Per edition: how often each penalty of PENALTY_POINTS applies, and the points of all."""
    out = df.groupBy(edition).agg(*(F.count_if(F.coalesce(flags[k], F.lit(False))).alias(k) for k in PENALTY_POINTS))
    return out.withColumn("points", sum((F.col(k) * p for k, p in PENALTY_POINTS.items()), F.lit(0)))


def content_score(coverage: Column, freshness: Column, regional: Column, points: Column) -> Column:
    """Struct of score, 0 to 100 with 20 for relevance, and its letter."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(coverage + freshness + regional + 20 - points + 0.5))).cast("int")
    return F.struct(score.alias("score"), grade(score).alias("grade"))


def delivery_score(late_minutes: Column, manual: Column) -> Column:
    """100 less a point for each 15 minutes beyond 30, ten at most, and five for a manual send."""
    over = F.greatest(F.lit(0), late_minutes - 30)
    return (100 - F.least(F.lit(10), F.ceil(over / 15)) - F.when(manual, 5).otherwise(0)).cast("int")


def supply_status(df: DataFrame, edition: str, section: str, selected: str, in_window: str, passed: str, candidates: str) -> DataFrame:
    """Per edition: Rich, Normal or Thin supply, editorial coverage (30 at most) over sections that had any, supply score."""
    weight = F.lit(0)
    for name, w in COVERAGE_WEIGHTS.items():
        weight = F.when(F.col(section) == name, w).otherwise(weight)
    status = F.when(F.col(selected) > 0, "FILLED").when(F.col(in_window) == 0, "NO_FRESH_SUPPLY").when(F.col(passed) == 0, "QUALITY_REJECTED").otherwise("SELECTION_GAP")
    rows = df.withColumn("_w", weight).withColumn("_s", status)
    sums = rows.groupBy(edition).agg(
        F.count_if(F.col(candidates) > 0).alias("_with"), F.coalesce(F.sum(candidates), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.when(F.col("_s") == "FILLED", F.col("_w"))), F.lit(0)).alias("_filled"),
        F.coalesce(F.sum(F.when(F.col("_s") != "NO_FRESH_SUPPLY", F.col("_w"))), F.lit(0)).alias("_could"),
    )
    supply = F.when((F.col("_with") >= RICH[0]) & (F.col("candidates") >= RICH[1]), "Rich").when((F.col("_with") <= THIN[0]) | (F.col("candidates") < THIN[1]), "Thin").otherwise("Normal")
    editorial = F.when(F.col("_could") > 0, 30.0 * F.col("_filled") / F.col("_could")).otherwise(30.0)
    return sums.select(edition, "candidates", supply.alias("supply"), editorial.alias("editorial_coverage"), F.floor(100 * F.col("_filled") / 30 + 0.5).cast("int").alias("supply_score"))


def reserve(df: DataFrame, id_col: str, section: str, signature: str, ts: str, order: list[Column], as_of: Column, sent: DataFrame, sent_sigs: DataFrame, days: int = 90, most: int = 25) -> DataFrame:
    """The best rows of each section from the last days, not sent, whose signature was not sent, one a signature."""
    recent = df.where((F.col(ts) <= as_of) & (F.col(ts) >= F.date_sub(as_of, days)))
    fresh = recent.join(sent.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    fresh = fresh.join(sent_sigs.select(F.col("signature").alias(signature)).distinct(), signature, "left_anti")
    named = fresh.where(F.col(signature).isNotNull())
    first = named.withColumn("_k", F.row_number().over(Window.partitionBy(section, signature).orderBy(*order))).where("_k = 1").drop("_k")
    pool = first.unionByName(fresh.where(F.col(signature).isNull()).select(*first.columns))
    return pool.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("place") <= most)


def stage_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what a stage added and dropped."""
    added = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).join(after.select(key), key, "left_anti").withColumn("change", F.lit("dropped")))


def sent_before(df: DataFrame, id_col: str, day: str, signatures: str) -> DataFrame:
    """Per row: whether one of its signatures stood in an edition of an earlier day."""
    rows = df.select(id_col, day, F.explode(signatures).alias("_sig"))
    first = rows.groupBy("_sig").agg(F.min(day).alias("_first"))
    repeated = rows.join(first, "_sig").groupBy(id_col).agg(F.bool_or(F.col("_first") < F.col(day)).alias("_repeat"))
    return df.join(repeated, id_col, "left").withColumn("repeats", F.coalesce("_repeat", F.lit(False))).drop("_repeat")


def with_flag(df: DataFrame, key: str, listed: DataFrame, name: str) -> DataFrame:
    """``df`` with whether its key is listed."""
    return df.join(listed.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_picks(df: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """``df`` and the picks that it lacks."""
    return df.unionByName(picks.join(df.select(key), key, "left_anti"))


def request_verdicts(df: DataFrame, client: str, ts: str, order: list[Column], most: int = 100, seconds: int = 60) -> DataFrame:
    """Status of each request, 429 beyond ``most`` of a client in a fixed window."""
    start = F.floor(F.unix_timestamp(ts) / seconds) * seconds
    n = F.row_number().over(Window.partitionBy(client, "_start").orderBy(*order))
    return df.withColumn("_start", start).withColumn("status", F.when(n > most, 429).otherwise(200)).drop("_start")


def items_filtered(df: DataFrame, order_col: str, ts: str, since: Column, until: Column, region: str | None = None, source: str | None = None, limit: int = 200) -> DataFrame:
    """The first ``limit`` matching items in the order in which they came, then newest first. Items without regions or
    source pass those filters. Columns: regions, source.
    """
    out = df.where((F.col(ts) >= since) & (F.col(ts) <= until))
    if region is not None:
        out = out.where(F.coalesce(F.size("regions") <= 0, F.lit(True)) | F.array_contains("regions", region))
    if source is not None:
        out = out.where(F.col("source").isNull() | (F.col("source") == "") | (F.col("source") == source))
    return out.orderBy(order_col).limit(limit).orderBy(F.desc(ts), order_col)


def page_filtered(df: DataFrame, ts: str, as_of: Column, days: int | None = None, query: str | None = None, region: str | None = None, category: str | None = None, source: str | None = None, sort: str | None = None) -> DataFrame:
    """What the page shows: no excluded categories, within days, with the words asked for, newest or oldest first if ``sort`` says so.

    Columns: title, description, category, source.
    """
    out = df.where(~F.coalesce(F.col("category"), F.lit("")).isin("not relevant", "excluded", "blacklisted"))
    if days is not None:
        out = out.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    if query:
        out = out.where(F.coalesce(F.lower("title").contains(query.lower()), F.lit(False)) | F.coalesce(F.lower("description").contains(query.lower()), F.lit(False)))
    if region:
        out = out.where(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).contains(region.lower()))
    if category:
        out = out.where(F.col("category") == category)
    out = out.where(F.col("source") == source) if source else out
    return out if sort is None else out.orderBy(F.desc_nulls_last(ts) if sort == "newest" else F.asc_nulls_first(ts))


def topics_met(df: DataFrame, id_col: str, text: Column, topics: list[str]) -> DataFrame:
    """(id, topics): the topics that a text contains, rows with one at least. ``topics`` is a user's short list."""
    met = F.filter(F.array(*(F.lit(t) for t in topics)), lambda t: F.contains(F.lower(text), F.lower(t)))
    return df.select(F.col(id_col), met.alias("topics")).where(F.size("topics") > 0)


def unless_ignored(df: DataFrame, id_col: str, text: Column, topics: list[str], ignored: DataFrame) -> DataFrame:
    """Rows whose id isn't in ``ignored`` (id) and whose text holds none of the topics, a user's short list."""
    held = F.exists(F.array(*(F.lit(t) for t in topics)), lambda t: F.contains(F.lower(text), F.lower(t))) if topics else F.lit(False)
    return df.where(~F.coalesce(held, F.lit(False))).join(ignored.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")


def within_feed(df: DataFrame, ts: str, as_of: Column, days: int = 31) -> DataFrame:
    """Rows that the published feed keeps: of the last ``days``; rows without a time count as new."""
    return df.where(F.coalesce(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(True)))


def retained(df: DataFrame, ts: str, as_of: Column, keep_days: int = 90, archive_days: int = 180) -> DataFrame:
    """Rows with retention: keep, prune (older than ``keep_days``) or archive (older than ``archive_days``)."""
    age = F.date_diff(as_of, F.to_date(ts))
    return df.withColumn("retention", F.when(age > archive_days, "archive").when(age > keep_days, "prune").otherwise("keep"))
