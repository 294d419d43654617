"""Editions of the synthetic articles, assembled by the cascade: one a month of the table, at seven o'clock of its eighth day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import deals, gates
from quillstream.functions.text import scorer_title
from quillstream.operators import cascade, classifiers, editions, final_gates, health, ranking, regions, reports, sections, selection, signatures, summaries
from quillstream.operators.rounds import written
from quillstream.plans.classifier_queries import MARKETS
from quillstream.plans.gate_queries import _placed
from quillstream.plans.report_queries import _FIRMS, _GROUPS, _MARKETS, _STATES, _WEIGHTS
from quillstream.sources.briefs import REGIONS

QUERIES = {}
SQL: dict[str, str] = {}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cascade asks of every article: category, verdicts, gates, scores, signatures, names."""
    rows = _placed(spark, sf_dir).drop("category")
    title, description, text = F.col("title"), F.col("description"), F.col("text")
    rows = classifiers.recategorized(rows.withColumn("link", F.col("url"))).withColumnRenamed("new_category", "section")
    rows = sections.with_verdicts(rows)
    verdict = gates.data_centre_verdict(text, F.col("in_region"), F.col("elsewhere") > 0)
    rows = final_gates.gated(rows.withColumn("verdict", verdict), "verdict", "section", MARKETS)
    passes = F.lit(False)
    for name in cascade.SECTIONS:
        passes = F.when(F.col("section") == name, F.col(name).startswith(sections.ACCEPTED)).otherwise(passes)
    key, place = scorer_title(title), regions.place_of(rows)
    return written(rows.select(
        F.col("ord").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("pub_ts").cast("timestamp").alias("ts"), "section", passes.alias("passes"), "in_region", regions.not_excluded(text, REGIONS, place).alias("not_excluded"),
        regions.passes_with_description(title, description, F.col("source"), F.col("section"), REGIONS, place).alias("described_ok"), "political", "to_people",
        F.col("routable").alias("routable"), "rescued", F.when(F.col("verdict") == "reject-oor", "reject").when(F.col("verdict").isin(final_gates.EXCEPTIONS), "exception").otherwise("ok").alias("centre"),
        ranking.article_score(title, description, F.col("url"), F.col("pub_ts"), F.col("pub_ts"), _WEIGHTS).cast("double").alias("score"), deals.deal_score(title).alias("deal_score"),
        (F.col("final_reason") == "PASSES").alias("gate_ok"), (F.col("scrub_reason") == "PASSES").alias("scrub_ok"), F.array_compact(F.array(signatures.deal_signature(text, _GROUPS, _STATES))).alias("sigs"),
        signatures.entity_key(text, _FIRMS, _MARKETS).alias("entity"), F.floor(signatures.square_feet(text, False) / 10_000 + 0.5).cast("int").alias("sf"), F.floor(signatures.millions(text, False) / 5 + 0.5).cast("int").alias("price"),
        key.alias("title_key"), F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 3)).alias("words"), F.array(*editions.title_facts(title)).alias("name_facts"), F.contains("url", F.lit("regional")).alias("preferred"),
    ))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Editions, facts, reserve (the 25 best a section) and includes (the first article of a month, for its edition)."""
    rows = facts(spark, sf_dir)
    month = F.date_trunc("month", F.col("ts"))
    of_month = F.date_format(month, "yyyy-MM")
    every = rows.select(of_month.alias("edition"), (month + F.expr("INTERVAL 175 HOURS")).alias("as_of")).distinct()
    stock = selection.top_of_each(rows.where("passes AND gate_ok AND scrub_ok"), "section", [F.desc("score"), F.desc("ts"), F.col("ord")], 25, "rank")
    picked = rows.groupBy(of_month.alias("edition")).agg(F.min("id").alias("id")).join(rows, "id")
    return every, rows, stock, picked


def edition_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every edition holds, where, and by which step it came in. The steps depend on each other: tested against a plain cascade."""
    return cascade.assembled(*inputs(spark, sf_dir))


QUERIES["edition_cascade"] = edition_cascade


def edition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and letter of every assembled edition, from what it holds: coverage by its sections and their supply, freshness by
    the steps that its items came in by, the region of its items, and penalties for what the gates find in them.
    """
    every, rows, stock, picked = inputs(spark, sf_dir)
    held = written(cascade.assembled(every, rows, stock, picked))
    month = F.date_format(F.date_trunc("month", F.col("ts")), "yyyy-MM")
    sections_ = every.select("edition", F.explode(F.array(*map(F.lit, cascade.SECTIONS))).alias("section"))
    filled = held.groupBy("edition", "section").agg(F.count(F.lit(1)).alias("filled"))
    supply = rows.where("in_region").groupBy(month.alias("edition"), "section").agg(F.count(F.lit(1)).alias("supply"))
    covered = health.coverage(sections_.join(filled, ["edition", "section"], "left").join(supply, ["edition", "section"], "left").fillna(0), "edition", "section", "filled", "supply")
    tier = F.when(F.col("via") == "window", "tier2").when(F.col("via").isin("deep", "routed", "refill"), "tier3").when(F.col("via").isin("reserve", "thin"), "tier4").when(F.col("via") == "include", "tier5").otherwise("tier2")
    items = held.withColumn("tier", tier).join(rows.select("id", "in_region", "not_excluded", "gate_ok", "scrub_ok", "title_key", "sigs", "ts"), "id")
    fresh = health.tier_freshness(items, "edition", "tier").select("edition", "items", F.round("freshness", 6).alias("freshness"))
    points = F.when(F.col("in_region"), 1.0).when(F.col("not_excluded"), 0.4).otherwise(0.0)
    regional = items.groupBy("edition").agg(F.round(25 * F.avg(points), 6).alias("regional"))
    sent = items.select("edition", "id", F.explode("sigs").alias("sig"))
    before = sent.groupBy("sig").agg(F.min("edition").alias("first"))
    repeated = sent.join(before, "sig").where(F.col("first") < F.col("edition")).select("edition", "id").distinct().withColumn("again", F.lit(True))
    items = items.join(repeated, ["edition", "id"], "left")
    flags = {"broken": F.length("title_key") < 12, "dup_in_send": F.lit(False), "repeat_cross_day": F.coalesce("again", F.lit(False)), "weak": ~F.col("in_region") & ~F.col("gate_ok"), "leak": ~F.col("scrub_ok")}
    marks = reports.penalties(items, "edition", flags)
    out = covered.join(fresh, "edition").join(regional, "edition").join(marks, "edition")
    scored = out.withColumn("s", reports.content_score(F.col("coverage"), F.col("freshness"), F.col("regional"), F.col("points")))
    return scored.select("edition", "items", "coverage", "freshness", "regional", *flags, F.col("points").cast("long").alias("points"), "s.score", "s.grade")


def shown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edition of the shorter kind shows, with the best of its week."""
    every, rows, stock, picked = inputs(spark, sf_dir)
    held = written(cascade.assembled(every, rows, stock, picked))
    week = cascade.week_in_review(held, every, rows).select("edition", F.lit("week").alias("section"), "place", "id")
    return summaries.shown(held.select("edition", "section", "place", "id").unionByName(week), "work")


QUERIES |= {"edition_quality": edition_quality, "shown_items": shown_items}
