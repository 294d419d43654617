"""Feed health and edition quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the sections' fill, of the tiers' freshness, and points of penalties.
COVERAGE_WEIGHTS = {"transactions": 10, "relevant": 8, "availabilities": 6, "people": 6}
TIER_WEIGHTS = {"tier1": 1.0, "tier2": 0.85, "tier3": 0.5, "tier4": 0.3, "tier5": 0.7}
PENALTY_POINTS = {"broken": 8, "dup_in_send": 6, "repeat_cross_day": 3, "weak": 3, "leak": 12}


def success_of_last(df: DataFrame, feed: str, order: list, ok, n: int = 20) -> DataFrame:
    """Per feed: outcomes, successes and rounded percentage over its last ``n`` outcomes."""
    place = F.row_number().over(Window.partitionBy(feed).orderBy(*order))
    last = df.withColumn("_place", place).where(F.col("_place") <= n)
    out = last.groupBy(feed).agg(F.count(F.lit(1)).alias("outcomes"), F.sum(ok.cast("long")).alias("ok_count"))
    return out.withColumn("success_pct", F.round(F.col("ok_count") / F.col("outcomes") * 100).cast("long"))


def grade(score):
    """Letter of a score."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def tier_freshness(df: DataFrame, by: str, tier: str) -> DataFrame:
    """Freshness (25 at most) of each edition: the mean weight of its items' tiers.

    Weights are summed in whole hundredths, so the order of the rows can't move a mean across the bound of a grade;
    ``freshness_6`` is the mean rounded to six places by whole numbers, half up.
    """
    weight = F.lit(None).cast("long")
    for name, w in TIER_WEIGHTS.items():
        weight = F.when(F.col(tier) == name, F.lit(round(100 * w)).cast("long")).otherwise(weight)
    sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.count(weight).alias("_n"), F.sum(weight).alias("_sum"))
    rounded = F.when(F.col("_n") > 0, F.expr("(2000000 * _sum + 4 * _n) div (8 * _n)") / F.lit(1e6))
    return sums.select(by, "items", F.when(F.col("_n") > 0, F.col("_sum") / (4 * F.col("_n"))).alias("freshness"), rounded.alias("freshness_6"))


def coverage(df: DataFrame, by: str, section: str, filled: str, supply: str) -> DataFrame:
    """Coverage (30 at most): a filled section's weight, half of it for an empty one without supply."""
    weight = F.lit(0)
    for name, w in COVERAGE_WEIGHTS.items():
        weight = F.when(F.col(section) == name, w).otherwise(weight)
    share = F.when(F.col(filled) > 0, 1.0).when(F.col(supply) > 0, 0.0).otherwise(0.5)
    return df.groupBy(by).agg(F.sum(weight * share).alias("coverage"))


def breaker_states(df: DataFrame, feed: str, order: list, failed, block_after: int = 3) -> DataFrame:
    """Per outcome: failures in a row up to it, and whether the feed is then blocked."""
    w = Window.partitionBy(feed).orderBy(*order)
    runs = df.withColumn("_run", F.sum((~failed).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("failures", F.sum(failed.cast("long")).over(Window.partitionBy(feed, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("blocked", F.col("failures") >= block_after).drop("_run")
