"""Ranking, caps and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_of_each(df: DataFrame, by: str, order: list[Column], most: int | Column, place: str = "place") -> DataFrame:
    """The first ``most`` rows of each group, with their place. Spark cuts each task's groups before the shuffle."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(place) <= most)


def publish_states(df: DataFrame, section: str, order: list[Column], caps: dict[str, int], other: int) -> DataFrame:
    """WOULD_PUBLISH for the rows within their section's cap, CAP_OVERFLOW beyond it."""
    cap = F.lit(other)
    for name, n in caps.items():
        cap = F.when(F.col(section) == name, n).otherwise(cap)
    place = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    return df.withColumn("state", F.when(place <= cap, "WOULD_PUBLISH").otherwise("CAP_OVERFLOW"))


def within(ts: Column, as_of: Column, hours: int) -> Column:
    """Whether a time lies in the hours up to ``as_of``."""
    return (ts <= as_of) & (ts >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def last_n(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The last rows of each group; ``order`` is newest first."""
    return top_of_each(df, by, order, n)
