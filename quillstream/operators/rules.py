"""Ordered rules: every filter gives a verdict and its reason, so funnels and reports are plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import deals


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains one of the words."""
    return F.lower(text).rlike("|".join("\\Q" + w + "\\E" for w in words))


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), name)
    return out.otherwise(otherwise) if otherwise is not None else out


def transaction_verdict(text: Column) -> Column:
    """accepted, or why a text is no transaction: approvals pass at any size, deals from the threshold on."""
    return first_match(
        [("ACCEPTED_APPROVAL", contains_any(text, deals.APPROVAL_WORDS)), ("ACCEPTED_THRESHOLD", deals.meets_threshold(text))],
        "BELOW_DEAL_THRESHOLD",
    )


def funnel(df: DataFrame, section: str, reason: str) -> DataFrame:
    """Rows by section and reason."""
    return df.groupBy(section, reason).agg(F.count(F.lit(1)).alias("n"))
