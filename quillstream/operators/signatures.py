"""Signatures of deals: what two reports of one deal have in common. Places and firms are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.deals import event_class
from quillstream.operators.rounds import dropped_by_pairs

# Sizes and amounts in lower-cased text, in order of precedence.
THOUSANDS_SF = r"(\d+(?:\.\d+)?)\s*k\s*(?:sf|sq\.?\s*f)"
WRITTEN_SF = r"(\d{1,3}(?:,\d{3})+)[\s-]*(?:sf|sq\.?\s*f|square[\s-]*feet|square[\s-]*foot)"
MILLION_SF = r"(\d+(?:\.\d+)?)\s*(?:million|m)\s*(?:sf|sq\.?\s*f|square\s*feet)"
MILLIONS = r"\$\s*(\d+(?:\.\d+)?)\s*(?:m|million)\b"
BILLIONS = r"\$\s*(\d+(?:\.\d+)?)\s*(?:b|billion)\b"
WRITTEN_DOLLARS = r"\$\s*(\d{1,3}(?:,\d{3}){2,})"
# Descriptors of the flag for one event in two sources.
DESCRIPTORS = ["shallow bay", "cold storage", "outdoor storage", "data center", "truck terminal", "last mile"]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), F.lit("")).cast("double")


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def square_feet(text: Column, with_millions: bool = True) -> Column:
    """Size in square feet of a lower-cased text: said in thousands, written out, or in millions."""
    out = F.coalesce(_round(_found(text, THOUSANDS_SF) * 1000), _found(text, WRITTEN_SF).cast("long"))
    return F.coalesce(out, _round(_found(text, MILLION_SF) * 1_000_000)) if with_millions else out


def millions(text: Column, with_written: bool = True) -> Column:
    """Price in millions of dollars of a lower-cased text: billions first, then millions, then written out."""
    out = F.coalesce(_round(_found(text, BILLIONS) * 1000), _round(_found(text, MILLIONS)))
    return F.coalesce(out, _round(_found(text, WRITTEN_DOLLARS) / 1_000_000)) if with_written else out


def places_of(text: Column, groups: list[dict[str, str]]) -> Column:
    """Distinct markets of a text: in each group of place names the first that stands in it, by the market it belongs to."""
    found = []
    for names in groups:
        hit = F.regexp_extract(text, r"\b(" + "|".join(re.escape(n) for n in names) + r")\b", 1)
        market = hit
        for name, of in names.items():
            market = F.when(hit == name, of).otherwise(market)
        found.append(F.nullif(market, F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def deal_signature(text: Column, groups: list[dict[str, str]], states: dict[str, str]) -> Column:
    """Size in tens of thousands, millions of dollars and markets (else states, by pattern); null without a size or price,
    or without a place. ``text``: lower-cased.
    """
    sf, price = square_feet(text), millions(text)
    named = places_of(text, groups)
    of_states = F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in states.items()))))
    where = F.when(F.size(named) > 0, named).otherwise(of_states)
    out = F.concat(F.coalesce(_round(sf / 10_000), F.lit(0)).cast("string"), F.lit("sf_"), F.coalesce(price, F.lit(0)).cast("string"), F.lit("m_"), F.array_join(where, "|"))
    return F.when((F.size(where) > 0) & (sf.isNotNull() | price.isNotNull()), out)


def entity_key(text: Column, firms: list[str], markets: dict[str, str]) -> Column:
    """Firm, market and event of a lower-cased text; null without one of them. Longer names of markets go first."""
    firm = F.lit(None).cast("string")
    for name in reversed(firms):
        firm = F.when(text.rlike(rf"\b{re.escape(name)}\b"), name.replace(" ", "-")).otherwise(firm)
    market = F.lit(None).cast("string")
    for name in reversed(sorted(markets, key=lambda n: -len(n))):
        market = F.when(text.rlike(rf"\b{re.escape(name)}\b"), markets[name]).otherwise(market)
    return F.concat(F.lit("entdeal_"), firm, F.lit("_"), market, F.lit("_"), event_class(text))


def entity_survivors(df: DataFrame, id_col: str, order_col: str, text: Column, firms: list[str], markets: dict[str, str]) -> DataFrame:
    """Ids left when, in order, a row goes whose key a row kept before has with sizes and prices that don't differ.

    Rows of one key and the same rounded size and price are one class: the first of it stands for all, as whatever kept row
    is compatible with one is with the others. Only such first rows meet. Rows without a key stay.
    """
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(order_col).alias("ord"), F.col(id_col).alias("id")).alias("at"), text.alias("t"))
    rows = rows.select("id", "at", entity_key(F.col("t"), firms, markets).alias("key"), _round(square_feet(F.col("t"), False) / 10_000).alias("sf"), _round(millions(F.col("t"), False) / 5).alias("price"))
    alone = rows.where(F.col("key").isNull()).select("id")
    first = rows.where(F.col("key").isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("key", "sf", "price").orderBy("at"))).where("_k = 1").drop("_k")
    a, b = (first.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "at", "sf", "price"))) for s in "ab")
    agree = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(True))
    pairs = a.join(b, "key").where((F.col("at_a") < F.col("at_b")) & agree("sf") & agree("price"))
    gone = dropped_by_pairs(pairs.select(F.struct("at_a", "at_b").alias("place"), F.col("id_a").alias("x"), F.col("id_b").alias("y"), F.col("id_b").alias("loser")))
    left = first.select("id").join(gone.withColumnRenamed("gone", "id"), "id", "left_anti")
    return left.unionByName(alone).withColumnRenamed("id", id_col)


def same_event_flags(df: DataFrame, id_col: str, title: str) -> DataFrame:
    """(id, town, descriptor, event, others): rows that share all three with others; for review only, nothing goes."""
    lower = F.lower(F.coalesce(F.col(title), F.lit("")))
    bare = F.replace(F.regexp_replace(lower, r"\s+[-–—|]\s+.*$", ""), F.lit("-"), F.lit(" "))
    town = F.nullif(F.trim(F.regexp_extract(bare, r"\bin ([a-z][a-z .']*?)(?:\s{2,}|,| for | to |$)", 1)), F.lit(""))
    descriptor = F.lit(None).cast("string")
    for d in reversed(DESCRIPTORS):
        descriptor = F.when(F.replace(lower, F.lit("-"), F.lit(" ")).contains(d), d).otherwise(descriptor)
    rows = df.select(F.col(id_col), town.alias("town"), descriptor.alias("descriptor"), event_class(F.col(title)).alias("event")).dropna(subset=["town", "descriptor", "event"])
    counts = rows.groupBy("town", "descriptor", "event").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return rows.join(counts, ["town", "descriptor", "event"]).select(id_col, "town", "descriptor", "event", "others")
