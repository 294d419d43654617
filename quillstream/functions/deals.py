"""Sizes, prices and events of property deals, read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns over upper-cased text.
AREA = r"(\d{1,3}(?:,\d{3})*|\d+(?:\.\d+)?)\s*(K|M)?[\s-]*(?:SF|SQ\.?\s*FT|SQUARE[\s-]*(?:FEET|FOOT))"
MILLIONS = r"\$(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:MILLION|M\b)"
MILLIONS_OR_BILLIONS = r"\$(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:MILLION|M\b|BILLION|B\b)"
SPELT_OUT = r"\$(\d{2,3}(?:,\d{3}){2,})"
# Events in order of precedence, over lower-cased text; the first excludes the words of the second list.
PEOPLE = r"\b(hir(?:e|es|ed|ing)|names?\b|named\b|appoint|promot|joins?\b|joined\b|tapped\b|elevat)"
NOT_PEOPLE = r"\b(acqui|buys?\b|bought\b|sells?\b|sold\b|sale\b|leas)"
EVENTS = [
    ("acquire", r"\b(acqui|buys?\b|bought\b|purchas|sale\b|sold\b|sells?\b|snaps?\s+up|grabs?\b|grabbed\b|nabs?\b|scoops?\s+up|trades?\b|changes hands|picks?\s+up)"),
    ("finance", r"\b(refinanc|financ|loan\b|mortgage\b|recap)"),
    ("lease", r"\b(leas(?:e|es|ed|ing)|tenant\b|sublease|renew|occup|signs? a lease|takes?\s+\d)"),
    ("develop-deliver", r"\b(delivers?\b|deliver(?:y|ed)\b|completes?\b|opens?\b|tops? out|topped out|ribbon)"),
    ("develop-start", r"\b(breaks? ground|groundbreak|propos|plans?\b|approv|rezon|zoning\b|entitl|to build)"),
]
# Words that approve a project whatever its size.
APPROVAL_WORDS = ["approved", "approves", "approval", "zoning", "rezoning", "entitlement", "permits", "planning board", "commission"]


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _number(c: Column) -> Column:
    return F.nullif(F.replace(c, F.lit(","), F.lit("")), F.lit("")).cast("double")


def _found(text: Column, *patterns: str) -> Column:
    """Struct m0, m1, ...: what each pattern finds in the upper-cased text. Numbers are read from these short pieces, so
    that each pattern goes over the text once.
    """
    return _bound(F.upper(text), lambda u: F.struct(*(F.regexp_extract(u, p, 0).alias(f"m{k}") for k, p in enumerate(patterns)), u.rlike("BILLION|B ").alias("billions")))


def _area(found: Column) -> Column:
    """Square feet of a size that was found, not rounded; null for none."""
    unit = F.regexp_extract(found, AREA, 2)
    return _number(F.regexp_extract(found, AREA, 1)) * F.when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)


def _rounded(area: Column) -> Column:
    return F.round(area).cast("long")


def _millions(found: Column, spelt: Column) -> Column:
    said, written = _number(F.regexp_extract(found, MILLIONS, 1)), _number(F.regexp_extract(spelt, SPELT_OUT, 1))
    return F.when(said.isNotNull() & (said != 0), said).when(written >= 1e7, written / 1e6).otherwise(said)


def size_sf(text: Column) -> Column:
    """Square feet of the first size in a text."""
    return _rounded(_area(F.regexp_extract(F.upper(text), AREA, 0)))


def price_millions(text: Column) -> Column:
    """Millions of dollars: the first amount said in millions, or else one written out of 10 million or more."""
    return _bound(_found(text, MILLIONS, SPELT_OUT), lambda f: _millions(f["m0"], f["m1"]))


def threshold(text: Column) -> Column:
    """Struct of meets_sf (50,000 or more), meets_dollar (10 million or more), size_sf and price_million."""
    read = _bound(_found(text, AREA, MILLIONS, SPELT_OUT), lambda f: F.struct(_rounded(_area(f["m0"])).alias("sf"), _millions(f["m1"], f["m2"]).alias("price")))
    return _bound(read, lambda r: F.struct(F.coalesce(r["sf"] >= 50_000, F.lit(False)).alias("meets_sf"), F.coalesce(r["price"] >= 10, F.lit(False)).alias("meets_dollar"), r["sf"].alias("size_sf"), r["price"].alias("price_million")))


def meets_threshold(text: Column) -> Column:
    """Whether size or price meets the threshold."""
    return _bound(threshold(text), lambda t: t["meets_sf"] | t["meets_dollar"])


def deal_score(text: Column) -> Column:
    """0 to 6: up to three points for size and for price. Any "B " counts as billions once an amount is there."""

    def points(r: Column) -> Column:
        by_size = F.when(r["sf"] >= 100_000, 3).when(r["sf"] >= 50_000, 2).when(r["sf"] >= 25_000, 1).otherwise(0)
        return by_size + F.when(r["amount"].isNotNull() & r["billions"], 3).when(r["amount"] >= 25, 2).when(r["amount"] >= 10, 1).otherwise(0)

    read = _bound(_found(text, AREA, MILLIONS_OR_BILLIONS), lambda f: F.struct(_area(f["m0"]).alias("sf"), _number(F.regexp_extract(f["m1"], MILLIONS_OR_BILLIONS, 1)).alias("amount"), f["billions"].alias("billions")))
    return _bound(read, points)


def event_class(text: Column) -> Column:
    """The event that a text tells of; null for none."""
    lower = F.lower(text)
    out = F.when(lower.rlike(PEOPLE) & ~lower.rlike(NOT_PEOPLE), F.lit("people"))
    for name, pattern in EVENTS:
        out = out.when(lower.rlike(pattern), F.lit(name))
    return out


def _largest(lower: Column, pattern: str, scale: float) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(lower, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double") * scale))


def largest_billions(text: Column) -> Column:
    """Largest amount in billions of dollars over all amounts in a text."""
    lower, number = F.lower(text), r"(\d[\d,]*(?:\.\d+)?)"
    return F.greatest(_largest(lower, rf"\$\s*{number}\s*(?:b|bn|billion)\b", 1.0), _largest(lower, rf"\$\s*{number}\s*(?:m|mm|million)\b", 0.001))


def largest_megawatts(text: Column) -> Column:
    """Largest power in megawatts over all in a text."""
    lower, number = F.lower(text), r"(\d[\d,]*(?:\.\d+)?)"
    return F.greatest(_largest(lower, rf"{number}\s*-?\s*(?:gw|gigawatts?)\b", 1000.0), _largest(lower, rf"{number}\s*-?\s*(?:mw|megawatts?)\b", 1.0))
