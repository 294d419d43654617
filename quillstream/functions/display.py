"""Titles, dates, regions, keywords and excerpts as feeds and editions show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.deals import _bound
from quillstream.functions.text import ascii_bounds, given, squeezed

# Publishers whose names end titles.
PUBLISHERS = [
    "costar", "globest", "msn", "yahoo", "bisnow", "commercialsearch", "rebusinessonline", "connect cre", "the business journals", "commercial observer", "ad hoc news", "law360",
    r"investing\.com", "finimize", "nareit", "loopnet", "tapinto", "freightwaves", "wplg", "cbs news", "news channel", "production engineering", "thestar", "daily record", "njbiz", "roi-nj",
    "re-nj", "commercial property executive", "cpexecutive", r"lvb\.com", "aol", "miami herald", "yahoo finance", "tradingview", "techbullion", "pelican post", "pennlive", "yourvalley",
    "capitol press", "savannah now", "wlaf", "moit",
]
# Sources behind a paywall.
PAYWALLED = ["wsj", "wall street journal", "bloomberg", "costar", "bisnow", "globest", "commercial observer", "therealdeal", "the real deal", "bizjournals", "business journal", "njbiz", "lvb"]
# Keywords of the raw feed, in order.
KEYWORDS = [
    "warehouse", "logistics", "distribution", "manufacturing", "cold storage", "industrial", "fulfillment", "supply chain", "freight", "e-commerce", "last mile", "flex space", "3pl", "lease",
    "acquisition", "development", "vacancy", "absorption", "cap rate",
]
# Regions in order of precedence, over upper-cased text.
REGIONS = [
    ("NJ", r"\bNEW JERSEY\b|, NJ\b|\bNJ,|\bNEWARK\b|\bJERSEY CITY\b"),
    ("PA", r"\bPENNSYLVANIA\b|\bPHILADELPHIA\b|, PA\b|\bLEHIGH\b"),
    ("FL", r"\bFLORIDA\b|\bMIAMI\b|\bTAMPA\b|, FL\b|\bJACKSONVILLE\b"),
]
# Names and places that readers can follow.
NAMES = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
FOLLOWED_PLACES = r"(?i)(New\s+Jersey|New\s+York|South\s+Florida|Pennsylvania|Miami-Dade|Broward|Philadelphia|Newark|Fort\s+Lauderdale|Miami)"
# What an edition shows of a deal.
CITY_STATE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*(NJ|PA|FL|N\.J\.|New Jersey|Pennsylvania|Florida|South Florida)\b"
SHOWN_AREA = r"(?i)(\d{1,3}(?:,\d{3})*)\s*(?:SF|sq\.?\s*ft\.?|square\s*feet)"
SHOWN_PRICE = r"(?i)\$(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(million|M\b|billion|B\b)"
BIG_AREA = r"(\d{1,3}(?:,\d{3})*)\s*(?:SF|SQ\.?\s*FT|SQUARE\s*FEET)"
BIG_BILLIONS = r"\$(\d{1,3}(?:\.\d+)?)\s*(?:BILLION|B\b)"
# Date forms of feeds, the weekday taken off.
DATE_FORMS = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z", "d MMM yyyy"]


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, ascii_bounds(pattern), k), F.lit(""))


def _plain_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def normal_title(title: Column) -> Column:
    """Title for exact dedup: lower case, no known publisher at the end, no "News |" before, words only."""
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s*[-–—|]\s*(" + "|".join(PUBLISHERS) + ").*$", "")
    return squeezed(F.regexp_replace(F.regexp_replace(bare, r"^news\s*\|\s*", ""), r"[^A-Za-z0-9_\s]", ""))


def parsed_date(c: Column) -> Column:
    """Time of one feed date, RFC 822 or ISO 8601; null for other forms and years outside 2000 to 2100."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    ts = F.coalesce(*(F.try_to_timestamp(bare, F.lit(form)) for form in DATE_FORMS), F.try_to_timestamp(bare))
    return F.when(F.year(ts).between(2000, 2100), ts)


def first_date(otherwise: Column, *cols: Column) -> Column:
    """The first date that parses, else ``otherwise`` (as a rule the time of the run)."""
    return F.coalesce(*map(parsed_date, cols), otherwise)


def valid_date(as_of: Column, *cols: Column) -> Column:
    """Time of the first value given; null if it doesn't parse, lies after ``as_of`` or before 2020."""
    ts = parsed_date(given(*cols))
    return F.when((ts <= as_of) & (ts >= F.lit("2020-01-01").cast("timestamp")), ts)


def paywalled(source: Column, url: Column) -> Column:
    """Whether source or address names a paper behind a paywall."""
    both = F.lower(F.concat_ws(" ", source, url))
    hit = F.lit(False)
    for name in PAYWALLED:
        hit = hit | F.contains(both, F.lit(name))
    return hit


def region(text: Column, known: Column | None = None) -> Column:
    """The region known, else the first that the text names, else US."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    found = F.lit("US")
    for name, pattern in reversed(REGIONS):
        found = F.when(upper.rlike(ascii_bounds(pattern)), name).otherwise(found)
    return found if known is None else F.coalesce(F.nullif(known, F.lit("")), found)


def keywords(text: Column, most: int = 5) -> Column:
    """The first ``most`` of the fixed keywords that a text contains, in their own order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.slice(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(lower, k)), 1, most)


def followable(title: Column) -> Column:
    """Up to three names and two places of a title; of those alike but for case the first, 3 to 49 characters long."""
    title = F.coalesce(title, F.lit(""))
    found = F.concat(F.slice(F.regexp_extract_all(title, F.lit(NAMES), 0), 1, 3), F.slice(F.regexp_extract_all(title, F.lit(FOLLOWED_PLACES), 0), 1, 2))
    fits = F.filter(F.transform(found, lambda x: F.trim(x)), lambda k: F.length(k).between(3, 49))
    return F.filter(fits, lambda k, at: F.array_position(F.transform(fits, F.lower), F.lower(k)) == at + 1)


def deal_line(title: Column, description: Column) -> Column:
    """Place, size and price of a deal, parted by dots; empty where none is said."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    sf = _plain_number(_group(text, SHOWN_AREA, 1)).cast("bigint")
    size = F.when(sf >= 1000, F.concat(F.floor(sf / 1000 + 0.5).cast("string"), F.lit("K SF"))).otherwise(F.concat(sf.cast("string"), F.lit(" SF")))
    price = F.concat(F.lit("$"), _plain_number(_group(text, SHOWN_PRICE, 1)), F.upper(F.substring(_group(text, SHOWN_PRICE, 2), 1, 1)))
    return F.concat_ws(" · ", _group(text, CITY_STATE, 0), size, price)


def big_deal(text: Column) -> Column:
    """Badge of a deal of 100,000 square feet, 25 million dollars or any billions; else null."""
    upper = F.upper(text)
    sf = _plain_number(_group(upper, BIG_AREA, 1)).cast("bigint")
    said = _plain_number(_group(upper, r"\$(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:MILLION|M\b)", 1))
    shortest = F.regexp_replace(F.regexp_replace(said, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(sf >= 100_000, F.concat(F.floor(sf / 1000 + 0.5).cast("string"), F.lit("K SF")))
        .when(said.cast("double") >= 25, F.concat(F.lit("$"), shortest, F.lit("M")))
        .otherwise(F.concat(F.lit("$"), _group(upper, BIG_BILLIONS, 1), F.lit("B")))
    )


def excerpt(description: Column, sentences: int = 2, most: int = 300) -> Column:
    """The first sentences of a description, decimal points ending none; longer ones are cut at a blank."""
    raw = F.trim(F.coalesce(description, F.lit("")))
    safe = F.regexp_replace(raw, r"(\d)\.(\d)", "$1\u0001$2")
    # possessive and anchored, so that a text without an end of a sentence is read once
    cut = F.regexp_extract(safe, rf"^[.!?]*+((?:[^.!?]++[.!?]++){{1,{sentences}}})", 1)
    text = _bound(cut, lambda c: F.when(c != "", F.trim(F.replace(c, F.lit("\u0001"), F.lit(".")))).otherwise(raw))
    short = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"\s+\S*$", ""), F.lit("..."))
    return _bound(text, lambda t: F.when(F.length(raw) <= 10, F.lit("")).when(F.length(t) > most, short(t)).otherwise(t))


def adds_to_title(title: Column, text: Column) -> Column:
    """Whether a description of over 20 characters shares less than three fifths of its words with the title."""
    known, words = F.split(F.lower(title), r"\s+"), F.split(F.lower(text), r"\s+")
    return (F.length(text) > 20) & (F.size(F.filter(words, lambda w: F.array_contains(known, w))) / F.size(words) < 0.6)


def fabricated(text: Column, title: Column, known: Column, never: tuple[str, ...] = ()) -> Column:
    """Whether a written text says a price, size or percentage that its sources don't, or a word of ``never``."""
    source, lower = F.lower(F.concat_ws(" ", title, known)), F.lower(F.coalesce(text, F.lit("")))
    unsaid = lambda where, number: (number != "") & ~F.contains(where, number)
    all_of = lambda pattern: F.regexp_extract_all(lower, F.lit(pattern), 0)
    price = F.exists(all_of(r"\$[\d,.]+\s*(?:million|billion|m|b|k)"), lambda x: unsaid(source, F.regexp_extract(F.regexp_replace(x, r"[$,\s]", ""), r"[\d.]+", 0)))
    plain = _plain_number(source)
    size = F.exists(all_of(r"[\d,.]+ ?(sf|square feet|sq\.?\s*ft)"), lambda x: unsaid(plain, _plain_number(F.regexp_extract(x, r"[\d,.]+", 0))))
    share = F.exists(all_of(r"[\d.]+\s*%"), lambda x: ~F.contains(source, F.regexp_replace(x, r"\s*%", "")))
    out = price | size | share
    for word in never:
        out = out | F.contains(lower, F.lit(word))
    return out


def needs_description(title: Column, description: Column, source: Column, url: Column) -> Column:
    """Whether a description has to be written: it only repeats the title, or is short and no paywall hides the text."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^A-Za-z0-9_\s]", ""))
    repeats = F.startswith(bare(description), bare(title)) & (F.length(bare(description)) < F.length(bare(title)) + 40)
    return F.when(F.length(F.trim(F.coalesce(description, F.lit("")))) >= 20, repeats).otherwise(~paywalled(source, url))


def clamped(value: Column, low: int, high: int, default: int, low_is_default: bool = False) -> Column:
    """Leading integer of a parameter within bounds; ``default`` where there is none, or below ``low`` if so told."""
    n = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint")
    return F.when(n.isNull() | (F.lit(low_is_default) & (n < low)), F.lit(default).cast("bigint")).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n)))


def shown_category(first_tag: Column) -> Column:
    """Category that a reader's page shows for a first tag."""
    tag = F.lower(F.coalesce(first_tag, F.lit("")))
    return F.when(F.contains(tag, F.lit("transaction")), "transaction").when(F.contains(tag, F.lit("availab")), "availabilities").when(F.contains(tag, F.lit("people")), "people").otherwise("relevant")
