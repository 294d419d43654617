"""Text, title and address functions: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
# Replacements for text in HTML.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;"), ("/", "&#x2F;")]


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds count ASCII letters, digits and the underscore only; Java's count all letters."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def given(*cols: Column) -> Column:
    """The first of several strings that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(title: Column) -> Column:
    """Key for stories repeated across days: no trailing publisher segment, lower case, letters and digits only."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[-–—|]\s+[^-–—|]*$", "")
    return squeezed(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]", " "))


def scorer_title(title: Column) -> Column:
    """Title as the quality scorer compares it; a bar doesn't end it."""
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+[-–—]\s+[^-–—]*$", "")
    return squeezed(F.regexp_replace(bare, "[^a-z0-9 ]", " "))


def long_words(key: Column) -> Column:
    """Distinct words of more than three characters."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def without_tracking(url: Column) -> Column:
    """Address without fragment and tracking parameters."""
    names = "|".join(TRACKING_PARAMS)
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, rf"([?&])(?:(?:{names})=[^&]*(?:&|$))+", "$1")
    return F.regexp_replace(bare, "[?&]$", "")


def without_marketing(url: Column) -> Column:
    """Address without fragment and the parameters of campaigns: utm_ and mc_ ones of any name, fbclid and gclid."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])(?:(?:utm_[^=&]*|mc_[^=&]*|fbclid|gclid)(?:=[^&]*)?(?:&|$))+", "$1")
    return F.regexp_replace(bare, "[?&]$", "")


def url_key(url: Column) -> Column:
    """Address for comparing: without tracking, lower case; empty for none."""
    return F.lower(without_tracking(F.coalesce(url, F.lit(""))))


def host(url: Column) -> Column:
    """Host in lower case, without user and leading www."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def article_id(guid: Column, url: Column) -> Column:
    """SHA-1 of the guid, or of the address where there is none."""
    return F.sha1(F.coalesce(F.nullif(guid, F.lit("")), url))


def plain_text(html: Column) -> Column:
    """HTML without tags."""
    return squeezed(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))


def meta_content(html: Column, name: str) -> Column:
    """Content of the meta element of that property or name, whichever attribute comes first."""
    quoted = name.replace(":", "[:]")
    ahead = F.regexp_extract(html, rf"(?i)<meta[^>]+(?:property|name)=[\"']{quoted}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    behind = F.regexp_extract(html, rf"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+(?:property|name)=[\"']{quoted}[\"']", 1)
    return given(ahead, behind)


def escaped_html(c: Column) -> Column:
    """Text with the characters that HTML gives a meaning replaced; empty for null."""
    out = F.coalesce(c, F.lit(""))
    for char, entity in HTML_ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def safe_url(c: Column) -> Column:
    """The trimmed address if it is http or https, else #."""
    return F.when(F.trim(c).rlike(r"(?i)^https?://[^/\s]"), F.trim(c)).otherwise(F.lit("#"))


def placeholder_seed(url: Column) -> Column:
    """Seed of a placeholder image: base 36 of the size of the 31-fold hash in 32-bit two's complement."""
    codes = F.transform(F.split(url, ""), lambda ch: F.ascii(ch).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, ch: F.pmod(h * 31 + ch, F.lit(2**32)))
    signed = F.when(folded >= 2**31, folded - 2**32).otherwise(folded)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))


def access_status(status: Column, content_type: Column, body: Column) -> Column:
    """unknown, blocked, paywalled or ok, from a response."""
    return (
        F.when(F.coalesce(status, F.lit(0)) == 0, "unknown")
        .when(status.isin(401, 402, 403, 404), "blocked")
        .when((F.coalesce(content_type, F.lit("")) != "") & ~content_type.contains("text/html"), "unknown")
        .when(F.lower(F.coalesce(body, F.lit(""))).rlike("subscribe|paywall"), "paywalled")
        .otherwise("ok")
    )


def embedded_json(c: Column) -> Column:
    """The outermost braces of a text, as models wrap their answers in prose."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
