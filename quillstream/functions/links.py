"""Links of articles: which to take, how to write them, which to refuse; images beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import words
from quillstream.functions.text import without_tracking
from quillstream.operators.rules import contains_any

_FORM = r"^(?i)([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    """Lower-cased host; empty where there is none."""
    return F.lower(F.regexp_extract(url, _FORM, 2))


def http_only(url: Column) -> Column:
    """The address, trimmed, where it is http or https with a host; else empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(F.lower(F.regexp_extract(u, _FORM, 1)).isin("http", "https"), u).otherwise("")


def host_path_query(url: Column) -> Column:
    """Host, path and query as the name of an address; the address itself where it has no host."""
    h = host(url)
    return F.when(h != "", F.concat(h, F.regexp_extract(url, _FORM, 3), F.regexp_extract(url, _FORM, 4))).otherwise(url)


def cleaned(url: Column) -> Column:
    """The address without tracking, but for hosts and paths of redirects and caches, which would break."""
    h, path = F.regexp_extract(url, _FORM, 2), F.regexp_extract(url, _FORM, 3)
    asis = F.lit(False)
    for w in words.LEFT_AS_IS:
        asis = asis | h.contains(w) | path.contains(w)
    return F.when((h == "") | asis, url).otherwise(without_tracking(url))


def first_link(original: Column, link: Column, alternate: Column, atom: Column, guid: Column) -> Column:
    """The link of an item: the feed's original link, its link, the alternate one, the Atom one, a guid that is an address."""
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", http_only(c))
    return F.coalesce(full(original), full(link), full(alternate), full(F.trim(atom)), F.when(guid.startswith("http"), http_only(guid)))


def first_image(enclosure: Column, enclosure_type: Column, media: Column, thumbnail: Column, html: Column) -> Column:
    """The image of an item: an enclosure that is one, media, thumbnail, the first in its HTML; else empty."""
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(F.when(enclosure_type.startswith("image/"), full(enclosure)), full(media), full(thumbnail), F.regexp_extract(F.coalesce(html, F.lit("")), r'<img[^>]+src="([^"]+)"', 1))


def plain_text(text: Column) -> Column:
    """Text with its five entities decoded and then without tags, trimmed."""
    out = F.coalesce(text, F.lit(""))
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, "<[^>]*>", ""))


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    out = h.isin(domains)
    for d in domains:
        out = out | h.endswith(f".{d}")
    return out


def is_refused(url: Column) -> Column:
    """Whether an address is one of tracking, redirects or caches."""
    return F.lower(url).rlike(words.REFUSED_LINK)


def lightly_filtered(source: Column, url: Column) -> Column:
    """Whether an article is of a source that is filtered lightly."""
    s, u = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return contains_any(s, words.LIGHTLY_FILTERED) | contains_any(u, [w.replace(" ", "") for w in words.LIGHTLY_FILTERED])


def link_verdict(title: Column, description: Column, source: Column, url: Column, domains: list[str]) -> Column:
    """Whether an article is taken in: light sources unless off topic, others from allowed hosts on topic."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.when(is_refused(url), False).when(lightly_filtered(source, url), ~text.rlike(words.OFF_TOPIC)).otherwise(allowed(url, domains) & text.rlike(words.ON_TOPIC))


def stated_size(text: Column) -> Column:
    """Square feet of the first size, by the simple rule: digits and commas before the unit."""
    return F.nullif(F.replace(F.regexp_extract(F.lower(text), r"(\d+(?:,\d+)*)\s*(?:sq|sf|sq\.ft|square feet|sqft)", 1), F.lit(","), F.lit("")), F.lit("")).cast("long")


def stated_price(text: Column) -> Column:
    """Dollars of the first amount in millions or billions, by the simple rule."""
    form = r"\$(\d+(?:,\d+)*)\s*(million|m|billion|b)"
    n = F.nullif(F.replace(F.regexp_extract(F.lower(text), form, 1), F.lit(","), F.lit("")), F.lit("")).cast("double")
    return n * F.when(F.regexp_extract(F.lower(text), form, 2).startswith("b"), 1e9).otherwise(1e6)
