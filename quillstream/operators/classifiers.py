"""Classifiers as ordered rules with reason codes: the rule engine, the gate of a build, and categories given anew.

Each is a list of rules over signals of a text (:mod:`quillstream.functions.signals`); the first rule that holds names the
reason, and category, score and tier follow from it. A whole set of rules costs one pass of the automaton over a text and
each pattern once. Titles, descriptions, links and sources may be null; they then hold nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import gates, words
from quillstream.functions.signals import Signals, decided
from quillstream.operators.rules import first_match


def _given(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *map(_given, columns))


def _of_reason(reason: Column, values: dict) -> Column:
    """The value that goes with a reason; null where there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() if pair[1] is not None for x in pair)), reason)


# --- predicates of signals -------------------------------------------------------------------------------------------


def has_price(text: Signals) -> Column:
    """An amount of money, or a number in thousands or more."""
    return text.matches(words.ENGINE_PRICES[0]) | text.matches(words.ENGINE_PRICES[1])


def has_size(text: Signals) -> Column:
    """Square feet or acres."""
    return text.matches(words.ENGINE_SIZES[0]) | text.matches(words.ENGINE_SIZES[1])


def keyword_score(text: Signals, terms: list[str], weight: float, most: float = 10.0) -> Column:
    """``weight`` for each of the terms that the text holds, ``most`` at most."""
    return F.least(text.count(terms) * F.lit(weight), F.lit(most))


# --- the rule engine -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Engine:
    """Words and weights of the rule engine."""

    sources: list[str] = field(default_factory=lambda: words.ENGINE_SOURCES)
    overrides: list[str] = field(default_factory=lambda: words.ENGINE_OVERRIDES)
    industrial: list[str] = field(default_factory=lambda: words.ENGINE_INDUSTRIAL)
    intent: list[str] = field(default_factory=lambda: words.ENGINE_INTENT)
    excluded: list[str] = field(default_factory=lambda: words.ENGINE_EXCLUDED)
    places: list[str] = field(default_factory=lambda: words.MARKET_PLACES)
    other_places: list[str] = field(default_factory=lambda: words.OTHER_MARKETS)
    industrial_weight: float = 1.2
    intent_weight: float = 1.1
    threshold: float = 2.0


#: Category, score (None: from the keywords) and tier by reason.
ENGINE_RESULTS = {
    "SOURCE_OVERRIDE": ("github", 10.0, "A"), "UNAPPROVED_SOURCE": ("unapproved source", 0.0, None), "EXCLUDED_KEYWORD": ("excluded", 0.0, None), "OUT_OF_MARKET": ("out of market", 0.0, None),
    "PEOPLE_OF_FIRM": ("people", 8.0, "A"), "DEAL_WITH_SIZE": ("transactions", 9.0, "A"), "SIZE_IN_CONTEXT": ("transactions", 7.0, "B"), "DEAL_WITH_PRICE": ("transactions", 8.0, "A"),
    "AVAILABLE_INDUSTRIAL": ("availabilities", 7.0, "B"), "MARKET_NEWS": ("relevant", None, "A"), "PEOPLE_IN_CONTEXT": ("people", 6.0, "B"), "NOT_RELEVANT": ("not relevant", 0.0, "C"),
}


def engine_reason(text: Signals, origin: Signals, engine: Engine) -> Column:
    """Which rule of the engine decides. ``text``: title, description and link; ``origin``: source and link; in lower case."""
    industrial, intent = text.any(engine.industrial), text.any(engine.intent)
    available, people, deal = text.any(words.ENGINE_AVAILABLE), text.any(words.ENGINE_PEOPLE), text.any(words.ENGINE_DEALS)
    price, size = text.once("price", has_price), text.once("size", has_size)
    open_ = ~text.any(words.ENGINE_OTHER_TRADE) & ~available
    return first_match(
        [
            ("SOURCE_OVERRIDE", origin.any(engine.overrides)), ("UNAPPROVED_SOURCE", ~origin.any(engine.sources)), ("EXCLUDED_KEYWORD", text.any(engine.excluded)),
            ("OUT_OF_MARKET", text.any(engine.other_places) & ~text.any(engine.places)),
            ("PEOPLE_OF_FIRM", (text.any(words.ENGINE_BROKERS) | (text.any(words.ENGINE_INVESTORS) & ~available)) & people),
            ("DEAL_WITH_SIZE", open_ & size & deal), ("SIZE_IN_CONTEXT", open_ & size & (industrial | intent)), ("DEAL_WITH_PRICE", open_ & deal & industrial & price),
            ("AVAILABLE_INDUSTRIAL", available & industrial), ("MARKET_NEWS", industrial & intent), ("PEOPLE_IN_CONTEXT", people & (industrial | intent)),
        ], "NOT_RELEVANT",
    )


def engine_classified(articles: DataFrame, engine: Engine | None = None) -> DataFrame:
    """Articles (title, description, link, source) with reason, category, score, tier and is_relevant of the rule engine."""
    e = engine or Engine()

    def rules(text: Signals, origin: Signals) -> dict[str, Column]:
        reason = text.once("reason", lambda s: engine_reason(s, origin, e))
        news = (keyword_score(text, e.industrial, e.industrial_weight) + keyword_score(text, e.intent, e.intent_weight)) / 2
        score = F.when(reason == "MARKET_NEWS", news).otherwise(_of_reason(reason, {k: v[1] for k, v in ENGINE_RESULTS.items()}))
        return {
            "reason": reason, "category": _of_reason(reason, {k: v[0] for k, v in ENGINE_RESULTS.items()}), "score": score,
            "tier": _of_reason(reason, {k: v[2] for k, v in ENGINE_RESULTS.items()}), "is_relevant": score > e.threshold,
        }

    return decided(articles, {"text": F.lower(_text("title", "description", "link")), "origin": F.lower(_text("source", "link"))}, rules)


# --- the gate of a build ---------------------------------------------------------------------------------------------

#: Reasons with which an article is taken into a build.
BUILD_INCLUDED = ["REGIONAL_IN_CONTEXT", "PREFERRED_IN_CONTEXT", "REGIONAL_SOURCE", "INDUSTRIAL_CONTEXT", "STRONG_SIGNAL"]


def build_reason(upper: Signals, lower: Signals, title: Signals, url: Signals, source: Signals, foreign: list[str]) -> Column:
    """Why a build takes an article (one of BUILD_INCLUDED) or leaves it out. ``foreign``: terms in upper case that exclude."""
    context = upper.any([k.upper() for k in words.BUILD_INDUSTRIAL])
    close = url.any(words.BUILD_REGIONAL_CLOSE) | source.any([s.replace(".com", "") for s in words.BUILD_REGIONAL_CLOSE])
    preferred = url.any(words.BUILD_PREFERRED) | source.any(words.BUILD_PREFERRED)
    return first_match(
        [
            ("POLITICAL_OR_FOREIGN", upper.any([*(w.upper() for w in words.POLITICAL), *foreign])), ("VIDEO", url.matches(words.BUILD_VIDEO)),
            ("CATALOGUE_WITHOUT_TARGET", (title.matches(words.BUILD_CATALOGUE) | url.matches(words.BUILD_LOW_SIGNAL)) & ~upper.matches(words.BUILD_TARGET)),
            ("NOT_INDUSTRIAL", ~gates.is_industrial(lower)), ("PEOPLE_WITHOUT_CONTEXT", upper.matches(words.BUILD_PEOPLE) & ~context),
            ("REGIONAL_IN_CONTEXT", close & (context | upper.matches(words.BUILD_REGIONAL_CONTEXT))), ("REGIONAL_WITHOUT_CONTEXT", close),
            ("PREFERRED_IN_CONTEXT", preferred & (context | upper.matches(words.BUILD_PREFERRED_CONTEXT))), ("PREFERRED_WITHOUT_CONTEXT", preferred),
            ("REGIONAL_SOURCE", url.any(words.BUILD_REGIONAL)), ("INDUSTRIAL_CONTEXT", context), ("STRONG_SIGNAL", upper.matches(words.BUILD_STRONG)),
        ], "NO_CONTEXT",
    )


def build_gated(articles: DataFrame, foreign: list[str] | None = None) -> DataFrame:
    """Articles (title, description, link, source) with build_reason and included."""

    def rules(upper: Signals, lower: Signals, title: Signals, url: Signals, source: Signals) -> dict[str, Column]:
        reason = lower.once("build", lambda s: build_reason(upper, s, title, url, source, foreign or []))
        return {"build_reason": reason, "included": reason.isin(BUILD_INCLUDED)}

    text = _text("title", "description")
    return decided(articles, {"upper": F.upper(text), "title": F.lower(_given("title")), "url": F.lower(_given("link")), "source": F.lower(_given("source")), "lower": F.lower(text)}, rules)


# --- categories given anew -------------------------------------------------------------------------------------------

CATEGORY_OF = {
    "SCRAPE_ARTIFACT_INDEX_PAGE": "exclude", "LOW_VALUE_ROUNDUP": "exclude", "SCRAPE_ARTIFACT_CATEGORY_STUB": "exclude", "REJECT_WRONG_PROPERTY_TYPE": "exclude",
    "AVAIL_LOOPNET_LISTING": "availabilities", "AVAIL_TITLE_LEASE_SALE": "availabilities", "AVAIL_BODY_LEASE_SALE": "availabilities", "AVAIL_NEW_SUPPLY": "availabilities",
    "PEOPLE_TITLE_SIGNAL": "people", "PEOPLE_PROFILE_FORMAT": "people", "AVAIL_LISTING_EVENT": "availabilities", "TXN_DEAL_SIGNAL": "transactions", "AVAIL_SOFT_MARKETING": "availabilities",
    "PEOPLE_BODY_SIGNAL": "people", "TXN_SF_IN_TITLE": "transactions", "RELEVANT_CRE_SIGNAL": "relevant", "EXCLUDE_NO_CRE_SIGNAL": "exclude",
}


def bare_title(title: Column) -> Column:
    """A title in lower case without its last part behind a spaced dash."""
    parts = F.split(F.coalesce(title, F.lit("")), r"\s+[-–—]\s+")
    return F.lower(F.trim(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " - ")).otherwise(F.coalesce(title, F.lit("")))))


def category_reason(title: Signals, text: Signals, link: Signals, source: Signals, stub: Column) -> Column:
    """Which rule gives an article its category, a key of CATEGORY_OF. All texts in lower case; ``stub``: the bare title."""
    asset, deal, context = text.matches(words.SOME_PROPERTY), text.matches(words.TRADED), text.matches(words.CRE_CONTEXT)
    dollars, feet = text.matches(words.DOLLARS[0]) | text.matches(words.DOLLARS[1]), text.matches(words.SQUARE_FEET)
    offered, marketed, completed = text.matches(words.ON_OFFER), text.matches(words.MARKETED), text.matches(words.COMPLETED)
    moved, firm = text.matches(words.MOVED), text.matches(words.FIRM_NAMED)
    other = text.any(words.NOT_INDUSTRIAL) & ~text.matches(words.STILL_INDUSTRIAL)
    site = source.any(["loopnet"]) | title.matches(words.LISTING_SITE) | link.any(["loopnet.com"])
    return first_match(
        [
            ("SCRAPE_ARTIFACT_INDEX_PAGE", title.matches(words.INDEX_PAGE)), ("LOW_VALUE_ROUNDUP", title.matches(words.ROUNDUP)), ("SCRAPE_ARTIFACT_CATEGORY_STUB", stub.isin(words.STUBS)),
            ("REJECT_WRONG_PROPERTY_TYPE", gates.wrong_property(text) & ~gates.strong_asset(text)), ("AVAIL_LOOPNET_LISTING", site & asset),
            ("AVAIL_TITLE_LEASE_SALE", title.matches(words.TITLE_MARKETED) & asset & ~title.matches(words.COMPLETED)), ("AVAIL_BODY_LEASE_SALE", marketed & asset & ~completed),
            ("AVAIL_NEW_SUPPLY", text.matches(words.NEW_SUPPLY) & asset & context), ("PEOPLE_TITLE_SIGNAL", title.matches(words.TITLE_MOVED) & firm), ("PEOPLE_PROFILE_FORMAT", text.matches(words.PROFILE) & firm),
            ("AVAIL_LISTING_EVENT", gates.is_listing(text) & asset & ~other), ("TXN_DEAL_SIGNAL", ~other & ((context & (deal | (dollars & (feet | asset)))) | (deal & feet))),
            ("AVAIL_SOFT_MARKETING", offered & asset & ~completed), ("PEOPLE_BODY_SIGNAL", moved & firm), ("TXN_SF_IN_TITLE", feet & asset & ~marketed),
            ("RELEVANT_CRE_SIGNAL", context | deal | offered | moved | firm | dollars | feet | gates.is_industrial(text)),
        ], "EXCLUDE_NO_CRE_SIGNAL",
    )


def recategorized(articles: DataFrame) -> DataFrame:
    """Articles (title, description, link, source) with category_reason and new_category."""

    def rules(text: Signals, title: Signals, link: Signals, source: Signals) -> dict[str, Column]:
        reason = text.once("category", lambda s: category_reason(title, s, link, source, bare_title(F.col("title"))))
        return {"category_reason": reason, "new_category": _of_reason(reason, CATEGORY_OF)}

    return decided(articles, {"title": F.lower(_given("title")), "link": F.lower(_given("link")), "source": F.lower(_given("source")), "text": F.lower(_text("title", "description"))}, rules)
