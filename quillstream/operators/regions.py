"""Where an article is set: counts of region words, and the order in which places stand in a title.

The places are parameters (:class:`Regions`), upper-cased terms and patterns, so that any market can be the target.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import words
from quillstream.functions.signals import Signals, decided
from quillstream.operators.rules import first_match


@dataclass(frozen=True)
class Regions:
    """Places of the target and others. Patterns are matched against lower-cased titles."""

    targets: list[str]
    excluded: list[str]
    foreign: list[str]
    target_phrase: str
    other_phrase: str
    also_excluded: list[str] = field(default_factory=list)
    approved_hosts: list[str] = field(default_factory=list)
    regional_sources: list[str] = field(default_factory=list)
    own_names: list[str] = field(default_factory=list)  # articles of the house itself

    @property
    def collisions(self) -> list[str]:
        """Excluded terms, once for each target term that they contain: each occurrence is no hit of the target."""
        return [e for t in self.targets for e in self.excluded if t in e and t != e]


def _joined(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def _upper(text: Column | Signals) -> Signals:
    return text if isinstance(text, Signals) else Signals(F.upper(text))


def target_count(text: Column | Signals, of: Regions) -> Column:
    """Hits of target terms, less those that lie in excluded terms. ``text``: a text or the questions to it in upper case."""
    upper = _upper(text)
    return F.greatest(F.lit(0), upper.occurrences(of.targets) - upper.occurrences(of.collisions))


def excluded_count(text: Column | Signals, of: Regions) -> Column:
    """Hits of excluded terms."""
    return _upper(text).occurrences(of.excluded)


def _holds(text: Column | Signals, terms: list[str]) -> Column:
    return Signals.of(text).any([t.lower() for t in terms])


def _place(pattern: str, s: Signals) -> Column:
    """First place of a pattern, from 1; null for none."""
    return F.nullif(F.regexp_instr(s.text, F.lit(pattern)), F.lit(0))


def geography_failure(title: Column, description: Column, of: Regions, head: Signals | None = None, whole: Signals | None = None) -> Column:
    """Why an article can't be set in the target, or null: an agency or a catalogue without a target place, another place
    named first, a buyer from the target and an asset that isn't there. ``head``, ``whole``: questions to the title and to all.
    """
    head = head or Signals(F.lower(F.trim(F.coalesce(title, F.lit("")))))
    whole = whole or Signals(F.concat_ws(" ", head.text, F.lower(F.coalesce(description, F.lit("")))))
    t, no_target = head.text, ~whole.matches(of.target_phrase)
    other, target = head.once("other_at", lambda s: _place(of.other_phrase, s)), head.once("target_at", lambda s: _place(of.target_phrase, s))
    verb = head.once("verb", lambda s: F.regexp_extract(s.text, words.BUYS, 0))
    at = F.position(verb, t)
    buyer, asset = F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(verb), F.length(t))
    return first_match(
        [
            ("GOV_AGENCY_NO_TARGET_PROPERTY", whole.matches(words.AGENCY) & no_target),
            ("SOURCE_LISTING_AGGREGATOR_NO_TARGET", (head.matches(words.CATALOGUE) | head.matches(words.CATALOGUE_START)) & no_target),
            ("PRIMARY_LOCATION_NON_TARGET", other.isNotNull() & (target.isNull() | (other < target))),
            ("BUYER_ONLY_IN_TARGET", (verb != "") & _holds(buyer, of.targets) & ~_holds(asset, of.targets)),
        ]
    )


@dataclass(frozen=True)
class Place:
    """What is known of an article's place, each a column: hits of the target, of other regions and of those excluded besides,
    why it fails, and whether it names a foreign or a target place.
    """

    hits: Column
    elsewhere: Column
    also: Column
    failure: Column
    abroad: Column
    named: Column

    @classmethod
    def of(cls, title: Column, description: Column, regions: Regions) -> Place:
        """From the texts, where they stand."""
        upper, lower = Signals(F.upper(_joined(title, description))), Signals(F.lower(_joined(title, description)))
        return cls(**_facts(title, description, regions, upper, lower, None, None))


def _facts(title: Column, description: Column, regions: Regions, upper: Signals, lower: Signals, head: Signals | None, whole: Signals | None) -> dict[str, Column]:
    return {
        "hits": target_count(upper, regions), "elsewhere": excluded_count(upper, regions), "also": upper.occurrences(regions.also_excluded),
        "failure": geography_failure(title, description, regions, head, whole), "abroad": _holds(lower, regions.foreign), "named": _holds(lower, regions.targets),
    }


def with_places(articles: DataFrame, regions: Regions) -> DataFrame:
    """Articles (title, description) with hits, elsewhere, also, failure, abroad and named; every question answered once a text."""
    title, description = F.col("title"), F.col("description")
    head = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    texts = {"upper": F.upper(_joined(title, description)), "lower": F.lower(_joined(title, description)), "head": head, "whole": F.concat_ws(" ", head, F.lower(F.coalesce(description, F.lit(""))))}
    return decided(articles, texts, lambda upper, lower, head, whole: _facts(title, description, regions, upper, lower, head, whole))


def place_of(articles: DataFrame) -> Place:
    """The columns that :func:`with_places` adds."""
    return Place(*(F.col(c) for c in ("hits", "elsewhere", "also", "failure", "abroad", "named")))


def is_target_region(title: Column, description: Column, url: Column, tags: Column, of: Regions, place: Place | None = None) -> Column:
    """Whether an article is set in the target. ``tags``: the article's own regions, an array of strings or null."""
    p, link = place or Place.of(title, description, of), F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(link, r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    tagged = F.coalesce(F.exists(tags, lambda x: _holds(x, of.targets)), F.lit(False))
    return (
        F.when(p.failure.isNotNull() | p.abroad, False)
        .when((host != "") & ~_holds(host, of.approved_hosts), False)
        .when(_holds(link, of.regional_sources), ~((p.elsewhere > p.hits) & (p.elsewhere >= 1)))
        .when(tagged, True)
        .otherwise((p.named & (p.hits >= p.elsewhere)) | (p.named & (p.elsewhere == 0)))
    )


def not_excluded(text: Column, of: Regions, place: Place | None = None) -> Column:
    """Whether a text isn't set in another region; texts without any region pass."""
    p = place or Place.of(text, F.lit(None).cast("string"), of)
    other = p.elsewhere + p.also
    return ~(p.abroad | ((other > 0) & (p.hits == 0)) | (other > p.hits))


def passes_with_description(title: Column, description: Column, source: Column, category: Column, of: Regions, place: Place | None = None) -> Column:
    """The check after descriptions were written: foreign places, and others that outweigh the target."""
    p = place or Place.of(title, description, of)
    own = _holds(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(source, F.lit(""))), of.own_names)
    return (
        F.when(F.coalesce(description, F.lit("")) == "", True).when(own, True).when(_holds(description, of.foreign), False)
        .when(category == "relevant", ~((p.elsewhere > 0) & (p.hits == 0))).otherwise(~((p.elsewhere > 0) & (p.elsewhere > p.hits)))
    )
