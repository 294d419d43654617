"""Gates over the text of an article: what kind of property and event it is about. Each gives a reason or a flag.

A gate takes a text or the questions to it (:class:`quillstream.functions.signals.Signals`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import deals, words
from quillstream.functions.signals import Signals
from quillstream.operators.rules import contains_any, first_match

#: Reasons of :func:`industrial_reason` with which an article passes.
INDUSTRIAL_REASONS = ["CORE_ASSET", "SUPPLY_CHAIN_ASSET", "MACRO", "DEAL_WITH_PROPERTY", "LEASE_WITH_CONTEXT", "FIRM_AND_ROLE"]


def is_detention(text: Column | Signals) -> Column:
    """Whether the property is used for detention; basins and ponds of a building site are not."""
    s = Signals.of(text)
    of_water = [s.matches(p) for p in words.DETENTION_OF_WATER]
    return s.matches(words.DETENTION_USE) | (s.matches(words.DETENTION) & ~of_water[0] & ~of_water[1])


def wrong_property(text: Column | Signals) -> Column:
    """Whether a deal is about another class of property, software or personnel."""
    return Signals.of(text).matches("|".join(words.WRONG_DEALS))


def strong_asset(text: Column | Signals) -> Column:
    """Whether an industrial asset is named that outweighs another class."""
    return Signals.of(text).matches(words.STRONG_ASSET)


def is_listing(text: Column | Signals) -> Column:
    """Whether a property is brought to market and no deal is done."""
    s = Signals.of(text)
    return s.matches(words.LISTING) & ~s.matches(words.DEAL_DONE)


def industrial_reason(text: Column | Signals) -> Column:
    """Why an article is about industrial property, one of INDUSTRIAL_REASONS, or why it isn't; the first rule that holds.

    Words of the first group that holds decide: where core words are there, supply chain and deal words aren't looked at.
    """
    t = Signals.of(text)
    core_alone = t.any(["industrial"]) & ~t.any([w for w in words.CORE if w != "industrial"])
    return first_match(
        [
            ("JUNK", t.matches(words.JUNK)),
            ("PAGE_INDEX", t.matches(words.PAGE_INDEX)),
            ("DETENTION", is_detention(t)),
            ("OFFICE_LED", t.matches(words.OFFICE_LED) & ~t.matches(words.ASSET_NAMED)),
            ("OTHER_PROPERTY", t.any(words.NOT_INDUSTRIAL) & ~t.any(words.KEPT_ANYWAY)),
            ("INDUSTRIAL_ALONE", core_alone & ~t.matches(words.PROPERTY_SIGNAL)),
            ("CORE_ASSET", t.any(words.CORE)),
            ("SUPPLY_CHAIN_ASSET", t.any(words.SUPPLY_CHAIN) & t.matches(words.PHYSICAL_ASSET)),
            ("SUPPLY_CHAIN_ALONE", t.any(words.SUPPLY_CHAIN)),
            ("MACRO", t.any(words.MACRO)),
            ("VEHICLE_AD", t.any(words.DEAL_SIGNALS) & t.matches(words.VEHICLE_AD)),
            ("DEAL_WITH_PROPERTY", t.any(words.DEAL_SIGNALS) & t.matches(words.PROPERTY_CONTEXT)),
            ("DEAL_ALONE", t.any(words.DEAL_SIGNALS)),
            ("LEASE_WITH_CONTEXT", t.any(words.LEASE_WORDS) & (t.matches(words.LEASE_CONTEXT) | t.matches(words.LAND_SIGNAL))),
            ("FIRM_AND_ROLE", t.any(words.FIRMS) & t.any(words.ROLES)),
        ],
        "NO_SIGNAL",
    )


def is_industrial(text: Column | Signals) -> Column:
    """Whether an article is about industrial property or its market."""
    return Signals.of(text).once("industrial", lambda s: industrial_reason(s).isin(INDUSTRIAL_REASONS))


def data_centre_verdict(text: Column, in_region: Column, elsewhere: Column) -> Column:
    """not-dc, allow-macro, allow-regional, allow-national-scale (5 billion dollars or 500 megawatts), reject-oor or
    allow-unknown-location. ``in_region``, ``elsewhere``: whether the text has evidence of a target region, of another.
    """
    t = F.lower(text)
    billions, megawatts = deals.largest_billions(t), deals.largest_megawatts(t)
    no_scale = billions.isNull() & megawatts.isNull()
    project = ~t.rlike(words.CENTRE_POLICY) & t.rlike(words.CENTRE_PROJECT) & ~(t.rlike(words.CENTRE_MARKET) & no_scale)
    national = F.coalesce(billions >= 5, F.lit(False)) | F.coalesce(megawatts >= 500, F.lit(False))
    return first_match(
        [("not-dc", ~t.rlike(words.DATA_CENTRE)), ("allow-macro", ~project), ("allow-regional", in_region), ("allow-national-scale", national), ("reject-oor", elsewhere)],
        "allow-unknown-location",
    )


def says_nothing(description: Column) -> Column:
    """Whether a generated description has no content."""
    return contains_any(F.coalesce(description, F.lit("")), words.EMPTY_TALK)
