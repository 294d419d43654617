"""The last gates before a send, each with the reason why an article goes, and news of people that stand in other sections.

Texts, links and sources are lower-cased; ``raw`` keeps its case, as names of other markets count there in lower case only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import gates, words
from quillstream.functions.signals import Signals, decided
from quillstream.operators.rules import first_match
from quillstream.operators.sections import text_of


@dataclass(frozen=True)
class Markets:
    """What the gates know of markets and sources."""

    target: str = words.FINAL_TARGET
    macro: str = words.FINAL_MACRO
    scrub_target: str = words.SCRUB_TARGET
    trusted: list[str] = field(default_factory=lambda: words.FINAL_TRUSTED)
    others: list[str] = field(default_factory=lambda: words.OTHER_MARKETS)


EXCEPTIONS = ["allow-national-scale", "allow-unknown-location"]


def final_reason(text: Signals, raw: Signals, title: Signals, url: Signals, source: Column, centre: Column, section: Column, of: Markets) -> Column:
    """PASSES, or why the final gate blocks an article. ``centre``: the verdict on data centres; ``section``: where it stands."""
    target = text.matches(of.target)
    trusted = F.lower(F.coalesce(source, F.lit(""))).isin(of.trusted) | url.any(of.trusted)
    return first_match(
        [
            ("DC_OUT_OF_REGION", centre == "reject-oor"), ("DC_OUTSIDE_RELEVANT", centre.isin(EXCEPTIONS) & (section != "relevant")), ("NOT_INDUSTRIAL", ~gates.is_industrial(text)),
            ("OTHER_MARKET", ~target & raw.any(of.others)), ("NO_REGION_SOURCE_OR_MACRO", ~target & ~trusted & ~text.matches(of.macro)), ("CATALOGUE_OUTSIDE_TARGET", title.any(["loopnet"]) & ~target),
        ], "PASSES",
    )


def cleaned_description(title: Column, description: Column, url: Column) -> Column:
    """The title without its publisher where a news search gave a description that only repeats it; else the description."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\w\s]", ""))
    t, d = plain(title), plain(description)
    repeats = F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("news.google.com")) & F.startswith(d, F.substring(t, 1, 30)) & (F.length(d) < F.length(t) + 40)
    return F.when(repeats, F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), words.FINAL_SUFFIX, ""))).otherwise(description)


def scrub_reason(text: Signals, title: Signals, description: Signals, of: Markets) -> Column:
    """PASSES, or why an article is scrubbed before a send. ``title``: trimmed."""
    charity = title.matches(words.SCRUB_CHARITY) | (title.matches(words.SCRUB_NONPROFIT) & text.matches(words.SCRUB_GIVING))
    return first_match(
        [
            ("BROKEN_TITLE", (F.length(title.text) < 20) | title.matches(words.PAGE_INDEX)), ("EMPTY_TALK", description.any(words.SCRUB_EMPTY_TALK)), ("JUNK", text.matches(words.SCRUB_JUNK)),
            ("CLIP", title.matches(words.SCRUB_CLIP)), ("STUDENTS", title.matches(words.SCRUB_STUDENTS)), ("CHARITY", charity), ("NOT_INDUSTRIAL", ~gates.is_industrial(text)),
            ("OTHER_MARKET", text.any(of.others) & ~text.matches(of.scrub_target)),
        ], "PASSES",
    )


def moves_to_people(text: Signals, title: Signals, section: Column) -> Column:
    """Whether a relevant article or a transaction is news of people: an action with a role or the industry, or a milestone of a
    role; of relevant ones no deals without a verb of people in the title, of transactions only those with one.
    """
    signal, role = title.matches(words.PEOPLE_TITLE), text.any(words.PERSON_ROLES)
    industry = text.any(words.INDUSTRY_NAMES) | text.matches(words.AGENCY_TOKEN)
    clear, shared = [w for w in words.STRONG_PEOPLE_ACTIONS if w not in words.OF_COMPANIES_TOO], [w for w in words.STRONG_PEOPLE_ACTIONS if w in words.OF_COMPANIES_TOO]
    person = title.matches(words.PERSON_TITLE) | role
    action = text.any(clear) | (text.any(shared) & person) | signal
    found = ~text.any(words.NOT_FOR_PEOPLE) & ((action & (role | industry)) | (text.any(words.PEOPLE_PUFF) & role))
    return F.when(section == "relevant", found & (signal | ~text.any(words.DEAL_ACTIONS))).when(section == "transactions", found & signal).otherwise(False)


def gated(articles: DataFrame, centre: str, section: str, of: Markets | None = None) -> DataFrame:
    """Articles (title, description, link, source) with final_reason, scrub_reason and to_people; signals once a text."""
    m = of or Markets()
    given = lambda c: F.coalesce(F.col(c), F.lit(""))

    def rules(text: Signals, raw: Signals, title: Signals, description: Signals, url: Signals) -> dict[str, Column]:
        return {
            "final_reason": final_reason(text, raw, title, url, F.col("source"), F.col(centre), F.col(section), m), "scrub_reason": scrub_reason(text, title, description, m),
            "to_people": moves_to_people(text, title, F.col(section)),
        }

    texts = {
        "raw": F.concat_ws(" ", given("title"), given("description")), "title": F.lower(F.trim(given("title"))), "description": F.lower(given("description")), "url": F.lower(given("link")),
        "text": text_of(F.col("title"), F.col("description")),
    }
    return decided(articles, texts, rules)
