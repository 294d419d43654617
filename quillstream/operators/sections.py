"""Section filters of an edition: each gives accepted, with the rule that let the article in, or why it stays out.

``text``: title, description and summary in one, or the questions to it. ``approved``: the editor's or model's verdict, null for none.
``elsewhere``: hits of other regions in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import deals, gates, words
from quillstream.functions.signals import Signals, decided
from quillstream.operators.rules import first_match

#: What every accepted verdict begins with.
ACCEPTED = "ACCEPTED"


def text_of(title: Column, description: Column, summary: Column | None = None) -> Column:
    """The lower-cased text that the filters read."""
    given = [F.coalesce(c, F.lit("")) for c in (title, description, F.lit("") if summary is None else summary)]
    return F.lower(F.concat_ws(" ", *given))


def refused(approved: Column, elsewhere: Column | None = None) -> Column:
    """Whether a verdict of no blocks; with ``elsewhere`` it is advice, which a text without other regions overrides."""
    no = F.coalesce(approved == F.lit(False), F.lit(False))
    return no if elsewhere is None else no & (elsewhere > 0)


def is_political(text: Column | Signals) -> Column:
    """Whether a text is about politics, conflict or accidents."""
    return Signals.of(text).any(words.POLITICAL)


def relevant_verdict(text: Column | Signals, approved: Column, keywords: list[str] = words.RELEVANT) -> Column:
    """Articles on the industrial market with one of the keywords."""
    return first_match(
        [
            ("RUBRIC_REJECT", refused(approved)), ("POLITICAL_CONTENT", is_political(text)), ("NOT_INDUSTRIAL", ~gates.is_industrial(text)),
            ("NO_RELEVANT_KEYWORDS", ~Signals.of(text).any(keywords)),
        ], "ACCEPTED",
    )


def transaction_verdict(text: Column | Signals, approved: Column) -> Column:
    """Deals: approvals of any size, sizes and prices from the threshold on; listings are none."""
    return first_match(
        [
            ("RUBRIC_REJECT", refused(approved)), ("POLITICAL_CONTENT", is_political(text)),
            ("WRONG_PROPERTY_TYPE", gates.wrong_property(text) & ~gates.strong_asset(text)), ("NOT_INDUSTRIAL", ~gates.is_industrial(text)),
            ("LISTING_EVENT_NOT_DEAL", gates.is_listing(text)), ("ACCEPTED_APPROVAL", Signals.of(text).any(deals.APPROVAL_WORDS)),
            ("ACCEPTED_THRESHOLD", Signals.of(text).once("deal", lambda s: deals.meets_threshold(s.text))), ("ACCEPTED_ACTION", Signals.of(text).any(words.DEAL_ACTIONS) & (Signals.of(text).once("size", lambda s: deals.size_sf(s.text)) >= 50_000)),
        ], "BELOW_DEAL_THRESHOLD",
    )


def availability_verdict(text: Column | Signals, approved: Column, elsewhere: Column) -> Column:
    """Space and land on the market, by listing, words or a stated size."""
    industrial = gates.is_industrial(text)
    return first_match(
        [
            ("RUBRIC_REJECT", refused(approved, elsewhere)), ("POLITICAL_CONTENT", is_political(text)), ("ACCEPTED_LISTING", gates.is_listing(text) & industrial),
            ("ACCEPTED_WORDS", Signals.of(text).any(words.AVAILABLE)), ("NOT_INDUSTRIAL", ~industrial), ("ACCEPTED_SIZE", Signals.of(text).once("size", lambda s: deals.size_sf(s.text)) > 0),
        ], "SECTION_RULE_FAILED",
    )


def person_signal(title: Column | Signals, text: Column | Signals) -> Column:
    """Whether a person is meant: a personnel verb in the title or a role in the text."""
    return Signals.of(title).matches(words.PERSON_TITLE) | Signals.of(text).any(words.PERSON_ROLES)


def people_action(title: Column | Signals, text: Column | Signals) -> Column:
    """A personnel action; verbs that companies share count only beside a person."""
    clear = [w for w in words.PEOPLE_ACTIONS if w not in words.OF_COMPANIES_TOO]
    shared = [w for w in words.PEOPLE_ACTIONS if w in words.OF_COMPANIES_TOO]
    return Signals.of(text).any(clear) | (Signals.of(text).any(shared) & person_signal(title, text))


def people_verdict(title: Column | Signals, text: Column | Signals, approved: Column, elsewhere: Column) -> Column:
    """Moves of people in the industry."""
    head = Signals.of(title)
    about = head.matches(words.PEOPLE_TITLE) | head.text.startswith("people:") | head.text.startswith("people |") | Signals.of(text).any(words.PEOPLE_BODY)
    return first_match(
        [
            ("RUBRIC_REJECT", refused(approved, elsewhere)), ("POLITICAL_CONTENT", is_political(text)), ("EXCLUDED_BY_LIST", Signals.of(text).any(words.NOT_FOR_PEOPLE)),
            ("CATEGORY_MISMATCH", ~about & Signals.of(text).any(words.DEAL_ACTIONS)), ("NO_PEOPLE_ACTION", ~people_action(title, text)),
            ("NOT_INDUSTRIAL", ~(Signals.of(text).any(words.INDUSTRY_NAMES) | Signals.of(text).matches(words.AGENCY_TOKEN))),
        ], "ACCEPTED",
    )


def routable_deal(text: Column | Signals, in_region: Column) -> Column:
    """A deal of the region that missed the cut of the transactions and may stand among the relevant articles."""
    fits = in_region & ~is_political(text) & ~(gates.wrong_property(text) & ~gates.strong_asset(text)) & gates.is_industrial(text)
    return fits & (Signals.of(text).any(words.DEAL_ACTIONS) | Signals.of(text).any(deals.APPROVAL_WORDS) | Signals.of(text).once("size", lambda s: deals.size_sf(s.text)).isNotNull() | Signals.of(text).matches(r"\$\s*\d"))


def rescued_to_people(title: Column | Signals, text: Column | Signals, in_region: Column, approved: Column, elsewhere: Column) -> Column:
    """Whether a relevant article moves to people: a personnel verb in the title, the region and the people filter."""
    return Signals.of(title).matches(words.RESCUE_TITLE) & in_region & people_verdict(title, text, approved, elsewhere).startswith(ACCEPTED)


def with_verdicts(articles: DataFrame, in_region: str = "in_region", elsewhere: str = "elsewhere", approved: str = "approved") -> DataFrame:
    """Articles (title, description) with the verdict of every section: relevant, transactions, availabilities, people;
    and routable, rescued and political.

    What the verdicts ask of a text is answered once: terms in one pass, each pattern once.
    """
    yes, other, here = F.col(approved), F.col(elsewhere), F.col(in_region)

    def verdicts(text: Signals, head: Signals) -> dict[str, Column]:
        people = people_verdict(head, text, yes, other)
        return {
            "relevant": relevant_verdict(text, yes), "transactions": transaction_verdict(text, yes), "availabilities": availability_verdict(text, yes, other), "people": people,
            "routable": routable_deal(text, here), "rescued": rescued_to_people(head, text, here, yes, other),
            "political": is_political(text),
        }

    return decided(articles, {"text": text_of(F.col("title"), F.col("description")), "head": F.lower(F.col("title"))}, verdicts)
