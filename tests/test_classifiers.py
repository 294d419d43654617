"""Classifiers on cases told in words, the automaton against plain counting, and whole rules against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import words
from quillstream.functions.signals import Automaton, Signals, ascii_bounds, decided
from quillstream.operators import classifiers
from quillstream.operators.classifiers import Engine

ARTICLES = "title string, description string, link string, source string"


def rows_of(spark, rows):
    return spark.createDataFrame([tuple([*r, None, None, None][:4]) for r in rows], ARTICLES).coalesce(1)


#: title, description, link, reason of the category or None, whether a build takes it or None
CASES = [
    ("Fashion designer takes 10K-SF office at 462 Seventh Avenue", "She signs an office lease downtown.", None, "REJECT_WRONG_PROPERTY_TYPE", None),
    ("Firm adds two former pharmacy stores", "The retail center was purchased for its leasing potential.", None, "REJECT_WRONG_PROPERTY_TYPE", None),
    ("$100M deal clears way for large county warehouse project", "A $100 million financing package for an industrial development.", None, "TXN_DEAL_SIGNAL", True),
    ("Prologis offloads bakery facility at the yard for $87M", "A bakery and distribution facility has traded hands.", None, "TXN_DEAL_SIGNAL", True),
    ("Capital drives the market: the next era of data center investment", "Panelists at a NAIOP conference in New Jersey discussed industrial capital.", None, "RELEVANT_CRE_SIGNAL", True),
    ("7 Machinery Dr, Tweed Heads South - Industrial for Lease - LoopNet", "Industrial for lease", None, "AVAIL_LOOPNET_LISTING", False),
    ("150 S Main St, Wood-Ridge, NJ 07075 - Industrial for Lease - LoopNet", "Industrial space available for lease in Wood-Ridge, NJ.", None, "AVAIL_LOOPNET_LISTING", True),
    ("Watch: robots and warehousing", "Explainer on warehouse automation.", "https://www.supplychainbrain.com/articles/1", None, False),
    ("31 sloths die in warehouse before exhibit opens", "Animal welfare.", None, None, False),
    ("Students win a video competition", "Their film was about mattresses.", None, "EXCLUDE_NO_CRE_SIGNAL", False),
    ("Tag: Logistics Real Estate - A Paper", None, None, "SCRAPE_ARTIFACT_INDEX_PAGE", None),
    ("News | Top industrial leases recognized for Metro - CoStar", None, None, "LOW_VALUE_ROUNDUP", None),
    ("Industrial - Real Estate NJ", None, None, "SCRAPE_ARTIFACT_CATEGORY_STUB", None),
    ("Industrial - RE-NJ", "", None, "SCRAPE_ARTIFACT_CATEGORY_STUB", None),
    ("Industrial park - Real Estate NJ", "", None, "RELEVANT_CRE_SIGNAL", None),
    ("Developer breaks ground on logistics center", "Spec warehouse under construction.", None, "AVAIL_TITLE_LEASE_SALE", True),
    ("Brokerage JLL names Ann Lee managing director", "She joins the warehouse team.", None, "PEOPLE_TITLE_SIGNAL", True),
    ("Owner lists 40-acre logistics site", "The property is marketed by a broker.", None, "AVAIL_LISTING_EVENT", True),
    (None, None, None, "EXCLUDE_NO_CRE_SIGNAL", False),
]


def test_categories_and_build_gate(spark):
    got = classifiers.build_gated(classifiers.recategorized(rows_of(spark, CASES))).collect()
    for case, r in zip(CASES, got, strict=True):
        if case[3]:
            assert r.category_reason == case[3] and r.new_category == classifiers.CATEGORY_OF[case[3]], case
        if case[4] is not None:
            assert r.included == case[4], (case, r.build_reason)
    assert set(classifiers.CATEGORY_OF.values()) == {"exclude", "availabilities", "people", "transactions", "relevant"}


def plain_engine(title, description, link, source, e):
    """The engine's rules one after the other."""
    text, origin = " ".join(x or "" for x in (title, description, link)).lower(), f"{source or ''} {link or ''}".lower()
    hold = lambda terms, t=text: any(w in t for w in terms)
    find = lambda patterns: any(re.search(p, text) for p in patterns)
    ind, cre = (min(10, w * sum(k in text for k in terms)) for terms, w in ((e.industrial, 1.2), (e.intent, 1.1)))
    if hold(e.overrides, origin):
        return "github", 10
    if not hold(e.sources, origin):
        return "unapproved source", 0
    if hold(e.excluded):
        return "excluded", 0
    if hold(e.other_places) and not hold(e.places):
        return "out of market", 0
    available, people, size, price, deal = hold(words.ENGINE_AVAILABLE), hold(words.ENGINE_PEOPLE), find(words.ENGINE_SIZES), find(words.ENGINE_PRICES), hold(words.ENGINE_DEALS)
    if (hold(words.ENGINE_BROKERS) or (hold(words.ENGINE_INVESTORS) and not available)) and people:
        return "people", 8
    if not hold(words.ENGINE_OTHER_TRADE) and not available:
        if size and deal:
            return "transactions", 9
        if size and (ind or cre):
            return "transactions", 7
        if deal and ind and price:
            return "transactions", 8
    if available and ind:
        return "availabilities", 7
    if ind and cre:
        return "relevant", (ind + cre) / 2
    return ("people", 6) if people and (ind or cre) else ("not relevant", 0)


def test_engine_against_plain_rules(spark):
    rng = random.Random(1)
    bits = [*words.ENGINE_INDUSTRIAL[:12], *words.ENGINE_INTENT[:12], *words.ENGINE_AVAILABLE, *words.ENGINE_PEOPLE[:6], "cbre", "buyer", "12,000 sf", "3.5 acres", "$40 million", "stock", "texas", "newark", "hotel", "été", "SOLD", "deal", "nothing at all", "ios"]
    e = Engine()
    rows = [(" ".join(rng.sample(bits, rng.randint(0, 3))), rng.choice([None, " ".join(rng.sample(bits, rng.randint(0, 4)))]), rng.choice([None, "https://x.github.io/a", "https://bisnow.com/b"]), rng.choice(["WSJ.com", None, "other"])) for _ in range(400)]
    got = classifiers.engine_classified(rows_of(spark, rows), e).collect()
    assert [(r.category, round(r.score, 9)) for r in got] == [(c, round(s, 9)) for c, s in (plain_engine(*r, e) for r in rows)]
    assert len({r.reason for r in got}) >= 10
    assert all(r.is_relevant == (r.score > 2) for r in got)


def test_automaton_counts_like_plain_search():
    rng = random.Random(2)
    terms = ["a", "aa", "aba", "bab", "abc", "ca", "ß", " a "]
    lists = [("count", tuple(terms)), ("count", ("aa", "aa", "zz")), ("occurrences", tuple(terms)), ("occurrences", ("aa",)), ("count", ()), ("count", ("",))]
    machine = Automaton(lists)
    for _ in range(300):
        text = "".join(rng.choice("abcß ") for _ in range(rng.randint(0, 30)))
        held = sum(t in text for t in terms)
        assert machine.hits(text) == [held, 2 * ("aa" in text), sum(text.count(t) for t in terms), text.count("aa"), 0, 0]
    assert Automaton([("count", ())]).hits("x") == [0]


def test_signals_once_or_in_place(spark):
    rows = spark.createDataFrame([("A warehouse, sold",), (None,), ("",), ("éstate sf " * 3000,)], "t string").coalesce(1)
    rules = lambda s: {"w": s.any(["warehouse", "dock"]), "n": s.count(["sold", "warehouse", "sold"]), "o": s.occurrences(["sf", "t"]), "p": s.matches(r"\bstate\b"), "x": s.once("v", lambda q: q.any(["a"]) & q.matches("sold"))}
    one = decided(rows, {"s": F.lower("t")}, rules)
    assert one.columns == ["t", "w", "n", "o", "p", "x"]
    plain = rows.withColumns(rules(Signals(F.lower("t"))))
    assert one.collect() == plain.collect()
    assert [tuple(r)[1:] for r in one.collect()] == [(True, 3, 0, False, True), (False, 0, 0, False, False), (False, 0, 0, False, False), (False, 0, 9000, True, False)]


def test_each_pattern_stands_once_in_the_plan(spark):
    rows = rows_of(spark, CASES)
    plan = classifiers.recategorized(rows)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (words.CRE_CONTEXT, words.SOME_PROPERTY, words.SQUARE_FEET):
        assert plan.count(ascii_bounds(pattern)[:60]) <= 1
    assert plan.count("ArrowEvalPython") == 1


def test_empty_tables_and_clashing_columns(spark):
    rows = rows_of(spark, CASES).withColumns({"reason": F.lit("x"), "text": F.lit(1), "hits": F.lit(2)})
    for step in (classifiers.engine_classified, classifiers.build_gated, classifiers.recategorized):
        assert step(rows.limit(0)).count() == 0
        assert step(rows).count() == len(CASES)


@pytest.mark.parametrize("pattern, text, there", [(r"\bsf\b", "10 sf", True), (r"\bsf\b", "ésf", True), (r"\bsf\b", "xsf", False), (r"a\b", "a", True)])
def test_ascii_bounds(spark, pattern, text, there):
    assert spark.createDataFrame([(text,)], "t string").select(Signals(F.col("t")).matches(pattern)).first()[0] == there


def test_patterns_are_tried_where_a_match_is_possible(spark):
    """Every match holds one of the strings that its pattern needs, and begins with one of its first letters; the answers stay."""
    import random
    import re

    from quillstream.functions import words
    from quillstream.functions.signals import needed

    assert needed(r"\b(sold|lists?)\b(?=x)|build\s+(to|for)") == ["build", "list", "sold"]
    assert needed(r"\d+\s*(sf|sq\.?\s*ft)") == ["sf", "sq"] and needed(r"\$[\d,]+") == ["$"]
    assert needed(r"(?i)sold") is None and needed(r"(sold)?") is None and needed(r"\w+|sold") is None and needed(r"x*+a") is None
    assert ascii_bounds(r"\b(sold|lists?)\b").startswith(r"(?=[ls])(?<!\w)(") and ascii_bounds(r"\b\w+") != r"\b\w+"
    assert "(?=[" not in ascii_bounds(r"\bsold|lists") and "(?=[" not in ascii_bounds(r"\b(sold)?\s") and "(?=[" not in ascii_bounds(r"\B(sold)")
    patterns = [p for name, v in vars(words).items() if not name.startswith("_") for p in ([v] if isinstance(v, str) else v if isinstance(v, list | tuple) else []) if isinstance(p, str) and re.search(r"[\\\[(?*+]", p)]
    rng = random.Random(5)
    bits = sorted({b for p in patterns for b in re.findall(r"[A-Za-z0-9$.]{2,}", re.sub(r"\\[a-z]", " ", p))})
    texts = [rng.choice(["", "x", "é", "_"]).join(rng.choice(bits) + rng.choice([" ", "  ", "-", "s ", "", ". "]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    matches = 0
    for p in patterns:
        for t in texts:
            if re.search(p, t, re.ASCII):
                matches += 1
                assert needed(p) is None or any(x in t for x in needed(p)), (p, t)
    assert matches > 300
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").repartition(3)
    some = patterns[::4]
    got = decided(df, {"t": F.col("t")}, lambda t: {f"p{k}": t.matches(p) for k, p in enumerate(some)})
    bound = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    plain = df.select("id", *(F.col("t").rlike(p.replace(r"\b", bound)).alias(f"p{k}") for k, p in enumerate(some)))
    names = ["id", *(f"p{k}" for k in range(len(some)))]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    seen = got._jdf.queryExecution().optimizedPlan().toString()
    assert "hits" in seen and "CASE WHEN" in seen  # tried behind the automaton
