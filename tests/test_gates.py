"""Gates, regions, section filters and links on texts whose verdict is known."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import gates, links
from quillstream.operators import regions, sections
from quillstream.sources.briefs import REGIONS


def told(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"_n int, {schema}").orderBy("_n").select(*cols).collect()]


def test_industrial_reason(spark):
    cases = {
        "Firm takes 25K SF at the new office tower": "OFFICE_LED", "Warehouse and office building trade": "CORE_ASSET", "Industrial heir sells Palm Beach home": "OTHER_PROPERTY",
        "The industrial revolution, remembered": "INDUSTRIAL_ALONE", "Industrial demand cools": "CORE_ASSET", "Sloth dies in warehouse": "JUNK", "Industrial – Page 360 - Real Estate": "PAGE_INDEX",
        "County plans detention center in warehouse": "DETENTION", "Stormwater detention basin for logistics park": "CORE_ASSET", "Freight rates climb": "SUPPLY_CHAIN_ALONE", "Freight at intermodal terminals": "SUPPLY_CHAIN_ASSET",
        "Inflation eases": "MACRO", "Sedan for sale": "VEHICLE_AD", "Toys for sale": "DEAL_ALONE", "Complex acquired": "DEAL_WITH_PROPERTY", "Tenant of 9,000 sqft": "LEASE_WITH_CONTEXT", "Newmark broker speaks": "FIRM_AND_ROLE", "": "NO_SIGNAL",
    }
    got = told(spark, [(t,) for t in cases], "t string", gates.industrial_reason(F.col("t")))
    assert [x for (x,) in got] == list(cases.values())


def test_listing_and_wrong_property(spark):
    rows = [("Owner lists 40-acre site", True, False), ("Owner sells and lists building", False, False), ("Ten markets to watch", False, False), ("Broker offers cash", False, False), ("Takes 10,000 sf office", False, True), ("Self storage unit sold", False, True), ("Warehouse sold", False, False)]
    got = told(spark, [(t,) for t, *_ in rows], "t string", gates.is_listing(F.col("t")), gates.wrong_property(F.col("t")))
    assert got == [tuple(x) for _, *x in rows]


def test_data_centre_verdict(spark):
    rows = [("Warehouse sold", False, False, "not-dc"), ("Data center zoning debated", True, False, "allow-macro"), ("Data center campus planned", True, True, "allow-regional"), ("Data center campus planned, 500 MW", False, True, "allow-national-scale"),
            ("Data centre campus of $4.9 billion planned", False, True, "reject-oor"), ("Datacenter campus planned", False, False, "allow-unknown-location"), ("Data center demand and a campus", False, True, "allow-macro")]
    got = told(spark, [r[:3] for r in rows], "t string, i boolean, e boolean", gates.data_centre_verdict(F.col("t"), F.col("i"), F.col("e")))
    assert [x for (x,) in got] == [r[3] for r in rows]


def test_regions(spark):
    rows = [("Chester hall sold", 1, 0, None), ("Westchester hall sold", 0, 1, "PRIMARY_LOCATION_NON_TARGET"), ("Peru firm in Brazil", 1, 1, "PRIMARY_LOCATION_NON_TARGET"), ("Brazil firm buys Lima hall", 1, 0, "BUYER_ONLY_IN_TARGET"),
            ("Brazil firm buys Canada hall", 2, 0, None), ("Industrial Development Agency votes", 0, 0, "GOV_AGENCY_NO_TARGET_PROPERTY"), ("Hall for rent - LoopNet", 0, 0, "SOURCE_LISTING_AGGREGATOR_NO_TARGET"), (None, 0, 0, None)]
    t = F.coalesce("t", F.lit(""))
    got = told(spark, [(r[0],) for r in rows], "t string", regions.target_count(t, REGIONS), regions.excluded_count(t, REGIONS), regions.geography_failure(F.col("t"), F.lit(None).cast("string"), REGIONS))
    assert got == [r[1:] for r in rows]


@pytest.mark.parametrize(
    ("title", "people"),
    [("Firm approved for manufacturing award", "NO_PEOPLE_ACTION"), ("Warehouse firm names managing director", "ACCEPTED"), ("Warehouse leased by firm", "CATEGORY_MISMATCH"), ("Baker joins Redfin", "EXCLUDED_BY_LIST"), ("Chef joined team", "NOT_INDUSTRIAL")],
)
def test_people(spark, title, people):
    t = sections.text_of(F.col("t"), F.lit(None).cast("string"))
    assert told(spark, [(title,)], "t string", sections.people_verdict(F.col("t"), t, F.lit(None).cast("boolean"), F.lit(0))) == [(people,)]


def test_rubric_is_advice_in_two_sections(spark):
    t, no = F.lit("warehouse space available in town, broker named"), F.lit(False)
    got = told(spark, [(0,), (1,)], "other int", sections.relevant_verdict(t, no), sections.availability_verdict(t, no, F.col("other")), sections.people_verdict(t, t, no, F.col("other")))
    assert got == [("RUBRIC_REJECT", "ACCEPTED_WORDS", "ACCEPTED"), ("RUBRIC_REJECT", "RUBRIC_REJECT", "RUBRIC_REJECT")]


def test_links(spark):
    urls = ["HTTP://User@Www.Site.org:80/a/b?utm_source=x&id=3#top", "https://cache.site.org/a?utm_source=x", "ftp://site.org/a", "", None]
    u = F.col("u")
    got = told(spark, [(x,) for x in urls], "u string", links.host(u), links.http_only(u), links.cleaned(u), links.host_path_query(u), links.allowed(u, ["site.org"]), links.is_refused(u))
    assert got[0] == ("www.site.org", urls[0], "HTTP://User@Www.Site.org:80/a/b?id=3", "www.site.org/a/b?utm_source=x&id=3", True, True)
    assert got[1][2] == urls[1] and got[2][1] == "" and got[3][:3] == ("", "", "") and got[4][1] == ""
    pick = told(spark, [(None, None, "https://alt.org/x", None, "https://g.org"), (None, "https://l.org", None, None, None), (None, None, None, None, "tag:5")], "o string, l string, a string, m string, g string", links.first_link(*map(F.col, "olamg")))
    assert pick == [("https://alt.org/x",), ("https://l.org",), (None,)]
    image = told(spark, [("e.mp3", "audio/x", None, "t.png", None), ("e.png", "image/png", "m", "t", None), (None, None, None, None, '<p><img alt="" src="i.png">')], "e string, k string, m string, t string, h string", links.first_image(*map(F.col, "ekmth")))
    assert image == [("t.png",), ("e.png",), ("i.png",)]
    text = told(spark, [("a &amp;lt; <b>x</b> &lt;i&gt;y",), (None,)], "t string", links.plain_text(F.col("t")), links.stated_size(F.lit("about 12,500 sq ft")), links.stated_price(F.lit("for $3 billion")))
    assert text == [("a x y", 12500, 3e9), ("", 12500, 3e9)]
    assert told(spark, [("No details provided.",), ("A hall was sold.",)], "t string", gates.says_nothing(F.col("t"))) == [(True,), (False,)]


def test_verdicts_tell_what_is_political(spark):
    rows = [("Governor visits warehouse", "election", True, 0, None), ("Warehouse sold", None, True, 0, True), ("Senate votes", "", False, 1, False)]
    df = spark.createDataFrame(rows, "title string, description string, in_region boolean, elsewhere int, approved boolean")
    got = {r.title: r.political for r in sections.with_verdicts(df).collect()}
    want = {r.title: r.p for r in df.select("title", sections.is_political(sections.text_of(F.col("title"), F.col("description"))).alias("p")).collect()}
    assert got == want and len(set(want.values())) == 2
