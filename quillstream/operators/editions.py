"""Choosing an edition: windows, floors filled by tiers, near-title survivors, the raw feed, feeds' tiers, cool-downs.

An edition's section is small, as a send is; where a fold needs all of one, it holds one section's similar pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import ascii_bounds, scorer_title
from quillstream.operators.dedup import linked_classes
from quillstream.operators.rounds import dropped_by_classes, written

# Places whose difference tells two stories apart, over lower-cased titles.
PLACES = (
    r"\b(new jersey|nj|pennsylvania|pa|florida|fl|newark|jersey city|edison|piscataway|elizabeth|trenton|camden|woodbridge|carteret|linden|secaucus|kearny|bayonne|paterson|clifton|hoboken"
    r"|union city|new brunswick|south brunswick|perth amboy|sayreville|south plainfield|moonachie|carlstadt|rockaway|parsippany|hamilton|robbinsville|cranbury|meadowlands|philadelphia|philly"
    r"|allentown|bethlehem|easton|lehigh valley|pittsburgh|harrisburg|lancaster|reading|scranton|king of prussia|conshohocken|bucks county|montgomery county|chester county|delaware county"
    r"|miami|doral|hialeah|medley|fort lauderdale|pompano|broward|west palm|palm beach|miami-dade|orlando|tampa|jacksonville|ocala|winter park|savannah|columbus|phoenix|atlanta|dallas|houston"
    r"|austin|chicago|denver|seattle|nashville|charlotte|memphis|richmond|louisville|new york|brooklyn|boston|los angeles|san francisco|las vegas)\b"
)
# Amounts whose difference tells two stories apart, and the mark that scales each up by a thousand.
AMOUNTS = {
    "price": (r"\$\s*(\d[\d,]*(?:\.\d+)?)\s*(b|bn|billion|m|mm|million)?\b", "b", 1),
    "sf": (r"(\d[\d,]*(?:\.\d+)?)\s*(?:k)?\s*(?:sf|sq\.?\s*ft|square[\s-]*f(?:ee|oo)t)\b", "k", 1000),
    "acre": (r"(\d[\d,]*(?:\.\d+)?)\s*-?\s*acres?\b", "", 1),
    "mw": (r"(\d[\d,]*(?:\.\d+)?)\s*-?\s*(gw|gigawatts?|mw|megawatts?)\b", "g", 1),
}
# Sources preferred over syndicated copies.
PREFERRED = ["re-nj.com", "roi-nj.com", "njbiz.com", "lvb.com", "bisnow.com", "globest.com", "costar.com", "bizjournals.com", "rebusinessonline.com", "connectcre.com", "commercialobserver.com", "therealdeal.com"]
#: Rows of a feed configuration up to which it is broadcast.
BROADCAST_FEEDS = 100_000


def _bare(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[-–—|]\s+[^-–—|]*$", ""))


def _amount(mark: str, unit: int):
    def value(x: Column) -> Column:
        n = F.replace(F.regexp_extract(x, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).cast("double")
        scale = F.when(F.contains(x, F.lit(mark)), 1000.0).otherwise(1.0) if mark else F.lit(1.0)
        return F.floor(n * scale / unit + 0.5).cast("string")

    return value


def title_facts(title: Column) -> list[Column]:
    """Distinct places and rounded amounts of each kind that a title names; only titles that both name some can differ."""
    bare = _bare(title)
    amounts = [F.transform(F.regexp_extract_all(bare, F.lit(ascii_bounds(pattern)), 0), _amount(mark, unit)) for pattern, mark, unit in AMOUNTS.values()]
    return [F.array_distinct(x) for x in (F.regexp_extract_all(bare, F.lit(ascii_bounds(PLACES)), 0), *amounts)]


def conflicting(a: Column, b: Column) -> Column:
    """Whether two fact lists both say something and share nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def clashing(a: str, b: str) -> Column:
    """Whether two columns of fact lists conflict in one of them."""
    return F.exists(F.arrays_zip(a, b), lambda z: conflicting(z[a], z[b]))


def class_name() -> Column:
    """A name for rows that agree in within, words (sorted) and facts: none of them is nearer to others than the rest."""
    return F.sha1(F.to_json(F.struct("within", "words", "facts")))


def near_title_survivors(df: DataFrame, id_col: str, order_col: str, section: str, title: str, source: str, score: str) -> DataFrame:
    """Rows left when, in order, of each near-title pair of a section one goes.

    A pair's titles share three fifths of their longer words and conflict neither in place nor in amounts. The better
    source stays, then the longer title, the higher score, the earlier row; a row that went takes part no more. Titles of
    the same words and facts are a class; only classes meet, over words that they share; ids are unique and not null.
    """
    hit = F.lit(False)
    for name in PREFERRED:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(source), F.lit(""))), F.lit(name))
    key = scorer_title(F.col(title))
    facts = title_facts(F.col(title))
    rank = F.struct(hit.cast("int"), F.length(key), F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    words = F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 3))
    told = df.select(
        F.col(id_col).alias("key"), F.struct(F.col(order_col).alias("ord"), F.col(id_col).alias("id")).alias("place"), rank.alias("rank"),
        F.coalesce(F.col(section), F.lit("")).alias("within"), F.array_sort(words).alias("words"), F.array(*facts).alias("facts"),
    ).where(F.size("words") > 0)
    rows = written(told.withColumn("class", class_name()))
    links = linked_classes(rows.select("class", "within", "words", "facts").dropDuplicates(["class"]), clashing)
    gone = dropped_by_classes(rows, links).withColumnRenamed("gone", "_gone")
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def adaptive_window(df: DataFrame, ts: str, as_of: Column, floors: dict[str, tuple[Column, int]], narrow: int = 24, wide: int = 48) -> DataFrame:
    """Rows of the narrow window if each condition holds for its floor of rows there, else of the wide one.

    The choice is a scalar subquery, so it needs no action in between. Rows after ``as_of`` don't count.
    """
    age = lambda hours: (F.col(ts) <= as_of) & (F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    wide_rows = df.where(age(wide))
    enough = [F.coalesce(F.count_if(cond & age(narrow)) >= floor, F.lit(False)) for cond, floor in floors.values()]
    every = F.lit(True)
    for e in enough:
        every = every & e
    hours = wide_rows.agg(F.when(every, narrow).otherwise(wide)).scalar()
    return wide_rows.withColumn("window_hours", hours).where((F.col("window_hours") == wide) | age(narrow))


def filled_by_tiers(df: DataFrame, id_col: str, section: str, tier: str, order: list[Column], floors: dict[str, int]) -> DataFrame:
    """All rows of tier 0 and, where a section has fewer than its floor, the next by tier and order until it is met.

    A row counts in the first tier that has it. Two windows, no loop over tiers.
    """
    once = df.withColumn("_k", F.row_number().over(Window.partitionBy(id_col).orderBy(tier, *order))).where("_k = 1").drop("_k")
    floor = F.lit(0)
    for name, n in floors.items():
        floor = F.when(F.col(section) == name, n).otherwise(floor)
    w = Window.partitionBy(section).orderBy(tier, *order)
    ranked = once.withColumn("place", F.row_number().over(w))
    return ranked.where((F.col(tier) == 0) | (F.col("place") <= floor))


def raw_feed(df: DataFrame, id_col: str, title: str, ts: str, order_col: str, as_of: Column, hours: int = 72, most: int = 500) -> DataFrame:
    """The newest rows of a window, one a title (its first 60 characters, the first row in input order)."""
    recent = df.where((F.coalesce(F.col(title), F.lit("")) != "") & (F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    key = F.substring(F.trim(F.lower(title)), 1, 60)
    first = recent.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order_col, id_col))).where("_k = 1").drop("_k")
    return first.orderBy(F.col(ts).desc(), F.col(order_col)).limit(most)


def feed_tiers(df: DataFrame, name: str, feeds: DataFrame, feed_name: str, feed_order: str, tier: str, otherwise: str = "C") -> DataFrame:
    """``df`` with _tier: that of the first feed whose name contains the row's or is contained in it.

    Containment has no key to join on, so distinct names meet the distinct feeds: broadcast up to BROADCAST_FEEDS, in blocks
    of that many beyond.
    """
    names = df.select(F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name")).distinct()
    known = feeds.select(F.lower(feed_name).alias("_feed"), F.col(feed_order).alias("_order"), F.coalesce(F.col(tier), F.lit(otherwise)).alias("_feed_tier")).where("_feed != ''")
    parts = -(-known.count() // BROADCAST_FEEDS)
    contained = F.contains("_name", "_feed") | F.contains("_feed", "_name")
    met = None
    for k in range(max(parts, 1)):
        block = known if parts <= 1 else known.where(F.pmod(F.xxhash64("_feed"), F.lit(parts)) == k)
        found = names.join(F.broadcast(block), contained)
        met = found if met is None else met.unionByName(found)
    first = met.groupBy("_name").agg(F.min_by("_feed_tier", F.struct("_order", "_feed")).alias("_tier"))
    return df.join(first, F.lower(F.coalesce(F.col(name), F.lit(""))) == F.col("_name"), "left").drop("_name").withColumn("_tier", F.coalesce("_tier", F.lit(otherwise)))


def cooldown_minutes(failures: Column, block_after: int = 3) -> Column:
    """Minutes that a feed rests after so many failures in a row: 30 each, a day from ``block_after`` on."""
    return F.when(failures <= 0, 0).when(failures >= block_after, 24 * 60).otherwise(30 * failures).cast("bigint")
