"""The cascade that assembles editions: windows, moves between sections, fills by tiers, dedup, policies, caps, refills.

Many editions are assembled at once: every step is a window or a join over (edition, section), with the edition in every key,
so editions spread over the cluster and no step holds one edition's articles. What is order-bound (near titles, signatures,
deals of one firm) goes by rounds of joins. What an article is worth and passes is not decided here: ``facts`` brings it.

Facts, one row an article (ids unique): id, ord (place in the list, for ties), ts, section, passes (its section's filter),
in_region, not_excluded, described_ok (after descriptions), political, to_people, routable, rescued, centre (ok, exception or
reject, of data centres), score, deal_score, gate_ok, scrub_ok, sigs (array of strings), entity, sf, price (of one deal),
title_key, words (array), name_facts (array of arrays), preferred. Null flags count as false, null sigs and words as none.

Steps, in order:
1 the window of an edition: the narrow one if it has the floors of relevant articles and of transactions in the region,
  else the wide one (longer on Mondays); 2 what passes there; 3 personnel news moves to people; 4 near titles of a section:
  one stays; 5 sections below their floor are filled from thirty days; 6 deals of the region that are too small go to
  relevant, up to its cap; 7 reserves fill what is below its floor; 8 an edition below its least total takes relevant
  reserves; 9 manual includes; 10 one article a deal signature (transactions, availabilities, relevant; not people);
  11 one an equal title, the last of each section first; 12 data centres: rejected ones go, exceptions stay in relevant alone,
  the best one, last; 13 caps by score; 14 the final gate and the check of descriptions; 15 refills to the floors, first from
  the window, then from thirty days, without near titles of what the section has; 16 signatures again (relevant,
  transactions, availabilities), titles that contain another, one article a deal of a firm; 17 the scrub; 18 personnel news
  left in relevant moves to people; 19 data centres again. Places: by deal score, then date; people in their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import jaccard
from quillstream.operators.dedup import linked_classes, similar_pairs
from quillstream.operators.editions import clashing, class_name
from quillstream.operators.rounds import dropped_by_classes, dropped_by_pairs, first_without_conflict, written

SECTIONS = ["relevant", "transactions", "availabilities", "people"]
FACTS = [
    "id", "ord", "ts", "section", "passes", "in_region", "not_excluded", "described_ok", "political", "to_people", "routable", "rescued", "centre", "score", "deal_score", "gate_ok", "scrub_ok", "sigs",
    "entity", "sf", "price", "title_key", "words", "name_facts", "preferred",
]


@dataclass(frozen=True)
class Limits:
    """Floors, caps and windows of an edition."""

    floors: dict[str, int] = field(default_factory=lambda: {"relevant": 4, "transactions": 4, "availabilities": 1, "people": 2})
    caps: dict[str, int] = field(default_factory=lambda: {"relevant": 10, "transactions": 10, "availabilities": 3, "people": 10})
    least_total: int = 10
    narrow: int = 24
    wide: int = 48
    monday: int = 72
    days: int = 30


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _by_section(values: dict[str, int], section: str = "section") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col(section)), F.lit(0))


def _priority(order: list[str]) -> Column:
    return _by_section({s: k for k, s in enumerate(order)})


def _unused(rows: DataFrame, *used: DataFrame) -> DataFrame:
    for u in used:
        rows = rows.join(u.select("key").distinct(), "key", "left_anti")
    return rows


def _counts(chosen: DataFrame, editions: DataFrame) -> DataFrame:
    """(edition, section, n) of every section of every edition."""
    every = editions.select("edition", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    return every.join(chosen.groupBy("edition", "section").agg(F.count(F.lit(1)).alias("n")), ["edition", "section"], "left").select("edition", "section", F.coalesce("n", F.lit(0)).alias("n"))


def _first(rows: DataFrame, need: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each section of an edition, as many as ``need`` (edition, section, need) says; ``most`` is its largest."""
    ranked = rows.join(need.where("need > 0"), ["edition", "section"]).withColumn("_k", F.row_number().over(Window.partitionBy("edition", "section").orderBy(*order)))
    return ranked.where(F.col("_k") <= most).where("_k <= need").drop("_k", "need")


def _added(chosen: DataFrame, more: DataFrame, stage: int, via: str) -> DataFrame:
    return chosen.unionByName(more.withColumns({"stage": F.lit(stage), "via": F.lit(via)}).select(*chosen.columns))


def near_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) keys of near titles within a section of an edition: three fifths of the longer words, no conflict of names."""
    tied = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat_ws("\x1f", F.col("edition"), F.col("section"), w))
    said = rows.select("key", tied.alias("tied"), "name_facts")
    side = lambda s: rows.select(F.col("key").alias(s), F.col("name_facts").alias(f"f_{s}"))
    met = similar_pairs(said, "key", "tied").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.where(~F.coalesce(clashing("f_a", "f_b"), F.lit(False))).select("a", "b")


def near_dropped(rows: DataFrame, place: Column, rank: Column) -> DataFrame:
    """Keys (gone) that go when, in order, of each pair of :func:`near_pairs` the later one goes, or the earlier if it is worse."""
    words = F.array_sort(F.coalesce("words", F.array().cast("array<string>")))
    told = rows.where(F.size("words") > 0).select("key", place.alias("place"), rank.alias("rank"), F.concat_ws("\x1f", "edition", "section").alias("within"), words.alias("words"), F.col("name_facts").alias("facts"))
    told = written(told.withColumn("class", class_name()))
    return dropped_by_classes(told, linked_classes(told.groupBy("class").agg(*(F.first(c).alias(c) for c in ("within", "words", "facts"))), clashing))


def first_unlike(free: DataFrame, there: DataFrame, need: DataFrame, most: int) -> DataFrame:
    """The first rows of ``free`` in each section of an edition (by stage, then newest), ``need`` of them, that are near
    neither to a row ``there`` nor to each other.

    Of rows of the same words and facts the first stands for all: what a row before is near to is near to all of them.
    Each turn takes the first row left of every section and drops what is near it, so rows meet one row a turn.
    """
    group, place = ["edition", "section"], F.struct("stage", (-F.unix_micros("ts")).alias("at"), "ord", "key")
    rows = free.select(*group, place.alias("place"), F.array_sort(F.coalesce("words", F.array().cast("array<string>"))).alias("words"), F.col("name_facts").alias("facts"))
    told = F.size("words") > 0
    bare = rows.where(~told).withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("place"))).where(F.col("_k") <= most).drop("_k")
    left = rows.where(told).groupBy(*group, "words", "facts").agg(F.min("place").alias("place")).select(*rows.columns).unionByName(bare)

    def unlike(open_: DataFrame, seen: DataFrame) -> DataFrame:
        a, b = open_.alias("a"), seen.select(*group, F.col("words").alias("w"), F.col("facts").alias("f"), F.col("place").alias("p")).alias("b")
        near = F.coalesce(jaccard(F.col("words"), F.col("w")) >= 0.6, F.lit(False)) & ~F.coalesce(clashing("facts", "f"), F.lit(False))
        same = (F.col("a.edition") == F.col("b.edition")) & (F.col("a.section") == F.col("b.section"))
        return a.join(b, same & (near | (F.col("place") == F.col("p"))), "left_anti")

    left = written(unlike(left.join(need.select(*group), group, "left_semi"), there.select(*group, place.alias("place"), "words", F.col("name_facts").alias("facts"))))
    taken = []
    for k in range(most):
        wanted = need.where(F.col("need") > k).select(*group)
        heads = left.join(wanted, group, "left_semi").groupBy(*group).agg(F.min_by(F.struct("place", "words", "facts"), "place").alias("h"))
        heads = written(heads.select(*group, "h.*"))
        taken.append(heads.select(F.col("place.key").alias("key")))
        if k == most - 1 or not heads.head(1):
            break
        left = written(unlike(left, heads))
    keys = taken[0]
    for t in taken[1:]:
        keys = keys.unionByName(t)
    return free.join(keys, "key", "left_semi")


def _placed_pairs(pairs: DataFrame, rows: DataFrame, place: Column, better: Column | None) -> DataFrame:
    """Pairs for :func:`dropped_by_pairs`: in order of both rows' places, the later one loses unless it is better."""
    of = rows.select("key", place.alias("at"), (F.lit(0) if better is None else better).alias("rank"))
    side = lambda s: of.select(F.col("key").alias(s), F.struct(F.col("at"), F.col("key").alias("k")).alias(f"at_{s}"), F.col("rank").alias(f"rank_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    first = F.col("at_a") < F.col("at_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    x, y = pick("a", "b"), pick("b", "a")
    loser = F.when(pick("rank_b", "rank_a") > pick("rank_a", "rank_b"), x).otherwise(y)
    return both.select(F.struct(pick("at_a", "at_b").alias("i"), pick("at_b", "at_a").alias("j")).alias("place"), x.alias("x"), y.alias("y"), loser.alias("loser"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("gone").alias("key")), "key", "left_anti")


def one_a_signature(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of which no signature belongs to a row kept before in the edition; sections in ``order``, others pass."""
    there = rows.where(F.col("section").isin(order))
    tied = F.transform(F.coalesce("sigs", F.array().cast("array<string>")), lambda s: F.concat_ws("\x1f", F.col("edition"), s))
    ranked = there.withColumn("_place", F.struct(_priority(order), "stage", -F.unix_micros("ts"), "ord"))
    kept = first_without_conflict(ranked, "key", "_place", tied).select("key")
    return there.join(kept, "key", "left_semi").unionByName(rows.where(~F.col("section").isin(order)))


def one_an_equal_title(rows: DataFrame) -> DataFrame:
    """The last row of the first section that has a title; rows without one pass."""
    w = Window.partitionBy("edition", "title_key").orderBy(_priority(["transactions", "relevant", "availabilities", "people"]), F.desc("stage"), F.col("ts"), F.desc("ord"))
    told = F.coalesce(F.col("title_key"), F.lit("")) != ""
    return rows.where(told).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").unionByName(rows.where(~told))


def without_contained_titles(rows: DataFrame) -> DataFrame:
    """Of two titles of over 20 characters of which one contains the other, the one met first stays, each section from its end.

    For capped editions: pairs are made within an edition, which holds a few dozen rows.
    """
    side = lambda s: rows.select("edition", F.col("key").alias(s), F.col("title_key").alias(f"t_{s}")).where(F.length(f"t_{s}") > 20)
    pairs = side("a").join(side("b"), "edition").where((F.col("a") < F.col("b")) & (F.contains("t_a", "t_b") | F.contains("t_b", "t_a"))).select("a", "b")
    place = F.struct(_priority(["transactions", "relevant", "availabilities", "people"]), -F.col("stage"), F.unix_micros("ts"), -F.col("ord"))
    return _without(rows, dropped_by_pairs(_placed_pairs(pairs, rows, place, None)))


def one_a_deal(rows: DataFrame) -> DataFrame:
    """Of rows with one entity key in an edition whose sizes and prices don't differ, the first stays."""
    side = lambda s: rows.where(F.col("entity").isNotNull()).select("edition", "entity", F.col("key").alias(s), F.col("sf").alias(f"sf_{s}"), F.col("price").alias(f"price_{s}"))
    agree = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(True))
    pairs = side("a").join(side("b"), ["edition", "entity"]).where((F.col("a") < F.col("b")) & agree("sf") & agree("price")).select("a", "b")
    place = F.struct(_priority(["transactions", "availabilities", "relevant", "people"]), F.col("stage"), -F.unix_micros("ts"), F.col("ord"))
    return _without(rows, dropped_by_pairs(_placed_pairs(pairs, rows, place, None)))


def centre_policy(rows: DataFrame) -> DataFrame:
    """Rejected data centres go; exceptions stay in relevant alone, the best one of an edition, with ``last`` set."""
    left = rows.where((F.coalesce("centre", F.lit("ok")) == "ok") | ((F.col("centre") == "exception") & (F.col("section") == "relevant"))).drop("last")
    exception = F.coalesce(F.col("centre") == "exception", F.lit(False))
    best = Window.partitionBy("edition").orderBy(F.desc("score"), "stage", F.desc("ts"), "ord")
    kept = left.where(exception).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").withColumn("last", F.lit(True))
    return left.where(~exception).withColumn("last", F.lit(False)).unionByName(kept)


def assembled(editions: DataFrame, facts: DataFrame, reserve: DataFrame, includes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(edition, section, place, id, via) of every edition (edition, as_of).

    ``reserve``: facts with rank, some dozens a section, the same for all editions. ``includes``: facts with edition.
    """
    rules = limits or Limits()
    editions = editions.select(F.col("edition").cast("string").alias("edition"), "as_of")
    key = F.concat_ws("\x1f", F.col("edition"), F.col("id").cast("string"))
    days = editions.withColumn("day", F.explode(F.sequence(F.to_date(F.col("as_of") - F.expr(f"INTERVAL {rules.days} DAYS")), F.to_date("as_of"))))
    met = facts.select(*FACTS).withColumn("day", F.to_date("ts")).join(days, "day").where((F.col("ts") <= F.col("as_of")) & (F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {rules.days} DAYS"))).drop("day")
    age = (F.unix_micros("as_of") - F.unix_micros("ts")) / 3_600_000_000
    regional = F.when(F.col("section") == "relevant", _yes("not_excluded")).otherwise(_yes("in_region"))
    pool = met.withColumns({"key": key, "age": age, "fits": _yes("passes") & regional})
    fresh = lambda s: F.count_if((F.col("section") == s) & _yes("passes") & _yes("in_region") & (F.col("age") <= rules.narrow)) >= rules.floors[s]
    widest = F.when(F.dayofweek("as_of") == 2, rules.monday).otherwise(rules.wide)
    hours = pool.groupBy("edition", "as_of").agg((fresh("relevant") & fresh("transactions")).alias("enough")).select("edition", F.when(F.col("enough"), rules.narrow).otherwise(widest).alias("hours"))
    pool = written(pool.join(hours, "edition"))
    newest = [F.desc("ts"), F.col("ord")]
    columns = ["edition", "key", *FACTS]

    # 2, 3, 4
    moves = _yes("to_people") & F.col("section").isin("relevant", "transactions")
    base = pool.where(F.col("fits") & (F.col("age") <= F.col("hours")))
    base = written(base.select("edition", "key", *(c for c in FACTS if c != "section"), F.when(moves, "people").otherwise(F.col("section")).alias("section"), moves.cast("int").alias("stage"), F.lit("window").alias("via")).select(*columns, "stage", "via"))
    rank = F.struct(_yes("preferred").cast("int"), F.length(F.coalesce("title_key", F.lit(""))))
    suppressed = written(near_dropped(base, F.struct(F.col("stage"), -F.unix_micros("ts"), F.col("ord"), F.col("key")), rank).select(F.col("gone").alias("key")))
    chosen = _unused(base, suppressed)

    # 5, 6
    need = _counts(chosen, editions).select("edition", "section", (_by_section(rules.floors) - F.col("n")).alias("need"))
    deep = _first(_unused(pool.where("fits"), chosen, suppressed), need, newest, max(rules.floors.values()))
    chosen = written(_added(chosen, deep, 2, "deep"))
    room = _counts(chosen, editions).where("section = 'relevant'").select("edition", "section", (F.lit(rules.caps["relevant"]) - F.col("n")).alias("need"))
    deals = _unused(pool.where((F.col("section") == "transactions") & _yes("routable")), chosen, suppressed).withColumn("section", F.lit("relevant"))
    chosen = written(_added(chosen, _first(deals, room, newest, rules.caps["relevant"]), 3, "routed"))

    # 7, 8, 9
    stock = reserve.select(*FACTS, "rank")
    need = _counts(chosen, editions).select("edition", "section", (_by_section(rules.floors) - F.col("n")).alias("need")).where("need > 0")
    offered = lambda wanted: _unused(wanted.select("edition", "section").join(stock, "section").withColumn("key", key), chosen)
    chosen = written(_added(chosen, _first(offered(need), need, [F.col("rank"), F.col("id")], max(rules.floors.values())), 4, "reserve"))
    counts = _counts(chosen, editions)
    total = counts.groupBy("edition").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("section") == "relevant", F.col("n"))).alias("relevant"))
    thin = total.select("edition", F.lit("relevant").alias("section"), F.least(F.lit(rules.least_total) - F.col("total"), F.lit(rules.caps["relevant"]) - F.col("relevant")).alias("need")).where("need > 0")
    chosen = written(_added(chosen, _first(offered(thin), thin, [F.col("rank"), F.col("id")], rules.least_total), 5, "thin"))
    asked = includes.withColumn("edition", F.col("edition").cast("string")).withColumn("key", key).where((_yes("in_region") | _yes("not_excluded")) & ~_yes("political"))
    asked = asked.dropDuplicates(["key"]).withColumn("section", F.when(F.col("section").isin(*SECTIONS), F.col("section")).otherwise("relevant"))
    chosen = written(_added(chosen, _unused(asked.join(editions.select("edition"), "edition", "left_semi"), chosen).select(*columns), 6, "include"))

    # 10 to 14
    chosen = one_an_equal_title(one_a_signature(chosen, ["transactions", "availabilities", "relevant"]))
    ranked = centre_policy(chosen).withColumn("_k", F.row_number().over(Window.partitionBy("edition", "section").orderBy("last", F.desc("score"), "stage", *newest)))
    capped = ranked.where(F.col("_k") <= max(rules.caps.values())).where(F.col("_k") <= _by_section(rules.caps)).drop("_k", "last")
    chosen = written(capped.where(_yes("gate_ok") & _yes("described_ok")))

    # 15: near titles of rows before go, so the first that are left fill the floor
    need = _counts(chosen, editions).select("edition", "section", (_by_section(rules.floors) - F.col("n")).alias("need")).where("need > 0")
    free = _unused(pool.where(F.col("fits") & _yes("gate_ok") & _yes("described_ok") & (F.coalesce("centre", F.lit("ok")) != "reject")), chosen, suppressed)
    free = free.where((F.coalesce("centre", F.lit("ok")) != "exception") | (F.col("section") == "relevant")).join(need.select("edition", "section"), ["edition", "section"], "left_semi")
    free = free.select(*columns, F.when(F.col("age") <= F.col("hours"), 7).otherwise(8).alias("stage"), F.lit("refill").alias("via"))
    need, free = written(need), written(free)
    there = written(chosen.join(need.select("edition", "section"), ["edition", "section"], "left_semi"))
    behind = dropped_by_pairs(_placed_pairs(near_pairs(there), there, F.struct(F.col("stage"), -F.unix_micros("ts"), F.col("ord")), None))
    refill = first_unlike(free, _without(there, behind), need, max(rules.floors.values()))
    chosen = written(chosen.unionByName(refill.select(*chosen.columns)))

    # 16 to 19
    chosen = written(without_contained_titles(one_an_equal_title(one_a_signature(chosen, ["relevant", "transactions", "availabilities"]))))
    chosen = one_a_deal(chosen).where(_yes("scrub_ok"))
    late = _yes("rescued") & (F.col("section") == "relevant")
    chosen = chosen.withColumns({"via": F.when(late, "rescued").otherwise(F.col("via")), "stage": F.when(late, 9).otherwise(F.col("stage")), "section": F.when(late, "people").otherwise(F.col("section"))})
    dealt = F.when(F.col("section") == "people", 0).otherwise(-F.coalesce("deal_score", F.lit(0)))
    order = Window.partitionBy("edition", "section").orderBy("last", dealt, F.when(F.col("section") == "people", F.col("stage")).otherwise(0), F.desc("ts"), "stage", "ord")
    return centre_policy(chosen).select("edition", "section", F.row_number().over(order).alias("place"), "id", "via")


def week_in_review(assembled_: DataFrame, editions: DataFrame, facts: DataFrame, days: int = 7, most: int = 5) -> DataFrame:
    """(edition, place, id): the best articles of the week of an edition that tell nothing that the edition tells.

    By score; an article goes if the edition has it, one of its signatures, or its deal of a firm, or a better one of the week
    has. Articles of a section that passed their gates take part.
    """
    editions = editions.select(F.col("edition").cast("string").alias("edition"), "as_of")
    key = F.concat_ws("\x1f", F.col("edition"), F.col("id").cast("string"))
    days_ = editions.withColumn("day", F.explode(F.sequence(F.to_date(F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")), F.to_date("as_of"))))
    good = facts.where(F.col("section").isin(*SECTIONS) & _yes("passes") & _yes("gate_ok") & _yes("scrub_ok"))
    week = good.withColumn("day", F.to_date("ts")).join(days_, "day").where((F.col("ts") <= F.col("as_of")) & (F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))).withColumn("key", key)
    held = assembled_.select("edition", "id").distinct().join(facts, "id").withColumn("key", key)
    line = held.select("edition", "key", "id", "score", "ts", "ord", "sigs", "entity", "sf", "price", F.lit(0).alias("turn")).unionByName(
        _unused(week, held).select("edition", "key", "id", "score", "ts", "ord", "sigs", "entity", "sf", "price", F.lit(1).alias("turn"))
    )
    line = written(line)
    place = F.struct("turn", F.when(F.col("turn") == 1, -F.col("score")).otherwise(0.0).alias("by"), (-F.unix_micros("ts")).alias("at"), "ord")
    # the edition's own rows stay whatever they share; of the week a row stays if none before it has a signature of it
    tied = F.transform(F.coalesce("sigs", F.array().cast("array<string>")), lambda s: F.concat_ws("\x1f", F.col("edition"), s))
    told = line.where("turn = 0").select(F.explode(tied).alias("sig")).distinct()
    hit = line.where("turn = 1").select("key", F.explode(tied).alias("sig")).join(told, "sig", "left_semi").select("key").distinct()
    left = line.join(hit, "key", "left_anti")
    kept = first_without_conflict(left.where("turn = 1").withColumn("_place", place), "key", "_place", tied).select("key")
    left = written(left.where("turn = 0").unionByName(left.where("turn = 1").join(kept, "key", "left_semi")))
    # of the week's rows of one deal the first stands for all: who agrees with one agrees with the others
    same = ["edition", "entity", "sf", "price"]
    firsts = left.where("turn = 1 AND entity IS NOT NULL").groupBy(*same).agg(F.min(F.struct(place.alias("at"), "key")).alias("first")).select("first.key")
    left = written(left.where("turn = 0 OR entity IS NULL").unionByName(left.join(firsts, "key", "left_semi")))
    side = lambda s: left.where("entity IS NOT NULL").select("edition", "entity", F.col("key").alias(s), F.col("turn").alias(f"turn_{s}"), F.col("sf").alias(f"sf_{s}"), F.col("price").alias(f"price_{s}"))
    agree = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(True))
    pairs = side("a").join(side("b"), ["edition", "entity"]).where((F.col("a") < F.col("b")) & (F.greatest("turn_a", "turn_b") == 1) & agree("sf") & agree("price")).select("a", "b")
    left = _without(left, dropped_by_pairs(_placed_pairs(pairs, left, place, None))).where("turn = 1")
    best = Window.partitionBy("edition").orderBy(F.desc("score"), F.desc("ts"), "ord")
    return left.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("edition", "place", "id")
