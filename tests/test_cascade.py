"""The cascade against a plain one that assembles one edition after the other with lists and sets."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillstream.operators import cascade
from quillstream.operators.cascade import Limits

SCHEMA = (
    "id long, ord int, ts timestamp, section string, passes boolean, in_region boolean, not_excluded boolean, described_ok boolean, political boolean, to_people boolean, routable boolean, rescued boolean, centre string, "
    "score double, deal_score int, gate_ok boolean, scrub_ok boolean, sigs array<string>, entity string, sf int, price int, title_key string, words array<string>, name_facts array<array<string>>, preferred boolean"
)
NAMES = [p.split()[0] for p in SCHEMA.split(", ")]
START = datetime(2024, 1, 1)


def article(rng, k, days=40):
    maybe = lambda p: rng.choices([True, False, None], [p, 1 - p, 0.03])[0]
    topic = rng.randint(0, 40)
    title = None if rng.random() < 0.03 else f"story of the {topic} halls and yards" + rng.choice(["", " of the far north", " again"])
    words = [f"word{topic}", f"hall{topic}", f"yard{topic}"] + [f"more{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]
    return (
        k, k, START + timedelta(hours=rng.randint(0, days * 24)), rng.choice(["relevant", "relevant", "transactions", "availabilities", "people", "exclude"]), maybe(0.7), maybe(0.5), maybe(0.7), maybe(0.9), maybe(0.1), maybe(0.15),
        maybe(0.3), maybe(0.1), rng.choices(["ok", "exception", "reject", None], [8, 1, 1, 1])[0], float(rng.randint(0, 9)), rng.randint(0, 6), maybe(0.9), maybe(0.9),
        None if rng.random() < 0.3 else [f"s{rng.randint(0, 60)}" for _ in range(rng.randint(0, 2))], rng.choice([None, "e1", "e2", "e3"]), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]),
        title, None if rng.random() < 0.1 else sorted(set(words)), [rng.choice([[], ["newark"], ["tampa"]]), []], maybe(0.2),
    )


def plain(as_of, articles, reserve, includes, rules):
    """One edition, told step by step."""
    rows = [dict(zip(NAMES, a, strict=True)) for a in articles]
    pool = [r for r in rows if as_of - timedelta(days=rules.days) <= r["ts"] <= as_of]
    for r in pool:
        r["age"] = (as_of - r["ts"]).total_seconds() / 3600
        r["fits"] = bool(r["passes"] and (r["not_excluded"] if r["section"] == "relevant" else r["in_region"]))
    newest = lambda r: (-r["ts"].timestamp(), r["ord"])
    pool.sort(key=newest)
    fresh = lambda s: sum(bool(r["section"] == s and r["passes"] and r["in_region"] and r["age"] <= rules.narrow) for r in pool)
    wide = rules.monday if as_of.weekday() == 0 else rules.wide
    hours = rules.narrow if all(fresh(s) >= rules.floors[s] for s in ("relevant", "transactions")) else wide
    lists = {s: [] for s in cascade.SECTIONS}

    def put(r, section, stage, via):
        lists[section].append(r | {"stage": stage, "via": via, "last": False})

    def alike(a, b):
        x, y = set(a["words"] or []), set(b["words"] or [])
        if not x or not y or len(x & y) < 0.6 * len(x | y):
            return False
        return not any(p and q and not set(p) & set(q) for p, q in zip(a["name_facts"], b["name_facts"], strict=True))

    window = [r for r in pool if r["fits"] and r["age"] <= hours]
    for r in window:
        if r["section"] in lists and not (r["to_people"] and r["section"] in ("relevant", "transactions")):
            put(r, r["section"], 0, "window")
    for r in window:
        if r["to_people"] and r["section"] in ("relevant", "transactions"):
            put(r, "people", 1, "window")
    suppressed = set()
    rank = lambda r: (bool(r["preferred"]), len(r["title_key"] or ""))
    for s, held in lists.items():
        gone = set()
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if a["id"] not in gone and b["id"] not in gone and alike(a, b):
                    gone.add(a["id"] if rank(b) > rank(a) else b["id"])
        lists[s] = [r for r in held if r["id"] not in gone]
        suppressed |= gone
    used = lambda: {r["id"] for held in lists.values() for r in held}

    def fill(section, rows, until, stage, via, section_of=None):
        for r in rows:
            if until():
                break
            if r["id"] not in used() | suppressed:
                put(r, section, stage, via)

    for s in lists:
        fill(s, [r for r in pool if r["fits"] and r["section"] == s], lambda s=s: len(lists[s]) >= rules.floors[s], 2, "deep")
    fill("relevant", [r for r in pool if r["section"] == "transactions" and r["routable"]], lambda: len(lists["relevant"]) >= rules.caps["relevant"], 3, "routed")
    stock = sorted((dict(zip([*NAMES, "rank"], r, strict=True)) for r in reserve), key=lambda r: (r["rank"], r["id"]))
    free, suppressed_before = [r for r in stock if r["id"] not in used()], suppressed
    suppressed = set()
    for s in lists:
        fill(s, [r for r in free if r["section"] == s], lambda s=s: len(lists[s]) >= rules.floors[s], 4, "reserve")
    count = lambda: sum(map(len, lists.values()))
    fill("relevant", [r for r in stock if r["section"] == "relevant"], lambda: count() >= rules.least_total or len(lists["relevant"]) >= rules.caps["relevant"], 5, "thin")
    before = used()
    for r in includes:
        r = dict(zip(NAMES, r, strict=True))
        if r["id"] not in before and (r["in_region"] or r["not_excluded"]) and not r["political"]:
            before.add(r["id"])
            put(r, r["section"] if r["section"] in lists else "relevant", 6, "include")
    suppressed = suppressed_before
    place = lambda r: (r["stage"], *newest(r))

    def signatures(order):
        seen = set()
        for s in order:
            kept = []
            for r in sorted(lists[s], key=place):
                if not seen & set(r["sigs"] or []):
                    seen.update(r["sigs"] or [])
                    kept.append(r)
            lists[s] = kept

    backwards = lambda s: sorted(lists[s], key=lambda r: (-r["stage"], r["ts"], -r["ord"]))

    def titles(same):
        seen = []
        for s in ("transactions", "relevant", "availabilities", "people"):
            kept = []
            for r in backwards(s):
                t = r["title_key"] or ""
                if not any(same(t, o) for o in seen):
                    kept.append(r)
                    seen.append(t)
            lists[s] = kept

    def centres():
        for s in lists:
            lists[s] = [r | {"last": False} for r in lists[s] if (r["centre"] or "ok") == "ok" or (r["centre"] == "exception" and s == "relevant")]
        odd = sorted((r for r in lists["relevant"] if r["centre"] == "exception"), key=lambda r: (-r["score"], *place(r)))
        lists["relevant"] = [r for r in lists["relevant"] if r["centre"] != "exception"] + [r | {"last": True} for r in odd[:1]]

    equal = lambda a, b: a != "" and a == b
    signatures(["transactions", "availabilities", "relevant"])
    titles(equal)
    centres()
    for s in lists:
        lists[s] = sorted(lists[s], key=lambda r: (r["last"], -r["score"], *place(r)))[: rules.caps[s]]
        lists[s] = [r for r in lists[s] if r["gate_ok"] and r["described_ok"]]
    for s in lists:
        if len(lists[s]) >= rules.floors[s]:
            continue
        line = sorted(lists[s], key=place)
        free = [r for r in pool if r["fits"] and r["section"] == s and r["gate_ok"] and r["described_ok"] and ((r["centre"] or "ok") == "ok" or (r["centre"] == "exception" and s == "relevant")) and r["id"] not in used() | suppressed]
        # near titles among what the section has count as well: the later of two gives way to no one here, but blocks none after it
        blocked, shown = set(), list(line)
        for i, a in enumerate(line):
            for b in line[i + 1 :]:
                if a["id"] not in blocked and b["id"] not in blocked and alike(a, b):
                    blocked.add(b["id"])
        shown = [r for r in line if r["id"] not in blocked]
        for r in sorted(free, key=lambda r: (r["age"] > hours, *newest(r))):
            if len(lists[s]) >= rules.floors[s]:
                break
            if not any(alike(o, r) for o in shown):
                put(r, s, 7 if r["age"] <= hours else 8, "refill")
                shown.append(r)
    signatures(["relevant", "transactions", "availabilities"])
    titles(equal)
    titles(lambda a, b: len(a) > 20 and len(b) > 20 and (a in b or b in a))
    seen = []
    for s in ("transactions", "availabilities", "relevant", "people"):
        kept = []
        for r in sorted(lists[s], key=place):
            same = lambda o, r=r: o["entity"] == r["entity"] and all(None in (o[c], r[c]) or o[c] == r[c] for c in ("sf", "price"))
            if r["entity"] is None or not any(map(same, seen)):
                kept.append(r)
                if r["entity"] is not None:
                    seen.append(r)
        lists[s] = [r for r in kept if r["scrub_ok"]]
    moved = [r | {"stage": 9, "via": "rescued"} for r in lists["relevant"] if r["rescued"]]
    lists["relevant"] = [r for r in lists["relevant"] if not r["rescued"]]
    lists["people"] += moved
    centres()
    out = []
    for s, held in lists.items():
        key = (lambda r: (r["last"], 0, r["stage"], *newest(r))) if s == "people" else (lambda r: (r["last"], -r["deal_score"], 0, -r["ts"].timestamp(), r["stage"], r["ord"]))
        out += [(s, k + 1, r["id"], r["via"]) for k, r in enumerate(sorted(held, key=key))]
    return out


def test_cascade_matches_a_plain_one(spark):
    rng = random.Random(6)
    articles = [article(rng, k) for k in range(420)]
    reserve = [(*article(rng, 1000 + k), k % 25) for k in range(40)]
    includes = {k: [article(rng, 2000 + 10 * k + j) for j in range(2)] for k in range(0, 24, 3)}
    editions = [(f"e{k}", START + timedelta(days=8 + k, hours=7)) for k in range(24)] + [("empty", START - timedelta(days=90))]
    rules = Limits(narrow=12, wide=20, monday=30)
    chosen = [(f"e{k}", *a) for k, rows in includes.items() for a in rows]
    facts = spark.createDataFrame(articles, SCHEMA).repartition(3)
    got = cascade.assembled(
        spark.createDataFrame(editions, "edition string, as_of timestamp"), facts, spark.createDataFrame(reserve, SCHEMA + ", rank int"), spark.createDataFrame(chosen, "edition string, " + SCHEMA), rules
    ).collect()
    want = [(name, *row) for k, (name, as_of) in enumerate(editions) for row in plain(as_of, articles, reserve, includes.get(k, []), rules)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.via for r in got} >= {"window", "deep", "routed", "reserve", "refill", "rescued", "include"}
    sizes = {}
    for r in got:
        sizes[r.edition, r.section] = sizes.get((r.edition, r.section), 0) + 1
    assert max(sizes.values()) <= 10 + 2 + 10  # a cap, includes and what moves at the end
    assert {r.edition for r in got if r.via == "thin"} or any(r.edition == "empty" for r in got)


def test_cascade_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    editions = spark.createDataFrame([("a", START)], "edition string, as_of timestamp")
    empty = cascade.assembled(editions, none, none.withColumn("rank", F.lit(1)), none.withColumn("edition", F.lit("a")))
    assert empty.collect() == []


def test_week_in_review(spark):
    rng = random.Random(12)
    articles = [article(rng, k, 20) for k in range(250)]
    editions = [(f"e{k}", START + timedelta(days=7 + k, hours=7)) for k in range(8)]
    held = [(f"e{k}", "relevant", j + 1, i, "window") for k in range(8) for j, i in enumerate(rng.sample(range(250), 6))]
    facts = spark.createDataFrame(articles, SCHEMA)
    got = cascade.week_in_review(spark.createDataFrame(held, "edition string, section string, place int, id long, via string"), spark.createDataFrame(editions, "edition string, as_of timestamp"), facts)
    rows, want = {a[0]: dict(zip(NAMES, a, strict=True)) for a in articles}, []
    for name, as_of in editions:
        own = [rows[h[3]] for h in held if h[0] == name]
        sigs, deals = {s for r in own for s in r["sigs"] or []}, [r for r in own if r["entity"]]
        week = [r for r in rows.values() if as_of - timedelta(days=7) <= r["ts"] <= as_of and r["section"] in cascade.SECTIONS and r["passes"] and r["gate_ok"] and r["scrub_ok"] and r not in own]
        week.sort(key=lambda r: (-r["score"], -r["ts"].timestamp(), r["ord"]))
        free = []
        for r in week:  # signatures first, then deals, as two passes
            if not sigs & set(r["sigs"] or []):
                sigs |= set(r["sigs"] or [])
                free.append(r)
        best = []
        for r in free:
            same = lambda o, r=r: o["entity"] == r["entity"] and all(None in (o[c], r[c]) or o[c] == r[c] for c in ("sf", "price"))
            if r["entity"] is None or not any(map(same, deals)):
                deals += [r] if r["entity"] else []
                best.append(r)
        want += [(name, k + 1, r["id"]) for k, r in enumerate(best[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_copies_of_a_title_make_no_pairs(spark, monkeypatch):
    """Copies are dropped by class: pairs are made of a few rows, whatever the number of copies."""
    made = []
    whole = cascade.similar_pairs
    from quillstream.operators import dedup

    monkeypatch.setattr(dedup, "similar_pairs", lambda df, *rest: made.append(df.count()) or whole(df, *rest))
    monkeypatch.setattr(cascade, "similar_pairs", lambda df, *rest: made.append(df.count()) or whole(df, *rest))
    rows = spark.range(4000).select(
        F.lit("e").alias("edition"), F.lit("relevant").alias("section"), F.concat(F.lit("k"), "id").alias("key"), F.lit(7).alias("stage"), (F.lit(START).cast("timestamp") - F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.col("id").alias("ord"),
        F.array(*(F.concat(F.lit(w), (F.col("id") % 5).cast("string")) for w in ("word", "hall", "yard"))).alias("words"), F.array(F.array().cast("array<string>")).alias("name_facts"),
    )
    gone = cascade.near_dropped(rows, F.struct("ord", "key"), F.struct(F.lit(0)))
    assert sorted(r.key for r in rows.join(gone, F.col("key") == F.col("gone"), "left_anti").collect()) == [f"k{k}" for k in range(5)]
    need = spark.createDataFrame([("e", "relevant", 3)], "edition string, section string, need int")
    there = rows.where("ord = 5").withColumn("stage", F.lit(0))
    assert sorted(r.key for r in cascade.first_unlike(rows, there, need, 4).collect()) == ["k1", "k2", "k3"]
    assert made and max(made) <= 5
