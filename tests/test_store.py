"""The growing store against one pass, and page links against a plain reading."""

import random
import re

from pyspark.sql import functions as F

from quillstream.operators import pages, store
from quillstream.operators.store import KeyIndex


def test_batches_in_turn_give_the_rows_of_one_pass(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    for cells in (1 << 20, 1):  # a filter of one word lets nearly every key through
        monkeypatch.setattr(store, "FILTER_CELLS", cells)
        rows = [(k, k // 30, [rng.choice([None, f"k{rng.randint(0, 250)}"]) for _ in range(rng.randint(0, 3))], "x") for k in range(300)]
        seen, want = set(), []
        for k, _, keys, _ in rows:
            mine = {x for x in keys if x}
            if not mine & seen:
                want.append(k)
                seen |= mine
        df = spark.createDataFrame(rows, "id int, batch int, keys array<string>, key string").repartition(3)
        index, got = KeyIndex(spark, str(tmp_path / f"index-{cells}")), []
        for b in range(10):
            new = index.admit(f"b{b}", df.where(F.col("batch") == b), "id", "id", F.col("keys"))
            assert new.columns == df.columns
            got += [r.id for r in new.collect()]
            if b == 4:  # a batch that is run again gives the same and registers once
                before = index.keys().count()
                assert sorted(r.id for r in index.admit("b4", df.where("batch = 4"), "id", "id", F.col("keys")).collect()) == sorted(k for k in got if k // 30 == 4)
                assert index.keys().count() == before
        assert sorted(got) == want
        assert sorted(r.key for r in index.keys().collect()) == sorted(seen)
        assert index.admit("none", df.limit(0), "id", "id", F.col("keys")).count() == 0


def test_filter_spares_the_index(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index"))
    df = spark.createDataFrame([(k, [f"k{k}"]) for k in range(200)], "id int, keys array<string>")
    index.admit("a", df, "id", "id", F.col("keys"))
    fresh = spark.createDataFrame([(f"new{k}",) for k in range(500)] + [("k7",)], "key string")
    maybe = {r.key for r in index.possible(fresh, "b").collect()}
    assert "k7" in maybe and len(maybe) < 20
    assert {(r.key, r.holder) for r in index.held(fresh, "b").collect()} == {("k7", "7")}


def test_repeats_over_sends(spark):
    rows = [(1, "a", ["x"]), (1, "b", ["x", "y"]), (2, "c", ["y", "z"]), (3, "d", ["z"]), (3, "e", []), (3, "f", None), (4, "g", ["w"])]
    got = store.repeats_over_sends(spark.createDataFrame(rows, "send int, item string, sigs array<string>"), "send", "item", "sigs").collect()
    assert {r.item for r in got if r.repeated} == {"c", "d"} and len(got) == 7


def plain_links(html, levels, reach, least):
    out, seen = [], set()
    for m in re.finditer(r'href="(https?://[^"]+)"', html or ""):
        if m[1] in seen:
            continue
        seen.add(m[1])
        near = html[max(0, m.start() - reach) : m.start() + reach]
        head = re.search(rf"<h[{levels}][^>]*>([^<]+)</h[{levels}]>", near)
        if head and len(head[1].strip(" ")) >= least:
            out.append((m.start(), m[1], head[1].strip(" ")))
    return out


def test_page_links(spark):
    rng = random.Random(3)
    bits = ['<a href="https://x.org/{0}">go</a>', "<h2 class='t'>A heading of story {0}</h2>", "<h3>short {0}</h3>", "<h2>open {0} <b>bold</b></h2>", "<p>" + "text " * 30 + "</p>", "<h4>Überschrift der Nummer {0}</h4>", '<a href="/local/{0}">', '<a href="https://x.org/cut']
    rows = [(k, "".join(rng.choice(bits).format(rng.randint(0, 12)) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(90, None), (91, ""), (92, "<h2")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id int, html string, char_at int, title int").repartition(3)
    for reach in (500, 120):
        got = sorted((r.page_id, r.char_at, r.link, r.title) for r in pages.page_links(df, "page_id", "html", reach=reach).collect())
        assert got == sorted((k, *x) for k, html in rows for x in plain_links(html, "234", reach, 16)) and got
    assert pages.page_links(df.limit(0), "page_id", "html").count() == 0
