"""Breakers and caches as streams, batch by batch, against plain folds."""

from datetime import datetime, timedelta

import pytest

from quillstream.streaming import breaker

START = datetime(2024, 1, 1)
H = timedelta(hours=1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", breaker.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, schema, batches, events):
    """What ``events`` gives after each batch of rows has been handled."""
    (folder / "in").mkdir()
    stream, query, name = spark.readStream.schema(schema).parquet(str(folder / "in")), None, f"out_{folder.name}".replace("-", "_")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if query is None:
            query = events(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "check")).start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_breaker(rocks, tmp_path):
    at = lambda h: START + h * H
    batches = [
        [("a", at(0), False, 500, None), ("b", at(0), True, 200, False), ("c", at(0), True, 200, True), ("d", at(0), None, None, None), ("e", None, True, 200, None)],
        [("a", at(0.2), False, 500, None), ("a", at(1), False, None, False), ("b", at(1), False, 403, None), ("d", at(0.9), True, 200, None), ("a", at(0.5), True, 200, None)],
        [("a", at(2.5), False, 500, None), ("a", at(1.9), False, 500, None), ("b", at(2), True, 200, None)],  # 1.9 is before 2.5 of the same batch
        [("a", at(2.2), False, 500, None), ("z", at(30), True, 200, None)],  # 2.2 comes after 2.5 was handled
        [("z", at(31), True, 200, None)],  # the watermark is now past the blocks
        [("a", at(40), False, 500, None), ("b", at(40), True, 200, None), ("b", at(3), False, 500, None)],  # 3 is far too late and dropped
        [("z", at(24 * 40), True, 200, None)],
        [("z", at(24 * 40 + 3), True, 200, None)],
    ]
    got = streamed(rocks, tmp_path, "feed string, ts timestamp, ok boolean, status int, html boolean", batches, breaker.breaker_events)
    told = lambda f: [(round((r.ts - START) / H, 2), r.what, r.failures) for r in got if r.feed == f]
    assert told("a")[:6] == [(0, "resting", 1), (0.2, "skipped", 1), (0.5, "ok", 0), (1, "resting", 1), (1.9, "resting", 2), (2.5, "skipped", 2)]
    assert (2.2, "late", 2) in told("a") and (2.9, "open", 2) in told("a")
    assert (40, "blocked", 3) in told("a") and (64, "open", 3) in told("a")
    assert told("b")[:3] == [(0, "ok", 0), (1, "blocked_at_once", 3), (2, "skipped", 3)] and (25, "open", 3) in told("b") and (40, "ok", 0) in told("b")
    assert not any(h == 3 for h, _, _ in told("b"))
    assert told("c")[:2] == [(0, "blocked_at_once", 3), (24, "open", 3)]
    assert told("d")[:2] == [(0, "resting", 1), (0.9, "ok", 0)] and not told("e")
    assert {f for f in "abcd" if any(w == "forgotten" for _, w, _ in told(f))} == {"a", "b", "c", "d"}  # no outcome for thirty days


def test_cache(rocks, tmp_path):
    at = lambda h: START + h * H
    ttl = 4 * 3_600_000
    many = [("busy", f"u{k}", at(1 + k / 100), ttl) for k in range(22)]
    batches = [
        [("x", "u", at(0), ttl), ("x", "u", at(1), ttl), ("x", "v", at(1), None), *many],
        [("x", "u", at(3.9), ttl), ("x", "u", at(4), ttl), ("busy", "u3", at(2), ttl), ("x", "w", at(0.5), ttl), (None, "n", at(2), ttl)],
        [("y", "u", at(9), ttl)],
        [("y", "u", at(9.5), ttl), ("busy", "u21", at(25), ttl), ("x", "u", at(12), ttl)],
        [("y", "u", at(40), ttl)],
        [("y", "u", at(41), ttl)],
    ]
    got = streamed(rocks, tmp_path, "domain string, url string, ts timestamp, ttl_ms long", batches, breaker.cache_events)
    told = lambda d, u: [(round((r.ts - START) / H, 2), r.what) for r in got if r.domain == d and r.url == u]
    assert told("x", "u")[:4] == [(0, "fetched"), (1, "hit"), (3.9, "hit"), (4, "fetched")]
    assert (8, "expired") in told("x", "u") and (12, "fetched") in told("x", "u")
    assert told("x", "w") == [(0.5, "late")] and told("x", "v")[0] == (1, "fetched")
    what = [told("busy", f"u{k}")[0][1] for k in range(22)]
    assert what == ["fetched"] * 20 + ["refused"] * 2 and (2, "hit") in told("busy", "u3")
    assert (25, "fetched") in told("busy", "u21")  # another day
    assert told(None, "n")[0] == (2, "fetched") and told("y", "u")[:2] == [(9, "fetched"), (9.5, "hit")]
