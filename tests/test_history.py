"""Intervals against the snapshots that they stand for, and traces against separate aggregates."""

import random

from pyspark.sql import functions as F

from quillstream.operators import history
from quillstream.plans import history_queries

SF = "/root/testdata/sf0.001"


def test_any_run_comes_back_and_storage_follows_changes(spark):
    rng = random.Random(4)
    state, rows = {k: "a" for k in range(30)}, []
    for run in range(0, 60, 2):
        for k in list(state):
            if rng.random() < 0.05:
                state[k] = rng.choice(["a", "b", None])
            if rng.random() < 0.03:
                del state[k]
        if rng.random() < 0.3:
            state[100 + run] = "new"
        rows += [(run, k, v, [v, "x"]) for k, v in state.items()]
    df = spark.createDataFrame(rows, "run int, id int, v string, more array<string>").repartition(4)
    held = history.intervals(df, "run", "id").cache()
    for run in range(0, 60, 2):
        assert sorted(map(str, history.as_of_run(held, F.lit(run)).collect())) == sorted(map(str, df.where(F.col("run") == run).drop("run").collect()))
    changes = sum(1 for i, (run, k, v, _) in enumerate(rows) if (run - 2, k, v) not in {(r, j, w) for r, j, w, _ in rows})
    assert held.count() == changes < len(rows) / 3
    asked = spark.createDataFrame([(4, 1, "q"), (5, 1, "q"), (4, 999, "q")], "run int, id int, q string")
    met = history.joined_at_run(asked, "run", "id", held).collect()
    assert [(r.run, r.id) for r in met if r.run == 4] == [(4, 1)] and not any(r.id == 999 for r in met)
    odd = spark.createDataFrame([(None, 1, "x"), (1, None, "x"), (1, 1, "b"), (1, 1, "a")], "run int, id int, v string")
    assert [tuple(r) for r in history.intervals(odd, "run", "id").collect()] == [(1, 1, 1, "a")]
    assert history.intervals(df.limit(0), "run", "id").count() == 0


def test_trace_counts_like_separate_aggregates_in_one_job(spark):
    trace = history_queries.traced(spark, SF)
    rows = trace.observed()
    tracker, group = spark.sparkContext.statusTracker(), "trace-job"
    spark.sparkContext.setJobGroup(group, "one pass")
    events = trace.events(rows, "ord").collect()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("after", "others")
    counts = trace.counts
    assert jobs == 1
    for stage in trace.stages:
        assert counts[stage] == sum(e.stage == stage for e in events) > 0
    assert counts["rows"] == len({e.ord for e in events})
    assert counts["left"] == sum(e.stage == "recent" and int(e.verdict) >= 1996 for e in events)
    by = {}
    for e in events:
        by.setdefault(e.ord, []).append(e.place)
    assert all(places == list(range(len(places))) for places in map(sorted, by.values()))


def test_changes_between_stages(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(map(tuple, history.changed_between(a, b, "id").collect())) == [(1, "dropped"), (3, "added")]
