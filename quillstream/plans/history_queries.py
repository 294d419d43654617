"""Queries of histories and traces, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import history, sections
from quillstream.plans.gate_queries import _VERDICTS, _verdicts

SQL: dict[str, str] = {}
QUERIES = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's run knows of a user: the kind of the day's last event and whether it had a value over 50."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = F.max_by(F.struct("event_type", (F.coalesce("value", F.lit(0)) > 50).alias("high")), F.struct("ts", "event_id"))
    return events.groupBy(F.to_date("ts").alias("run"), F.pmod("user_id", F.lit(97)).alias("user")).agg(last.alias("l")).select("run", "user", "l.event_type", "l.high")


_SNAPSHOTS = """r AS (SELECT CAST(ts AS DATE) AS run, user_id % 97 AS user, event_type, coalesce(value, 0) > 50 AS high, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 97 ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT run, user, event_type, high FROM r WHERE k = 1), n AS (SELECT run, row_number() OVER (ORDER BY run) AS no FROM (SELECT DISTINCT run FROM s))"""
_INTERVALS = f"""WITH {_SNAPSHOTS},
m AS (SELECT s.*, no, CASE WHEN lag(no) OVER w = no - 1 AND lag(event_type) OVER w = event_type AND lag(high) OVER w = high THEN 0 ELSE 1 END AS fresh FROM s JOIN n USING (run) WINDOW w AS (PARTITION BY user ORDER BY no)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user ORDER BY no) AS island FROM m),
h AS (SELECT user, min(run) AS from_run, max(run) AS to_run, min(event_type) AS event_type, bool_or(high) AS high FROM i GROUP BY user, island)"""


@_query(f"{_INTERVALS} SELECT user, from_run, to_run, event_type, high FROM h")
def history_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of users as intervals in which nothing changed."""
    return history.intervals(_days(spark, sf_dir), "run", "user")


@_query(f"""{_INTERVALS}, p AS (SELECT DISTINCT CAST(ts AS DATE) AS run, user_id % 97 AS user FROM events WHERE event_type = 'purchase')
SELECT p.run, p.user, event_type, high FROM p JOIN s USING (run, user)""")
def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run of a purchase's day knew of the user, from the intervals; the SQL reads the snapshots."""
    bought = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.to_date("ts").alias("run"), F.pmod("user_id", F.lit(97)).alias("user")).distinct()
    return history.joined_at_run(bought, "run", "user", history.intervals(_days(spark, sf_dir), "run", "user"))


def traced(spark: SparkSession, sf_dir: str) -> history.Trace:
    """The stages of relevant articles: the region, the section's filter, a date."""
    rows = _verdicts(spark, sf_dir)
    trace = history.Trace(rows, "relevant")
    trace.stage("region", F.when(F.col("in_region"), "in").otherwise("out"), F.col("in_region"))
    trace.stage("filter", F.col("relevant"), F.col("relevant").startswith(sections.ACCEPTED))
    return trace.stage("recent", F.year("pub_ts"), F.year("pub_ts") >= 1996)


@_query(f"""WITH {_VERDICTS}, x AS (SELECT v.*, p.in_region, year(p.pub_ts) AS y FROM verdicts v JOIN placed p USING (ord)),
a AS (SELECT ord, 0 AS place, 'region' AS stage, CASE WHEN in_region THEN 'in' ELSE 'out' END AS verdict FROM x),
b AS (SELECT ord, 1 AS place, 'filter' AS stage, relevant AS verdict FROM x WHERE in_region),
c AS (SELECT ord, 2 AS place, 'recent' AS stage, CAST(y AS VARCHAR) AS verdict FROM x WHERE in_region AND starts_with(relevant, 'ACCEPTED'))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def run_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article's way through the stages, in order of occurrence, in one pass."""
    trace = traced(spark, sf_dir)
    return trace.events(trace.observed(), "ord")
