"""History of a table that is taken again each run, and the trace of rows through the stages of one run.

Snapshots are folded into intervals of validity: a row of the history stands for as many runs as it did not change in, so the
history grows with changes, not with runs. A join at a point in time gives back any run. A trace is a column that stages
append to, so that funnel and trace of a run come from the one pass that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def numbered_runs(snapshots: DataFrame, run: str) -> DataFrame:
    """(run, no): runs in order; there are as many rows as runs."""
    return snapshots.select(run).distinct().withColumn("no", F.row_number().over(Window.orderBy(run)))


def intervals(snapshots: DataFrame, run: str, key: str) -> DataFrame:
    """The rows of all snapshots with from_run and to_run in place of ``run``: as long as a key's row stays as it is.

    A key that is missing in a run ends its interval there. Of several rows of a key in a run the least counts; rows without a
    key or a run are left out. Arrays, structs and plain columns are compared by value, nulls too.
    """
    rest = [c for c in snapshots.columns if c not in (run, key)]
    rows = snapshots.where(F.col(run).isNotNull() & F.col(key).isNotNull()).groupBy(run, key).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    rows = rows.join(F.broadcast(numbered_runs(snapshots.where(F.col(run).isNotNull()), run)), run)  # a row a run
    of = Window.partitionBy(key).orderBy("no")
    begins = F.coalesce((F.lag("no").over(of) != F.col("no") - 1) | ~F.lag("_row").over(of).eqNullSafe(F.col("_row")), F.lit(True))
    rows = rows.withColumn("_new", begins.cast("int")).withColumn("_island", F.sum("_new").over(of))
    out = rows.groupBy(key, "_island").agg(F.min(run).alias("from_run"), F.max(run).alias("to_run"), F.min_by("_row", "no").alias("_row"))
    return out.select(key, "from_run", "to_run", *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def as_of_run(history: DataFrame, run: Column) -> DataFrame:
    """The snapshot of one run, from the intervals."""
    return history.where((F.col("from_run") <= run) & (F.col("to_run") >= run)).drop("from_run", "to_run")


def joined_at_run(rows: DataFrame, run: str, key: str, history: DataFrame) -> DataFrame:
    """``rows`` (run, key, ...) with what the history held of the key in that run; rows it did not hold go."""
    then = history.withColumnRenamed(key, "_key")
    met = rows.join(then, (F.col(key) == F.col("_key")) & (F.col(run) >= F.col("from_run")) & (F.col(run) <= F.col("to_run")))
    return met.drop("_key", "from_run", "to_run")


# --- the trace of one run --------------------------------------------------------------------------------------------

_EVENTS = "array<struct<stage:string,verdict:string>>"


class Trace:
    """Stages that mark rows instead of dropping them; ``df`` carries alive and events until the run is read."""

    def __init__(self, df: DataFrame, name: str = "run") -> None:
        self.df = df.withColumns({"_alive": F.lit(True), "_events": F.array().cast(_EVENTS)})
        self.name, self.stages, self.observation = name, [], Observation(name)

    def stage(self, name: str, verdict: Column, keep: Column) -> Trace:
        """Give each row that is still there a verdict; rows that ``keep`` doesn't hold for go on as dropped ones.

        Both are written against the columns of the rows; a null ``keep`` drops.
        """
        event = F.struct(F.lit(name).alias("stage"), verdict.cast("string").alias("verdict"))
        marked = self.df.withColumns({"_event": F.when(F.col("_alive"), event), "_stays": F.col("_alive") & F.coalesce(keep, F.lit(False))})
        events = F.when(F.col("_event").isNotNull(), F.concat("_events", F.array("_event"))).otherwise(F.col("_events"))
        self.df = marked.withColumns({"_events": events, "_alive": F.col("_stays")}).drop("_event", "_stays")
        self.stages.append(name)
        return self

    def observed(self) -> DataFrame:
        """All rows; whatever reads them leaves rows in and rows left of every stage in ``counts`` without a further job."""
        passed = [F.count_if(F.array_contains(F.transform("_events", lambda e: e["stage"]), s)).alias(s) for s in self.stages]
        return self.df.observe(self.observation, F.count(F.lit(1)).alias("rows"), F.count_if("_alive").alias("left"), *passed)

    @property
    def counts(self) -> dict[str, int]:
        """Rows that reached each stage, rows and left; after :meth:`observed` has been read."""
        return self.observation.get

    @staticmethod
    def events(rows: DataFrame, id_col: str) -> DataFrame:
        """(id, place, stage, verdict) in order of occurrence."""
        return rows.select(id_col, F.posexplode("_events").alias("place", "_e")).select(id_col, "place", "_e.stage", "_e.verdict")

    @staticmethod
    def kept(rows: DataFrame) -> DataFrame:
        """The rows that passed every stage."""
        return rows.where("_alive").drop("_alive", "_events")


def changed_between(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added or dropped between two stages."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), after.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(key, F.when(F.col("_a").isNull(), "added").otherwise("dropped").alias("change"))
