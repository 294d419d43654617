"""Greedy choices in order as rounds of joins: what no earlier row can touch any more is decided at once.

Both loops give what one pass over all rows in order gives. A round decides every open row or pair that waits for no
other, so rounds grow with the longest chain of dependencies, not with the rows or their groups. Tables of a round are
deleted when the next one stands. Hot keys are pre-aggregated (a
minimum) and otherwise only joined on, so no task holds a key's rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: str | None = None


def scratch(spark: SparkSession, label: str = "round") -> str:
    """A new path below ``spark.checkpoint.dir``; in a folder of this process on a local master without that setting."""
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="rounds-")
        root = f"file://{_own_folder}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows a task of costly rules: short texts, and whole documents.
TEXTS_A_TASK, DOCUMENTS_A_TASK = 25_000, 2_000


def spread(scan: DataFrame, most: int = TEXTS_A_TASK, rows: int | None = None) -> DataFrame:
    """Rows dealt to all cores and to tasks of about ``most`` rows, so a task grows no longer with the table.

    Files are split by bytes, and rules cost by the row: a split of a large table would hold a million short texts. The
    rows of a plain scan are counted from the footers of its files; ``rows`` says how many there are elsewhere.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-(scan.count() if rows is None else rows) // most))
    # asking a join for its partitions would run it
    return scan.repartition(tasks) if rows is not None or scan.rdd.getNumPartitions() < tasks else scan


def written(df: DataFrame) -> DataFrame:
    """Write a scratch table and read it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _together(tables: list[DataFrame], schema: DataFrame) -> DataFrame:
    """Tables of one schema as one scan."""
    return schema.sparkSession.read.schema(schema.schema).parquet(*(t._written for t in tables)) if tables else schema.limit(0)


def first_without_conflict(df: DataFrame, id_col: str, order_col: str, keys: Column) -> DataFrame:
    """Ids kept when, in order, none of a row's keys belongs to a row kept before; rows without keys are kept.

    Ids are unique and not null; null keys don't count.
    """
    # names that no column has: within lambdas a name of the same select would be taken for the table's own
    raw = df.select(F.col(id_col).alias("_r_id"), F.col(order_col).alias("_r_ord"), F.array_distinct(F.array_compact(keys)).alias("_r_keys"))
    begun = written(raw.select(F.col("_r_id").alias("id"), F.struct(F.col("_r_ord").alias("ord"), F.col("_r_id").alias("id")).alias("place"), F.col("_r_keys").alias("keys")))
    alone = begun.where(F.coalesce(F.size("keys"), F.lit(0)) <= 0).select("id")
    rows, kept = begun.select("id", "place", F.explode("keys").alias("key")), []
    held = None
    while rows.head(1):
        least = rows.groupBy("key").agg(F.min("place").alias("least"))
        behind = rows.join(least, "key").where(F.col("place") != F.col("least")).select("id").distinct()
        first = written(rows.join(behind, "id", "left_anti").select("id", "key"))
        hit = rows.join(first.select("key").distinct(), "key", "left_semi").select("id").distinct()
        rows = written(rows.join(hit, "id", "left_anti"))
        if held is not None:
            discard(held)
        held = rows
        kept.append(first)
    found = _together(kept, begun.select("id", F.lit("").alias("key"))).select("id").distinct()
    return alone.unionByName(found).withColumnRenamed("id", id_col)


def dropped_by_pairs(pairs: DataFrame, with_place: bool = False) -> DataFrame:
    """Ids (gone) that go when, in order, the loser of each pair goes whose two rows are both still there.

    ``pairs``: place (orderable, unique), x, y (ids) and loser, one of both. A pair waits only for earlier ones in which one
    of its two rows would lose. A row that goes voids its later pairs; its earlier ones still count. So a group of which one
    row beats all others is decided in one round. ``with_place``: also the place of the pair (at).
    """
    pairs = written(pairs.select("place", "x", "y", "loser"))
    gone: list[DataFrame] = []
    while pairs.head(1):
        least = pairs.groupBy(F.col("loser").alias("end")).agg(F.min("place").alias("least"))
        of = lambda s: least.select(F.col("end").alias(s), F.col("least").alias(f"least_{s}"))
        waits = lambda s: F.coalesce(F.col(f"least_{s}") < F.col("place"), F.lit(False))
        ready = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").where(~waits("x") & ~waits("y"))
        out = written(ready.select(F.col("loser").alias("gone"), F.col("place").alias("at")))
        went = lambda s: out.select(F.col("gone").alias(s), F.col("at").alias(f"at_{s}"))
        later = lambda s: F.coalesce(F.col("place") >= F.col(f"at_{s}"), F.lit(False))
        left = written(pairs.join(went("x"), "x", "left").join(went("y"), "y", "left").where(~later("x") & ~later("y")).select("place", "x", "y", "loser"))
        discard(pairs)
        pairs = left
        gone.append(out)
    found = _together(gone, pairs.select(F.col("loser").alias("gone"), F.col("place").alias("at")))
    return found if with_place else found.select("gone")


def _leaders(rows: DataFrame) -> DataFrame:
    """Rows that are better than all rows of their class before them."""
    firsts = rows.groupBy("class", "rank").agg(F.min(F.struct("place", "key")).alias("first")).select("class", "rank", "first.*")
    before = F.max("rank").over(Window.partitionBy("class").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return firsts.withColumn("_best", before).where(F.col("_best").isNull() | (F.col("rank") > F.col("_best"))).select("key", "class", "place", "rank")


def dropped_by_classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Ids (gone) that :func:`dropped_by_pairs` drops over all pairs of rows (key, class, place, rank) whose classes are linked
    (c, d; both ways, each class with itself): the later row of a pair loses, unless its rank is higher.

    Most rows go at the turn of an earlier one and never decide anything, so pairs are made of some rows only: first those
    that lead their class. In its turn a row drops all linked rows from its place to the first better one, which drops it.
    A row left out is settled if the first turn that covers it is by a row as good; then it goes there, and decides
    nothing before. Rows that aren't settled join in, leaders first, until all are. Work grows with rows and linked classes.
    """
    rows = written(rows.select("key", "class", "place", "rank"))
    links = written(links)
    chosen = written(_leaders(rows))
    while True:
        side = lambda s, c, of: of.select(F.col("class").alias(c), F.col("key").alias(s), F.col("place").alias(f"at_{s}"), F.col("rank").alias(f"rank_{s}"))
        met = side("x", "c", chosen).join(links, "c").join(side("y", "d", chosen), "d").where(F.col("at_x") < F.col("at_y"))
        loser = F.when(F.col("rank_y") > F.col("rank_x"), F.col("x")).otherwise(F.col("y"))
        gone = dropped_by_pairs(met.select(F.struct(F.col("at_x").alias("i"), F.col("at_y").alias("j")).alias("place"), "x", "y", loser.alias("loser")), True)
        ended = written(chosen.join(gone.select(F.col("gone").alias("key"), "at"), "key", "left"))
        own = F.col("at").isNull() | (F.col("at.i") == F.col("place"))  # those that went before had no turn
        turns = ended.where(own).select(F.col("class").alias("c"), F.struct(F.col("place").alias("start"), F.col("at.j").alias("end"), F.col("rank").alias("worth")).alias("turn"))
        over = turns.join(links, "c").groupBy(F.col("d").alias("class")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        covers = F.filter("turns", lambda t: (t["start"] < F.col("place")) & (t["end"].isNull() | (F.col("place") < t["end"])))
        left = rows.join(chosen.select("key"), "key", "left_anti").join(over, "class", "left").withColumn("by", F.try_element_at(covers, F.lit(1)))
        more = written(_leaders(left.where(F.col("by").isNull() | (F.col("by.worth") < F.col("rank")))))
        if not more.head(1):
            break
        chosen = written(chosen.unionByName(more))
    return rows.join(ended.where("at IS NULL").select("key"), "key", "left_anti").select(F.col("key").alias("gone"))
