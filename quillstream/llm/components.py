"""Connected components by alternating stars, with a scratch table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import discard, saved


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (two long columns a, b); the component is its smallest node.

    Each round sends every node's larger neighbours, then its smaller ones, to the least of them; edges never multiply,
    and the number of rounds grows with the logarithm of the nodes. A hot node's edges are pre-aggregated (a minimum)
    and joined, so no task holds a node's neighbours. Null ends and loops are ignored; repeated edges count once.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = _least(both, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).distinct()
        low = _least(large, "v", "u").withColumnRenamed("u", "w")
        small = large.join(low, F.col("v") == F.col("w"))
        small = small.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select(F.col("w").alias("v"), F.col("m").alias("u"))).distinct()
        after = saved(small, "edges")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        same = mark(now) == mark(after)
        discard(now)
        now = after
        if same:
            break
    labels = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    out = labels.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    out._scratch_path = now._scratch_path  # type: ignore[attr-defined]
    return out
