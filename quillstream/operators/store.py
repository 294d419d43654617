"""Greedy dedup against a growing store: an index of keys that batches extend.

A row is new when none of its keys (id, address, title, signature) belongs to a row kept before, in the store or earlier in
its batch; a row that is suppressed registers nothing. So batches in turn keep the rows that one pass over all would.

The index is a table of keys and their holders, in BUCKETS folders by the key's hash, one part a batch. Beside it each part
has a filter, two bits a key in FILTER_CELLS words of 64 bits, as rows of a table. A batch first probes the filters, by joins
on the word; only keys that may be there are joined with the index, and of it only the folders that they fall in are read.
Filters fill up as the store grows; then more keys meet the index and the result stays the same. A batch that is run again
replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.rounds import discard, first_without_conflict, written

BUCKETS = 64
FILTER_CELLS = 1 << 20
_PART = "part string"


class KeyIndex:
    """Keys and holders below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, what: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def keys(self) -> DataFrame:
        """(key, holder, part, bucket) of all parts."""
        schema = f"key string, holder string, {_PART}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/keys") if self._exists("keys") else self.spark.createDataFrame([], schema)

    def filters(self) -> DataFrame:
        """(cell, bits, part) of all parts."""
        schema = f"cell long, bits long, {_PART}"
        return self.spark.read.schema(schema).parquet(f"{self.path}/filters") if self._exists("filters") else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(BUCKETS)).cast("int")

    @staticmethod
    def _probes(key: Column) -> Column:
        """The two bits of a key: structs of cell and bit."""
        bit = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(FILTER_CELLS * 64))
        return F.array(*(F.struct(F.floor(bit(s) / 64).cast("long").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit(s) % 64).cast("int")).alias("bit")) for s in ("one", "two")))

    def possible(self, keys: DataFrame, part: str) -> DataFrame:
        """Of distinct keys those that parts other than ``part`` may hold."""
        cells = self.filters().where(F.col("part") != part).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
        probed = keys.select("key", F.explode(self._probes(F.col("key"))).alias("p")).select("key", "p.cell", "p.bit").join(cells, "cell")
        return probed.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("key")

    def held(self, keys: DataFrame, part: str) -> DataFrame:
        """(key, holder) of distinct keys that parts other than ``part`` hold."""
        maybe = written(self.possible(keys, part))
        of = maybe.withColumn("bucket", self._bucket(F.col("key")))
        buckets = [r[0] for r in of.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        found = self.keys().where(F.col("bucket").isin(buckets) & (F.col("part") != part)).join(of, ["bucket", "key"]).select("key", "holder")
        out = written(found)
        discard(maybe)
        return out

    def admit(self, part: str, rows: DataFrame, id_col: str, order_col: str, keys: Column) -> DataFrame:
        """The rows of a batch that are new, as ``rows`` has them; their keys stand in the index afterwards. Ids are unique."""
        batch = written(rows.withColumn("_keys", F.array_distinct(F.array_compact(keys))))
        each = batch.select(F.col(id_col).alias("_id"), F.explode("_keys").alias("key"))
        hit = self.held(each.select("key").distinct(), part)
        alive = batch.join(each.join(hit, "key", "left_semi").select(F.col("_id").alias(id_col)).distinct(), id_col, "left_anti")
        kept = first_without_conflict(alive, id_col, order_col, F.col("_keys"))
        out = written(alive.join(kept, id_col, "left_semi"))
        added = out.select(F.explode("_keys").alias("key"), F.col(id_col).cast("string").alias("holder")).withColumns({"part": F.lit(part), "bucket": self._bucket(F.col("key"))})
        put = lambda df, what, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{what}")
        put(added.repartition("bucket"), "keys", ["part", "bucket"])
        bits = added.select(F.explode(self._probes(F.col("key"))).alias("p")).groupBy("p.cell").agg(F.bit_or("p.bit").alias("bits"))
        put(bits.withColumn("part", F.lit(part)), "filters", ["part"])
        discard(hit, batch)
        return out.drop("_keys")


def repeats_over_sends(sends: DataFrame, send_col: str, item_col: str, sigs_col: str) -> DataFrame:
    """(send, item, repeated): whether a signature of an item was sent before, oldest send first; a repeated item registers too.

    Signatures accumulate over all sends, so an item is repeated when the first send of one of its signatures is earlier.
    """
    each = sends.select(F.col(send_col).alias("_send"), F.col(item_col).alias("_item"), F.explode_outer(sigs_col).alias("_sig"))
    first = each.where("_sig IS NOT NULL").groupBy("_sig").agg(F.min("_send").alias("_first"))
    told = each.join(first, "_sig", "left").groupBy("_send", "_item").agg(F.coalesce(F.bool_or(F.col("_first") < F.col("_send")), F.lit(False)).alias("repeated"))
    return told.withColumnsRenamed({"_send": send_col, "_item": item_col})
