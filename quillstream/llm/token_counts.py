"""Token counts through a digest cache.

Texts are normalised so that equal ones have equal counts, and named by a digest. Counts stand in a table keyed by that
digest and the digest of the tokenizer's version; only distinct contents without a stored count are encoded, and their
counts are appended. Copies are dropped within a task before anything is shuffled, so a content that holds a third of
all rows reaches the shuffle once a task at most.

Defined cases: a null text is an empty one with no tokens; every text is counted whole; repeated rows give repeated
results; special strings inside texts are handled as the library does by default; other columns are ignored. Appending
the same counts twice (a retried run) does no harm: readers take one count for a digest.
"""

from __future__ import annotations

import gc
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.shared import exists, mapped, saved, scratch_path, texts_of

#: Remembered words in a task; the memory is emptied when full.
MEMORY = 400_000
_SIGNS = frozenset(",.;:!?")
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def file_digest(path: str) -> str:
    """The tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the text with every run of ASCII white space as one blank, none at the ends: such runs make no tokens."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), 256)


def _library(path: str):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return coder


class WordCounter:
    """Counts by the library, which drops white space: words between ASCII white space count on their own."""

    def __init__(self, path: str) -> None:
        self.coder, self.memory = _library(path), {}

    def counts(self, texts: list[str]) -> list[int]:
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        split = [t.encode("utf-8").split() for t in texts]
        new = {w.decode(): w for w in set().union(*split).difference(memory)}
        # the library cuts letters from the sign behind them, so such a word is the sum of its two parts
        parted = {w: w[:-1] for w in new if w[-1] in _SIGNS and w[:-1].isalpha()}
        asked = {*(w for w in new if w not in parted), *parted.values(), *_SIGNS}
        asked = [w for w in asked if w.encode() not in memory]
        for word, got in zip(asked, self.coder.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            memory[word.encode()] = len(got)
        for word, core in parted.items():
            memory[new[word]] = memory[core.encode()] + memory[word[-1].encode()]
        return [sum([memory[w] for w in words]) for words in split]


_counters: dict[tuple[str, str], WordCounter] = {}


def counter_of(path: str, version: str) -> WordCounter:
    """The counter of a file, built once in a process."""
    if (path, version) not in _counters:
        _counters[path, version] = WordCounter(path)
    return _counters[path, version]


def first_in_task(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, packed column) without the rows whose key the task has met before; texts are compressed for the shuffle."""

    def make():
        met: set[str] = set()
        packer = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([(key, pa.string()), ("packed", pa.binary())])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(met) > 2_000_000:
                met.clear()
            keys, packed = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in met:
                    met.add(k)
                    keys.append(k)
                    packed.append(packer.compress((t or "").encode()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(packed, pa.binary())], schema=schema)

        return step

    return mapped(df.select(key, column), make, f"{key} string, packed binary", column)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens.

    ``cache_path``: the table of counts, kept from run to run; it is made where it isn't there. Without one, the cache
    serves this call alone.
    """
    spark: SparkSession = docs.sparkSession
    version = file_digest(tokenizer_path)
    kept = cache_path is not None and exists(spark, cache_path)
    cache_path = cache_path or scratch_path(spark, "token-counts")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), content_digest(F.col("text")).alias("content"))
    misses = first_in_task(named, "content", "text")
    if kept:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("content")
        misses = misses.join(known, "content", "left_anti")

    def make():
        gc.disable()  # the memory holds no cycles
        counter, last = counter_of(tokenizer_path, version), [None]
        schema = pa.schema([("content", pa.string()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])
        opener = zstandard.ZstdDecompressor()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = {}
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last[0]:  # equal digests come one after the other
                    last[0] = k
                    new[k] = opener.decompress(p).decode()
            got = counter.counts(list(new.values()))
            return pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array([version] * len(new), pa.string()), pa.array(got, pa.int64())], schema=schema)

        return step

    counted = mapped(misses.repartition("content").sortWithinPartitions("content"), make, CACHE_SCHEMA, "packed")
    counted.write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    cache = cache.select("content", "n_tokens")
    if kept:  # runs at the same time may have counted a text twice; written, so that the join stays one whose hot keys Spark splits
        cache = saved(cache.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = named.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "content")
    return rows.join(cache, "content").select("doc_id", "n_bytes", "n_tokens")
