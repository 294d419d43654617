"""Near duplicates of documents by b-bit MinHash, confirmed on full shingle sets.

Each distinct word sequence gets one signature: K minima over its 5-word shingles. Bands of full minima make the
candidates; of every minimum only the low b bits are kept, packed into 64-bit words, and the similarity of a candidate
is estimated from the number of agreeing b-bit fields, corrected for chance agreement. The estimate only sets aside
pairs that lie five standard errors below the threshold. Beside it a sketch of parities, one bit toggled a shingle, bounds
what two sets differ by from below; pairs that it proves to be under the threshold go too. All others are confirmed on
their full shingle sets.

Inside a bucket of a band no group is expanded into all pairs: every member is compared with the bucket's least member,
components are built, and only buckets that still hold two components are compared further, across components.

Defined cases: words are lower-cased (A-Z) and cut at ASCII white space; a text of fewer words than a shingle is one
shingle; a null or blank text has none and links with nothing. Rows that repeat a doc_id are one node with all their
texts: what any of them links to, all of them reach. A row without doc_id links with nothing and has a null component.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.components import connected_components
from quillstream.llm.shared import discard, mapped, raw_texts, saved, shingle_hashes, word_hashes

SHINGLE, BANDS, ROWS, BITS = 5, 40, 5, 2
K = BANDS * ROWS
#: Minima whose low bits are kept: 192 fields of 2 bits in 6 words.
FIELDS = 192
WORDS = FIELDS * BITS // 64
#: 64-bit words of parities.
ODD = 16
_RNG = np.random.default_rng(2024)
_FACTOR = (_RNG.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SALT = _RNG.integers(0, 2**32, K, dtype=np.uint32)[:, None]
_BAND_FACTOR = _RNG.integers(0, 2**62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]


def minima(shingles: np.ndarray) -> np.ndarray:
    """K minima (unsigned 32-bit) of a set of 64-bit shingle hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(K, np.uint32(2**32 - 1))
    for at in range(0, len(low), 2048):
        block = (low[at : at + 2048] ^ _SALT) * _FACTOR
        np.minimum(best, (block ^ (block >> np.uint32(15))).min(1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of full minima; the band is part of the key."""
    mixed = (best.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _BAND_FACTOR
    total = mixed.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def packed_bits(best: np.ndarray) -> np.ndarray:
    """The low bits of the first FIELDS minima in WORDS 64-bit words."""
    low = (best[:FIELDS].astype(np.uint64) & np.uint64((1 << BITS) - 1)).reshape(WORDS, -1)
    return np.bitwise_or.reduce(low << _SHIFT, axis=1).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """ODD 64-bit words: each shingle toggles one bit, so two sets differ by as many shingles as bits at least."""
    odd = np.bincount((shingles & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def can_reach(percent: int, sizes: tuple[Column, Column], a: list[Column], b: list[Column]) -> Column:
    """Whether two sets can be so similar; never false for sets that are. With d shingles in one set only,
    intersection and union are half of the sizes' sum less and plus d.
    """
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return apart * (100 + percent) <= (sizes[0] + sizes[1]) * (100 - percent)


def estimated_similarity(a: list[Column], b: list[Column]) -> Column:
    """Similarity by bit counts: agreeing fields, less those that agree by chance (1 in 2**b)."""
    field = F.lit(int("01" * (64 // BITS), 2) if BITS == 2 else -1)
    differing = sum((F.bit_count((x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(field)) for x, y in zip(a, b, strict=True)), F.lit(0))
    chance = 1 / 2**BITS
    return ((1 - differing / FIELDS) - chance) / (1 - chance)


def lowest_estimate(threshold: float) -> float:
    """Five standard errors below the threshold."""
    chance = 1 / 2**BITS
    agree = chance + (1 - chance) * threshold
    return threshold - 5 * float(np.sqrt(agree * (1 - agree) / FIELDS)) / (1 - chance)


def _signatures(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def make():
        met: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(met) > 2_000_000:
                met.clear()
            hashes, bounds = word_hashes(*raw_texts(batch.column(1)))
            sizes, names, bits, bands = [], [], [], []
            known = batch.column(0).is_valid().to_pylist()  # a signature on a row without doc_id would be lost
            for at, to, has_id in zip(bounds[:-1].tolist(), bounds[1:].tolist(), known, strict=True):
                words = hashes[at:to]
                shingles = np.unique(shingle_hashes(words, SHINGLE))
                sizes.append(len(shingles))
                name = xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None
                names.append(name)
                if name is None or not has_id or name in met:
                    bits.append(None), bands.append(None)
                    continue
                met.add(name)
                best = minima(shingles)
                bits.append(np.concatenate((packed_bits(best), parities(shingles)))), bands.append(band_keys(best))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        return step

    return mapped(docs, make, "doc_id long, n_shingles long, words binary, bits array<long>, bands array<long>", "text")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity, where an id has several texts, of any two of them.

    b's text is joined first: a is the head of many pairs at times, and its text then goes to them in the last join,
    whose large partitions Spark splits, instead of being written once a pair.
    """
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        def sets(array: pa.Array) -> list[np.ndarray]:
            hashes, bounds = word_hashes(*raw_texts(array))
            return [np.unique(shingle_hashes(hashes[s:e], SHINGLE)) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

        return step

    return mapped(both, make, "a long, b long", "text_a")


def _one_row_a_text(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` with each text of an id once, so that repeated rows don't multiply pairs of texts. Only ids that stand in
    several rows are compared; mostly there are none.
    """
    repeated = members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not repeated.head(1):
        return docs
    return docs.join(repeated, "doc_id", "left_anti").unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is that document)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    threshold = percent / 100
    signed = saved(_signatures(docs), "signatures")
    named = signed.where(F.col("words").isNotNull() & F.col("doc_id").isNotNull())
    # written, so that the joins on words stay ones whose hot keys Spark splits
    classes = saved(named.groupBy("words").agg(F.min("doc_id").alias("rep")), "classes")
    members = saved(signed.select("doc_id", "n_shingles", "words").join(classes, "words", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.col("words").isNotNull().alias("has")), "members")
    texts = _one_row_a_text(docs, members)
    first = named.where(F.col("bands").isNotNull()).select("words", "n_shingles", "bits", "bands").join(classes, "words")
    reps = saved(first.groupBy("rep", "words").agg(F.min(F.struct("n_shingles", "bits", "bands")).alias("x")).select("rep", "x.n_shingles", *(F.col("x.bits")[k].alias(f"s{k}") for k in range(WORDS + ODD)), "x.bands"), "representatives")
    discard(signed, classes)
    bands = reps.select("rep", F.explode("bands").alias("key"))
    plain = reps.drop("bands")
    side = lambda s: plain.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), *(F.col(f"s{k}").alias(f"s{k}_{s}") for k in range(WORDS + ODD)))
    bits = lambda s, at=range(WORDS): [F.col(f"s{k}_{s}") for k in at]
    odd = range(WORDS, WORDS + ODD)
    likely = can_reach(percent, (F.col("n_a"), F.col("n_b")), bits("a", odd), bits("b", odd)) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (estimated_similarity(bits("a"), bits("b")) >= lowest_estimate(threshold))

    heads = bands.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tried = saved(bands.join(heads, "key").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    sure = saved(_confirmed(tried.join(side("a"), "a").join(side("b"), "b").where(likely).select("a", "b").distinct(), texts, percent).distinct(), "links")
    # an id with several texts holds their classes together
    several = members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a != high").drop("high")
    links = sure.unionByName(members.join(several, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct())
    found = connected_components(links)

    # buckets that still hold two components: compare across them what the heads have not settled
    labelled = bands.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    rest = saved(labelled.join(open_keys, "key", "left_semi"), "open")
    x = rest.select("key", F.col("rep").alias("a"), F.col("component").alias("of_a")).join(side("a"), "a")
    y = rest.select("key", F.col("rep").alias("b"), F.col("component").alias("of_b")).join(side("b"), "b")
    across = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & likely).select("a", "b").distinct()
    more = saved(_confirmed(across.join(tried, ["a", "b"], "left_anti"), texts, percent).distinct(), "links")
    components = connected_components(links.unionByName(more))
    discard(tried, rest, found, sure, more, reps)
    out = members.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
