"""Hard negatives by norm-bucketed search.

Rows are sorted by the length of their vectors (the norm) and packed in buckets. An inner product is at most the product
of the two norms (Cauchy-Schwarz), so an anchor leaves a bucket, and all later ones, as soon as its norm times the
bucket's largest stays below what it still needs: the running k-th best score in the search for positives; in the search
for negatives, for each window of admitted scores, the larger of the window's lower limit and its running k-th score.

Anchors are packed in blocks, by norm too. A unit of work is a block of anchors with one lane of LANE buckets at most, dealt
so that each lane starts with long vectors; lanes of a block are merged. A block and a bucket that cannot meet by their bounds are
parted before any vector moves. No side is broadcast or held whole, and no pair of rows is written but the ones returned.

Defined cases: rows with a null vec_id, label or vector, and vectors with a null or non-finite component, take no part;
vectors of different lengths do not meet; ties go to the smaller vec_id; rows with the anchor's vec_id are neither its
positives nor its negatives; of several anchor rows with one vec_id the first by label and vector asks; components and
scores beyond 64 bits count as the largest or least 64-bit number. An anchor without positives, or a positive without
negatives in its window, returns nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.maxscore import wide_scores
from quillstream.llm.shared import saved

BUCKET, BLOCK, LANE = 2048, 1024, 16
_NONE = -(1 << 63)


def labelled_vectors(df: DataFrame, scale: int = 256, noisy_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, terms, norm): floor(scale * x) of every component; each ``noisy_every``-th row gets the next label."""
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good)
    label = F.col("label").cast("long")
    terms = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % noisy_every == 0, (label + 1) % labels).otherwise(label).alias("label"), terms.alias("terms"))
    return out.withColumn("norm", F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _packed(df: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows in falling order of norm, packed by ``size``: number, dim, top, bottom (norms) and the bytes of ids, labels, terms, norms.

    Equal norms are dealt by vec_id, so a common vector fills no one task.
    """
    sortable = df.repartitionByRange(parts, F.desc("norm"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id", "label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, labels, norms, terms = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            kind = np.int16 if max(int(terms.max()), -1 - int(terms.min())) < 1 << 15 else np.int64
            raw = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([float(norms.max())]), pa.array([float(norms.min())]), pa.array([len(ids)], pa.int32()), raw(ids, "<i8"), raw(labels, "<i8"), raw(norms, "<f8"), raw(terms, kind)],
                ["dim", "top", "bottom", "rows", "ids", "labels", "norms", "terms"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            for dim in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == dim))
                columns = np.asarray(mine.column(0)), np.asarray(mine.column(1)), np.asarray(mine.column(3)), np.asarray(mine.column(2).flatten()).reshape(-1, dim)
                at = 0
                while at < mine.num_rows:
                    room = size - sum(len(p[0]) for p in held.get(dim, []))
                    held.setdefault(dim, []).append(tuple(x[at : at + room] for x in columns))
                    at += room
                    if sum(len(p[0]) for p in held[dim]) == size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    packed = sortable.select("vec_id", "label", "terms", "norm").mapInArrow(pack, "dim int, top double, bottom double, rows int, ids binary, labels binary, norms binary, terms binary")
    return packed.withColumn("number", F.monotonically_increasing_id())


class Rows:
    """A packed block or bucket, unpacked."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels, self.norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["norms"], "<f8")
        kind = "<i2" if len(row["terms"]) == 2 * len(self.ids) * row["dim"] else "<i8"
        self.terms = np.frombuffer(row["terms"], kind).reshape(len(self.ids), row["dim"]).astype(np.int64)
        self.real = self.terms.astype(np.float64)

    def scores(self, mine: np.ndarray, other: Rows) -> np.ndarray:
        """Integer products of some of these rows with all of the other's."""
        largest = lambda x: float(max(int(x.max()), -int(x.min()), 1))
        bound = largest(self.terms) * largest(other.terms) * self.terms.shape[1]
        if bound < 2**53:
            return (self.real[mine] @ other.real.T).astype(np.int64)
        if bound < 2**62:
            return self.terms[mine] @ other.terms.T
        return np.stack([wide_scores(other.terms, q) for q in self.terms[mine]])


class Best:
    """The k best (score, vec_id) of many askers, as candidates come in; equal scores by smaller vec_id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.zeros((n, k), bool)

    def least(self) -> np.ndarray:
        """The running k-th score; the least number where fewer are found."""
        return self.scores[:, -1]

    def offer(self, asker: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as flat triples; those that are among the k best stay."""
        if not len(asker):
            return
        mine = np.unique(asker)
        old = self.found[mine]
        who = np.concatenate([asker, np.repeat(mine, self.k)[old.ravel()]])
        score = np.concatenate([scores, self.scores[mine][old]])
        vec = np.concatenate([ids, self.ids[mine][old]])
        order = np.lexsort((vec, ~score, who))
        who, score, vec = who[order], score[order], vec[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < self.k
        self.scores[mine], self.ids[mine], self.found[mine] = _NONE, np.iinfo(np.int64).max, False
        self.scores[who[top], place[top]], self.ids[who[top], place[top]], self.found[who[top], place[top]] = score[top], vec[top], True


def _reach(norms: np.ndarray, top: float) -> np.ndarray:
    """The most that products with vectors of norm ``top`` or less can be; a little more, for the roundings of both norms."""
    return norms * top * (1 + 1e-9) + 1e-6


def _searched(blocks: DataFrame, buckets: DataFrame, can_meet: Callable, make: Callable, schema: str) -> DataFrame:
    """``make(block, buckets)`` for each block of anchors and each lane of buckets that it can meet, in falling order of norm."""
    a = blocks.select(F.col("number").alias("block"), F.col("dim").alias("a_dim"), F.col("top").alias("a_top"), *(["need"] if "need" in blocks.columns else []))
    b = buckets.select("number", "dim", "top", "lane")
    pairs = a.join(b, F.col("a_dim") == F.col("dim")).where(can_meet()).select("block", "number", "lane")
    asks = pairs.select("block", "lane").distinct().join(blocks.select(F.col("number").alias("block"), *[c for c in blocks.columns if c != "number"]), "block").withColumn("asks", F.lit(True)).withColumn("number", F.lit(-1).cast("long"))
    shared = [c for c in buckets.columns if c not in ("number", "lane")]
    extra = [c for c in blocks.columns if c not in buckets.columns]
    offers = pairs.join(buckets.drop("lane"), "number").withColumn("asks", F.lit(False))
    for c in extra:
        offers = offers.withColumn(c, F.lit(None).cast(dict(blocks.dtypes)[c]))
    both = asks.select("block", "lane", "asks", "number", *shared, *extra).unionByName(offers.select("block", "lane", "asks", "number", *shared, *extra))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = next(r for r in rows if r["asks"])
        return make(block, sorted((r for r in rows if not r["asks"]), key=lambda r: (-r["top"], r["number"])))

    return both.groupBy("block", "lane").applyInArrow(run, schema)


def positives(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(anchor_id, label, positive_id, positive_score): the k best rows of each anchor's own label."""

    def make(block: dict, found: list[dict]) -> pa.Table:
        anchors = Rows(block)
        best = Best(len(anchors.ids), k)
        for row in found:
            live = np.flatnonzero(_reach(anchors.norms, row["top"]) >= best.least())
            if not len(live):
                break
            bucket = Rows(row)
            scores = anchors.scores(live, bucket)
            fits = (bucket.labels == anchors.labels[live][:, None]) & (bucket.ids != anchors.ids[live][:, None]) & (scores >= best.least()[live][:, None])
            fits &= scores >= _kth(np.where(fits, scores, _NONE), k)[:, None]
            who, which = np.nonzero(fits)
            best.offer(live[who], scores[who, which], bucket.ids[which])
        who, place = np.nonzero(best.found)
        return pa.table({"anchor_id": anchors.ids[who], "positive_id": best.ids[who, place], "positive_score": best.scores[who, place]})

    found = _searched(blocks, buckets, lambda: F.lit(True), make, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), _NONE)


def negatives(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(anchor_id, place, negative_id, negative_score): in each window (place, low, high) of an anchor its k best rows of other labels."""

    def make(block: dict, found: list[dict]) -> pa.Table:
        anchors = Rows(block)
        windows = pd.DataFrame(block["windows"], columns=["anchor_id", "place", "low", "high"])
        spot = {a: i for i, a in enumerate(anchors.ids.tolist())}
        owner = np.array([spot[a] for a in windows["anchor_id"]], np.int64)
        low, high = windows["low"].to_numpy(np.int64), windows["high"].to_numpy(np.int64)
        best = Best(len(owner), k)
        for row in found:
            floor = np.maximum(low, best.least())
            open_ = np.flatnonzero((_reach(anchors.norms[owner], row["top"]) >= floor) & (low <= high))
            if not len(open_):
                break
            bucket = Rows(row)
            live, inverse = np.unique(owner[open_], return_inverse=True)
            scores = anchors.scores(live, bucket)
            other = (bucket.labels != anchors.labels[live][:, None]) & (bucket.ids != anchors.ids[live][:, None])
            step = max(1, (1 << 21) // len(bucket.ids))
            for at in range(0, len(open_), step):
                mine, rows = open_[at : at + step], inverse[at : at + step]
                s = scores[rows]
                fits = other[rows] & (s >= floor[mine][:, None]) & (s <= high[mine][:, None])
                fits &= s >= _kth(np.where(fits, s, _NONE), k)[:, None]
                who, which = np.nonzero(fits)
                best.offer(mine[who], s[who, which], bucket.ids[which])
        who, at = np.nonzero(best.found)
        return pa.table({"anchor_id": windows["anchor_id"].to_numpy(np.int64)[who], "place": windows["place"].to_numpy(np.int32)[who], "negative_id": best.ids[who, at], "negative_score": best.scores[who, at]})

    meets = lambda: F.col("a_top") * F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("need")
    return _searched(blocks, buckets, meets, make, "anchor_id long, place int, negative_id long, negative_score long")


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``n_positives`` best rows of its label, the ``n_negatives`` best rows of other labels
    that score from ``least`` to ``most`` hundredths of the positive. Both tables as from :func:`labelled_vectors`.
    """
    one = Window.partitionBy("vec_id").orderBy("label", "terms")
    asking = anchors.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    many = rows.count()
    packed = saved(_packed(rows, BUCKET, max(1, many // (4 * BUCKET))), "buckets")
    lanes = -(-packed.count() // LANE)
    ranked = Window.partitionBy("dim").orderBy(F.desc("top"), "number")
    lane = packed.select("number", "dim", "top").withColumn("lane", (F.row_number().over(ranked) - 1) % F.lit(max(1, lanes))).select("number", "lane")
    buckets = packed.join(lane, "number")
    blocks = saved(_packed(asking, BLOCK, max(1, many // (200 * BLOCK))), "anchors")
    found = saved(positives(blocks, buckets, n_positives), "positives")
    score = F.col("positive_score")
    # scores that are whole: least * p <= 100 n <= most * p; a positive below zero admits none, and products stay in 38 digits
    part = lambda p: score.cast("decimal(38,0)") * p / F.lit(100).cast("decimal(38,0)")
    limits = found.select("anchor_id", "place", F.ceil(part(least)).cast("long").alias("low"), F.floor(part(most)).cast("long").alias("high")).where("low <= high")
    member = saved(_members(blocks), "members")
    by_block = member.join(limits, "anchor_id").groupBy("number").agg(F.collect_list(F.struct("anchor_id", "place", "low", "high")).alias("windows"), F.min("low").cast("double").alias("need"))
    mined = negatives(blocks.join(by_block, "number"), buckets, n_negatives)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return best.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(blocks: DataFrame) -> DataFrame:
    """(number, anchor_id) of every block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number)), pa.array(held)], ["number", "anchor_id"])

    return blocks.select("number", "ids").mapInArrow(unpack, "number long, anchor_id long")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(a.t, c.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.t) = len(c.t) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
      FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
      WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
