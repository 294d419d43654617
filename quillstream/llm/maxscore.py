"""Exact top-k by inner product with MaxScore.

Vectors become integer rows; a dimension is a query term and its postings are the rows' components in it other than
zero. Per shard and per block of rows the largest and least component of every dimension bound what a term can add. For
a query the terms are ordered by what they can add; at the current k-th best score they part into essential ones and
the rest, whose bounds together stay below that score. Only rows in the postings of essential terms, in blocks that can
compete, are touched; they are scored on essential terms first and probed in the others, term group by term group, while
they stay competitive. The split moves as the k-th best rises. Shards keep their own top k, which are merged.

Dense vectors stand in all postings; there the split saves the probes of the other terms, not rows.

Queries are packed in blocks and rows in shards of bounded size; each pair of a query block and a shard is one unit of
work, so neither side is broadcast or held whole anywhere.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
do not meet; ties go to the smaller vec_id; a query's own row (every row with its vec_id) is no candidate; a component
beyond 64 bits counts as the largest or least 64-bit number, and so does a score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.shared import saved

SHARD, QUERIES, SEED_ROWS, BLOCK, GROUP = 4096, 512, 256, 256, 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of every component, without the vectors that take no part."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("terms"))


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of up to ``size``: dim, ids and terms as little-endian 64-bit integers."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("terms", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([rows.astype("<i8").tobytes()])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == dim))
                ids, rows = np.asarray(mine.column(0)), np.asarray(mine.column(1).flatten()).reshape(-1, dim)
                at = 0
                while at < len(ids):
                    room = size - sum(len(p[0]) for p in held.get(dim, []))
                    held.setdefault(dim, []).append((ids[at : at + room], rows[at : at + room]))
                    at += room
                    if at <= len(ids) and room <= len(held[dim][-1][0]):
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return df.mapInArrow(pack, "dim int, ids binary, terms binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores if scores.dtype == np.int64 else -scores))[:k]  # ~: the least number has no opposite
    return scores[order], ids[order]


class Shard:
    """Rows by term, with the bounds that a query needs. rows: float64 (dim, n); products are whole and below 2**53."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.low, self.high = rows.min(1), rows.max(1)
        starts = np.arange(0, len(ids), BLOCK)
        self.block_low, self.block_high = np.minimum.reduceat(rows, starts, 1), np.maximum.reduceat(rows, starts, 1)
        self.posted = rows != 0

    def top_k(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of the shard."""
        rows, ids, dim = self.rows, self.ids, len(query)
        bound = np.maximum(query * self.high, query * self.low)  # the most that each term can add
        order = np.argsort(-np.abs(query) * (self.high - self.low), kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # the most that the terms from a place on can add
        other = ids != own
        seed = np.flatnonzero(other)[:SEED_ROWS]
        best, best_ids = _best(query @ rows[:, seed], ids[seed], k)
        least = best[-1] if len(best) == k else -np.inf
        split = _split(rest, least)
        # rows outside the essential postings can reach rest[split] at most, rows of a block its own bound
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        blocks = up @ self.block_high + down @ self.block_low >= least
        other[seed] = False
        live = np.flatnonzero(other & np.repeat(blocks, BLOCK)[: len(ids)] & self.posted[order[:split]].any(0)) if split else np.zeros(0, np.int64)
        partial, at, raised = np.zeros(len(live)), 0, False
        while len(live) and at < dim:
            split = _split(rest, least)
            to = min(dim, at + GROUP if raised else max(GROUP, dim // 4), split if at < split else dim)
            terms = order[at:to]
            partial += query[terms] @ (rows[np.ix_(terms, live)] if len(live) < rows.shape[1] // 2 else rows[terms][:, live])
            at = to
            if at == dim:
                break
            if not raised and len(live) > k:  # raise the k-th best by the most promising rows
                lead, raised = np.argpartition(-partial, k)[:k], True
                best, best_ids = _best(np.concatenate([best, query @ rows[:, live[lead]]]), np.concatenate([best_ids, ids[live[lead]]]), k)
                least = best[-1] if len(best) == k else -np.inf
                partial[lead] = -np.inf
            keep = (partial + rest[at] >= least) & (partial > -np.inf)
            live, partial = live[keep], partial[keep]
        return _best(np.concatenate([best, partial]), np.concatenate([best_ids, ids[live]]), k)


def _split(rest: np.ndarray, least: float) -> int:
    """Number of essential terms: the first place from which the bounds together stay below the k-th best score."""
    below = rest < least
    return int(below.argmax()) if below.any() else len(rest) - 1


def wide_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers by limbs of 26 bits, held within 64 bits."""
    limbs = lambda x: [x & 0x3FFFFFF, (x >> 26) & 0x3FFFFFF, x >> 52]
    total = np.zeros(len(rows), object)
    for at in range(0, rows.shape[1], 1024):  # so many products of two limbs stay below 2**63
        a, b = limbs(rows[:, at : at + 1024]), limbs(query[at : at + 1024])
        for i in range(3):
            for j in range(3):
                total += (a[i] @ b[j]).astype(object) * (1 << 26 * (i + j))
    return np.array([min(max(x, _LEAST), _MOST) for x in total], np.int64)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``df`` but its own.

    Both hold (vec_id, terms), as from :func:`integer_vectors`.
    """
    shards = saved(_packed(df, SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = saved(_packed(queries, QUERIES).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms")).withColumn("block", F.monotonically_increasing_id()), "queries")
    # each query block meets each shard of its length once; the pairs of numbers are made first, the rows join them
    units = asked.select("block", "q_dim").join(shards.select("shard", "dim"), F.col("q_dim") == F.col("dim")).select("block", "shard")
    work = units.join(asked, "block").join(shards, "shard").select("ids", "terms", "q_ids", "q_terms", "dim").repartition(F.rand(7))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                ids, q_ids = np.frombuffer(unit["ids"], "<i8"), np.frombuffer(unit["q_ids"], "<i8")
                whole, asking = (np.frombuffer(unit[c], "<i8").reshape(-1, unit["dim"]) for c in ("terms", "q_terms"))
                size = lambda x: max(int(x.max()), -int(x.min()))
                largest = size(whole) * size(asking) * unit["dim"]
                if largest < 2**53:
                    shard = Shard(np.ascontiguousarray(whole.T, dtype=np.float64), ids)
                    parts = [shard.top_k(q, o, k) for q, o in zip(asking.astype(np.float64), q_ids.tolist(), strict=True)]
                else:  # beyond whole numbers of doubles: every row by integers
                    parts = []
                    for q, o in zip(asking, q_ids.tolist(), strict=True):
                        there = ids != o
                        parts.append(_best((whole @ q if largest < 2**62 else wide_scores(whole, q))[there], ids[there], k))
                owner = np.repeat(q_ids, [len(s) for s, _ in parts])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate([i for _, i in parts]), pa.int64()), pa.array(np.concatenate([s for s, _ in parts]).astype(np.int64))], schema=schema)

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.t) = len(c.t) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
