"""Near duplicates of embeddings by E8 lattice hashing.

Unit vectors are projected to eight dimensions by several random orthonormal maps; each image is decoded to its nearest
point of the E8 lattice, which names the vector's home cell in that table. A vector also probes the neighbouring cells
nearest to its image. Two vectors are compared where one's home is among the other's cells; links are confirmed by
cosine in double precision.

Cells are compared in blocks of bounded size, so a cell that holds a large part of all vectors becomes many small tasks.
No pair is written out: a block adds up each vector's links, counting a pair only in the first table and cell in which
it meets (both vectors' cells are decoded again for that), and gives one edge a vector to the least member of its
connected part of the block. Equal vectors are one class and count as links of each other.

The tables, probes and scale are chosen for recall of at least 0.9 of pairs at the threshold (measured in the tests).
Chance meetings of unrelated vectors grow with the number of vectors; a larger ``scale`` with more tables thins them.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are
their own component; vectors of different lengths never link. Rows that repeat a vec_id are rows of one node, each with
its own vector and links; what one of them links to, all reach. A row without vec_id links with nothing and has a null
component. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.components import connected_components
from quillstream.llm.shared import discard, saved

TABLES, PROBES, SCALE, BLOCK = 8, 5, 8.0, 512


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


ROOTS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row: the better of D8 and D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def _maps(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8 + dim)
    parts, need = [], 8 * tables
    while sum(p.shape[1] for p in parts) < need:
        parts.append(np.linalg.qr(rng.normal(size=(max(dim, 8), max(dim, 8))))[0][:dim])
    return np.concatenate(parts, 1)[:, :need] * np.sqrt(dim / 8) / np.sqrt(8), rng.random(need)


_KEY = np.random.default_rng(88).integers(0, 2**62, 8, dtype=np.int64) * 2 + 1


def _names(points: np.ndarray, table: int) -> np.ndarray:
    return ((points * 2).astype(np.int64) * _KEY).sum(-1) * np.int64(0x9E3779B97F4A7C15 - 2**64) + np.int64(table * 7919)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Names (rows, tables, 1 + probes) of each unit vector's home cell and of the cells that it probes."""
    maps, shift = _maps(unit.shape[1], tables)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = unit @ maps[:, 8 * t : 8 * t + 8] * scale + shift[8 * t : 8 * t + 8]
        home = nearest_e8(x)
        gain = (x - home) @ ROOTS.T
        near = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _names(home, t)
        out[:, t, 1:] = _names(home[:, None, :] + ROOTS[near], t)
    return out


def _good(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    return df.where(_good(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(array.flatten(), np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by the length of their vectors."""
    sizes = np.diff(np.asarray(batch.column(column).offsets))
    for dim in np.unique(sizes).tolist():
        yield batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _met_before(ci: np.ndarray, cj: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a pair's first meeting is elsewhere than in ``cell``; ci, cj: both vectors' cells by table."""
    meet = np.full(len(ci), True)
    open_ = np.arange(len(ci))
    for t in range(ci.shape[1]):
        a, b = ci[open_, t], cj[open_, t]
        forth, back = (b == a[:, :1]).any(1), (a == b[:, :1]).any(1)
        first = np.where(forth & back, np.minimum(a[:, 0], b[:, 0]), np.where(forth, a[:, 0], b[:, 0]))
        some = forth | back
        meet[open_[some]] = first[some] != cell[open_[some]]
        open_ = open_[~some]
        if not len(open_):
            break
    return meet


def _local_components(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id in each row's part of a small graph."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        if (low == before).all():
            return low


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable), kept (it is that vector)."""
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    usable = _usable(all_rows, "vec_id", "vector").where(F.col("vec_id").isNotNull())
    # a class, the rows of one vector, has a number; rep: its least vec_id, which it has in the graph
    keyed = usable.select("vec_id", "vector", F.sha2(F.to_json("vector"), 256).alias("content"))
    grouped = keyed.groupBy("content").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = saved(grouped.withColumn("of", F.monotonically_increasing_id()), "classes")
    members = saved(keyed.select("vec_id", "content").join(classes.drop("vector"), "content").select("vec_id", "of", "rep", "copies"), "members")
    reps = classes.select(F.col("of").alias("vec_id"), "rep", "copies", "vector")

    def name_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 1) if whole.num_rows else ():
                x = _unit(_matrix(batch.column(1), len(batch.column(1)[0])))
                for at in range(0, len(x), 2048):
                    names = cells(x[at : at + 2048], tables, probes, scale).reshape(-1, tables * (1 + probes))
                    ids = batch.column(0).slice(at, len(names))
                    n = names.shape[1]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array(names.ravel()), pa.array(np.tile(np.arange(n) % (1 + probes) == 0, len(ids)))], names=["vec_id", "cell", "home"])

    places = saved(reps.select("vec_id", "vector").mapInArrow(name_cells, "vec_id long, cell long, home boolean"), "cells")
    # a cell matters where a home meets another vector; large ones are cut into blocks, taken two by two
    sizes = places.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    busy = places.join(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "cell")
    own = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")
    spread = busy.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("vec_id", "cell", "home", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    blocks = spread.join(reps, "vec_id").select("cell", "p", "q", "own", "home", "vec_id", "rep", "copies", "vector")
    blocks = blocks.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and not batch.num_rows):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([np.asarray(table.column(k)) for k in ("cell", "p", "q")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            cut = table.num_rows if batch is None else int(starts[-1])
            if cut:
                yield from linked(table.slice(0, cut))
            held = table.slice(cut).to_batches() if cut < table.num_rows else []

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        frame = table.combine_chunks().to_batches()[0]
        for batch in _by_length(frame, frame.schema.get_field_index("vector")):
            col = lambda k, b=batch: np.asarray(b.column(b.schema.get_field_index(k)))
            vectors = batch.column(batch.schema.get_field_index("vector"))
            ids, cell, p, q, own, home, copies, rep = (col(k) for k in ("vec_id", "cell", "p", "q", "own", "home", "copies", "rep"))
            x = _unit(_matrix(vectors, len(vectors[0])))
            change = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            ends = np.append(change[1:], len(ids))
            found_i, found_j = [], []
            small = ends - change <= 48
            # all small groups at once: the pairs of rows at each distance within a group
            group = np.repeat(np.arange(len(change)), ends - change)
            for gap in range(1, int((ends - change)[small].max(initial=1))):
                i = np.flatnonzero((group[:-gap] == group[gap:]) & small[group[:-gap]]) if gap < len(group) else np.zeros(0, np.int64)
                for at in range(0, len(i), 50_000):
                    a = i[at : at + 50_000]
                    ok = np.einsum("nd,nd->n", x[a], x[a + gap]) >= threshold
                    found_i.append(a[ok]), found_j.append(a[ok] + gap)
            for s, e in zip(change[~small].tolist(), ends[~small].tolist(), strict=True):
                i, j = np.nonzero(np.triu(x[s:e] @ x[s:e].T >= threshold, 1))
                found_i.append(i + s), found_j.append(j + s)
            i, j = np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])
            # a block of two parts compares across them only; one row at least is at home
            ok = (home[i] | home[j]) & (ids[i] != ids[j]) & ((p[i] == q[i]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            names = cells(x[used], tables, probes, scale)
            a, b = back[: len(i)], back[len(i) :]
            count = np.zeros(len(used), np.int64)
            for at in range(0, len(i), 100_000):
                sl = slice(at, at + 100_000)
                new = ~_met_before(names[a[sl]], names[b[sl]], cell[i[sl]])
                np.add.at(count, a[sl][new], copies[j[sl]][new])
                np.add.at(count, b[sl][new], copies[i[sl]][new])
            low = _local_components(len(used), a, b, rep[used])
            frame_out = pd.DataFrame({"of": ids[used], "rep": rep[used], "low": low, "links": count}).groupby(["of", "rep", "low"], as_index=False)["links"].sum()
            yield pa.RecordBatch.from_pandas(frame_out, preserve_index=False)

    partial = saved(blocks.mapInArrow(link, "of long, rep long, low long, links long"), "links")
    counts = partial.groupBy("of").agg(F.sum("links").alias("others"))
    # an id with several vectors holds their classes together
    several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a != high").drop("high")
    edges = partial.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(members.join(several, "vec_id").select("a", F.col("rep").alias("b")))
    components = connected_components(edges).withColumnRenamed("node", "rep")
    per_vector = members.join(counts, "of", "left").join(components, "rep", "left").select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    discard(places, classes)
    # rows without a usable vector stay alone, or with their id's other rows
    unused = all_rows.where(~F.coalesce(_good(F.col("vector")), F.lit(False)) | F.col("vec_id").isNull()).select("vec_id")
    known = per_vector.select("vec_id", "component_id").join(unused.select("vec_id").distinct(), "vec_id", "left_semi").distinct()
    rest = unused.join(known, "vec_id", "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = per_vector.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
