"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Each text is the set of its hashed unigrams, bigrams and pairs with one word between. Training goes example by example
with a learning rate for each coordinate and L1 regularisation, which leaves few weights other than zero; these (indices
and values, a few KB) go with the tasks that score all texts.

The sample's texts never reach the driver: tasks turn them into slots, one task fits (the examples come one after the
other, as the method has it), and the live weights alone are collected.

Defined cases: words are lower-cased (A-Z) and cut at ASCII white space and punctuation; a null or empty text scores
the bias alone; without a label of each kind every score is 0; labels other than 0 and 1 and labels without a text are
left out; of several labels of a document the largest counts, of several texts the least. A row without doc_id counts as
held out. Repeated rows give repeated results; other columns are passed on or ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import SIGNS_TOO, free_name, mapped, mix, raw_texts, word_hashes

SLOT_BITS = 20
#: Labelled rows that the weights are fitted on, at most: the first by a hash of their doc_id.
TRAIN_ROWS = 16_000
#: Features (4 bytes each) that the fitting task holds, at most; rows after that are left out of the sample.
TRAIN_SLOTS = 32_000_000


def feature_slots(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature occurrence; bounds: rows' bounds among the words."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows, codes = [row], [mix(words + np.uint64(1))]
    for gap, salt in ((1, 0x51ED270B9F1A6C33), (2, 0x2545F4914F6CDD1D)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            codes.append(mix(words[:-gap] * np.uint64(salt) + words[gap:])[same])
    slots = (np.concatenate(codes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return np.concatenate(rows), slots


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last slot is the bias, which is not regularised."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5) -> None:
        self.z, self.n = np.zeros((1 << SLOT_BITS) + 1), np.zeros((1 << SLOT_BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(slots == 1 << SLOT_BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def slots_of(texts: pa.Array) -> list[np.ndarray]:
    """The distinct slots of each text, ascending."""
    row, slot = feature_slots(*word_hashes(*raw_texts(texts), SIGNS_TOO))
    pairs = np.unique(row * (1 << SLOT_BITS) + slot)
    bounds = np.searchsorted(pairs >> SLOT_BITS, np.arange(len(texts) + 1))
    slots = (pairs & ((1 << SLOT_BITS) - 1)).astype(np.uint32)
    return [slots[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def fit(examples: list[np.ndarray], labels: list[int], epochs: int = 3, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias): the weights other than zero.

    A step moves z by less than one while the weight is zero, so a slot that too few examples hold to pass the L1 bound
    never leaves zero nor changes a prediction; such slots are set aside first, and the weights are the same.
    """
    model, bias, rng = Ftrl(), np.array([1 << SLOT_BITS]), np.random.default_rng(seed)
    held = np.zeros((1 << SLOT_BITS) + 1, np.int32)
    for e in examples:
        held[e] += 1
    able = held * epochs > model.l1
    for k, e in enumerate(examples):  # one at a time, so that the whole is never held twice
        examples[k] = e[able[e]]
    for _ in range(epochs):
        for k in rng.permutation(len(examples)).tolist():
            model.learn(np.append(examples[k].astype(np.int64), bias), labels[k])
    slots = np.flatnonzero(able[:-1])
    w = model.weights(slots)
    return slots[w != 0], w[w != 0], float(model.weights(bias)[0])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, slots: int = TRAIN_SLOTS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights from at most ``rows`` labelled rows that are not held out; None without a label of each kind."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = ids.withColumn("place", F.md5(F.col("doc_id").cast("string"))).orderBy("place").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))  # ids: at most ``rows``

    def cut():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in slots_of(batch.column(2))], pa.binary())], names=["place", "label", "slots"])

        return step

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[np.ndarray] = []
        marks: list[int] = []
        room = slots
        for batch in batches:
            data, bounds = raw_texts(batch.column(2))
            held, bounds = data.view(np.uint32).copy(), bounds // 4  # one block a batch, the batch itself goes
            for mark, s, e in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                room -= e - s
                if room >= 0:
                    examples.append(held[s:e]), marks.append(mark)
        if len(set(marks)) == 2:
            live, weights, bias = fit(examples, marks)
            yield pa.RecordBatch.from_arrays([pa.array([*live.tolist(), 1 << SLOT_BITS], pa.int32()), pa.array([*weights.tolist(), bias], pa.float64())], names=["slot", "weight"])

    features = mapped(sample.select("place", "label", "text"), cut, "place string, label int, slots binary", "text")
    found = features.repartition(1).sortWithinPartitions("place").mapInArrow(learn, "slot int, weight double").toArrow()  # the live weights
    if not found.num_rows:
        return None
    live, weights = found.column(0).to_numpy(), found.column(1).to_numpy()
    return live[:-1].astype(np.int64), weights[:-1], float(weights[-1])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float] | None, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """(doc_id, *keep, name) of every row: the score lies between 0 and 1, higher where label 1 is likelier."""
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"a kept column has the name {name}")
    doc_id = "doc_id" if "doc_id" in keep else free_name("doc_id", keep)
    passed = [c for c in keep if c != "text"]
    chosen = docs.select(*([] if "doc_id" in keep else [F.col("doc_id").cast("long").alias(doc_id)]), *(F.col(f"`{c}`") for c in passed), "text")
    kinds = dict(chosen.dtypes)
    out_cols = [c for c in chosen.columns if c != "text" or "text" in keep]

    def make():
        table = np.zeros(1 << SLOT_BITS, np.float32)
        if weights is not None:
            table[weights[0]] = weights[1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            if weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                row, slot = feature_slots(*word_hashes(*raw_texts(batch.column(at)), SIGNS_TOO))
                live = table[slot] != 0
                pairs = np.unique(row[live] * (1 << SLOT_BITS) + slot[live])
                total = np.bincount(pairs >> SLOT_BITS, table[pairs & ((1 << SLOT_BITS) - 1)].astype(np.float64), batch.num_rows) + weights[2]
                scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in out_cols]
            return pa.RecordBatch.from_arrays([*cols, pa.array(scores)], names=[*out_cols, name])

        return step

    return mapped(chosen, make, ", ".join(f"`{c}` {kinds[c]}" for c in out_cols) + f", `{name}` double", "text")
