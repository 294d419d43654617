"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct words that one deletion, replacement or insertion over the observed
alphabet makes of it; those that are words of the vocabulary are its near words, found by a hash join. A candidate is one
edit away by construction, so no distance is computed.

Words are made of letters up to U+00FF, a byte each in Latin-1, and candidates are named by a 64-bit polynomial that an
edit changes in a few operations. Before text is made of a candidate, its name is looked up in a filter of the
vocabulary's names (32 bits a word, FILTER_BITS at most in all, so it goes with the tasks); the filter lets every word
through and few others, and what it lets through meets the vocabulary in the join. Where the vocabulary outgrows the
filter more candidates reach the join and the result stays the same.

A candidate arises once: of equal neighbouring letters the first is deleted, and a letter is inserted before equal ones.

Defined cases: null and empty texts have no runs; a null doc_id stands as no text before the colon; repeated rows count
each; ties go by code point; words of any length take part; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import spans
from quillstream.llm.shared import _powers, discard, mapped, mix, raw_texts, saved

LEAST_LETTERS, LEAST_COUNT, DROP_EVERY = 5, 3, 97
FILTER_BITS, CELLS, WORDS_A_TASK = 28, 1 << 18, 8192
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), 0xC3]] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SECOND = np.uint64(0xA24BAED4963EE407)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the checksums ``before`` it; a byte of all spans at a time."""
    sizes = stops - starts
    order = np.argsort(-sizes, kind="stable")
    short = order[np.searchsorted(-sizes[order], -64) :]
    state = (before ^ np.uint32(0xFFFFFFFF))[short]
    at, left = starts[short], sizes[short]
    live = len(short)
    for k in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left, -k))  # spans longer than k
        now = state[:live]
        state[:live] = _CRC[(now ^ low[at[:live] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.zeros(len(sizes), np.uint32)
    out[short] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[: len(order) - len(short)]:
        out[i] = zlib.crc32(low[starts[i] : stops[i]].tobytes(), int(before[i]))
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters after the planted deletions, of LEAST_LETTERS or more, LEAST_COUNT times or more."""

    def make():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            data, bounds = raw_texts(batch.column(1))
            low = spans.lowered(data)
            inside = _LETTER[low]
            inside[1:] |= low[:-1] == 0xC3
            starts, stops, row = spans.spans(low, bounds, inside)
            wide = np.zeros(len(low) + 1, np.int64)
            np.cumsum(low == 0xC3, out=wide[1:])
            letters = stops - starts - (wide[stops] - wide[starts])
            long = letters >= LEAST_LETTERS
            starts, stops, row, letters = starts[long], stops[long], row[long], letters[long]
            prefix = np.array([zlib.crc32(b"%s:" % (x or "").encode()) for x in batch.column(0).to_pylist()], np.uint32)
            crc = crc32_of(low, starts, stops, prefix[row])
            cut = crc % DROP_EVERY == 0
            shorter = []
            for i in np.flatnonzero(cut & (letters > LEAST_LETTERS)):
                word = low[starts[i] : stops[i]].tobytes().decode()
                gone = int(crc[i]) % len(word)
                shorter.append(word[:gone] + word[gone + 1 :])
            starts, stops = starts[~cut], stops[~cut]
            _, first, n = np.unique(spans.names(low, starts, stops), return_index=True, return_counts=True)
            whole = spans.strings(low, starts[first], stops[first])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([whole, pa.array(shorter, pa.string())]), pa.array(np.r_[n, np.ones(len(shorter), np.int64)])], ["word", "n"])

        return count

    seen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = mapped(seen, make, "word string, n long", "text")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Filter:
    """A set of bits for names: tells most names that aren't in the vocabulary."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.shift, self.cells = np.uint64(64 - bits), cells

    def places(self, names: np.ndarray) -> np.ndarray:
        """Both places of each name, (2, n)."""
        return np.stack([names >> self.shift, (mix(names) * _SECOND) >> self.shift])

    def holds(self, names: np.ndarray) -> np.ndarray:
        """Indices of the names that may be in the vocabulary."""
        at = names >> self.shift
        some = np.flatnonzero(self.cells[at >> np.uint64(3)] & (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        at = (mix(names[some]) * _SECOND) >> self.shift
        return some[(self.cells[at >> np.uint64(3)] & (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))) != 0]


def _matrices(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, letters as Latin-1) of words of one length each time."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.array([len(w) for w in coded])
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        step = max(1, CELLS // size)
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            yield part, np.frombuffer(b"".join(coded[i] for i in part), np.uint8).reshape(len(part), size)


def _text(letters: np.ndarray) -> pa.Array:
    """Rows of Latin-1 as Arrow strings."""
    wide = letters >= 0x80
    sizes = 1 + wide.astype(np.int64)
    ends = np.cumsum(sizes.ravel())
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    flat, two = letters.ravel(), wide.ravel()
    out[ends[~two] - 1] = flat[~two]
    out[ends[two] - 2], out[ends[two] - 1] = 0xC0 | (flat[two] >> 6), 0x80 | (flat[two] & 0x3F)
    offsets = np.zeros(len(letters) + 1, np.int32)
    np.cumsum(sizes.sum(1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def _salt(size: int) -> np.uint64:
    """Tells words of different lengths apart."""
    return np.uint64(size * int(_SECOND) & 0xFFFFFFFFFFFFFFFF)


def _terms(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the words' polynomials (n, size + 1), the powers, and the inverse of the base."""
    up, down = _powers(letters.shape[1] + 2)
    sums = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(_CODE[letters] * up[: letters.shape[1]], 1, out=sums[:, 1:])
    return sums, up, up[1], down[1]


def name_of(letters: np.ndarray) -> np.ndarray:
    """The 64-bit name of each row of letters."""
    return _terms(letters)[0][:, -1] + _salt(letters.shape[1])


def neighbours(letters: np.ndarray, alphabet: np.ndarray, known: Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word's row, letters) of all distinct words one edit away whose names ``known`` holds."""
    n, size = letters.shape
    sums, up, base, back = _terms(letters)
    total, a = sums[:, -1:], _CODE[alphabet]
    if size > LEAST_LETTERS:
        names = sums[:, :-1] + (total - sums[:, 1:]) * back + _salt(size - 1)
        fresh = np.ones((n, size), bool)
        fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, i = np.divmod(known.holds(names.ravel()), size)
        keep = fresh[row, i]
        row, i = row[keep], i[keep]
        places = np.arange(size - 1)
        yield row, letters[row[:, None], places + (places >= i[:, None])]
    step = max(1, CELLS // (len(alphabet) * n))
    for at in range(0, size, step):
        to = min(size, at + step)
        names = (total - _CODE[letters[:, at:to]] * up[at:to] + _salt(size))[:, :, None] + (a * up[at:to, None])
        row, rest = np.divmod(known.holds(names.ravel()), (to - at) * len(alphabet))
        i, c = np.divmod(rest, len(alphabet))
        keep = alphabet[c] != letters[row, at + i]
        row, i, c = row[keep], i[keep] + at, c[keep]
        made = letters[row].copy()
        made[np.arange(len(row)), i] = alphabet[c]
        yield row, made
    for at in range(0, size + 1, step):
        to = min(size + 1, at + step)
        names = (sums[:, at:to] + (total - sums[:, at:to]) * base + _salt(size + 1))[:, :, None] + (a * up[at:to, None])
        row, rest = np.divmod(known.holds(names.ravel()), (to - at) * len(alphabet))
        i, c = np.divmod(rest, len(alphabet))
        i = i + at
        keep = (i == 0) | (letters[row, np.maximum(i - 1, 0)] != alphabet[c])
        row, i, c = row[keep], i[keep], c[keep]
        places = np.arange(size + 1)
        made = letters[row[:, None], np.minimum(places - (places > i[:, None]), size - 1)]
        made[np.arange(len(row)), i] = alphabet[c]
        yield row, made


def _filter_of(words: DataFrame, many: int) -> Filter:
    """The filter of the vocabulary, put together by bit-or in Spark; the driver gets its cells alone."""
    bits = min(FILTER_BITS, max(16, int(32 * many - 1).bit_length()))
    empty = Filter(bits, np.zeros(0, np.uint8))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _matrices(batch.column(0)):
                at = empty.places(name_of(letters)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    marked = words.select("word").mapInArrow(mark, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(1 << max(0, bits - 6), np.int64)
    cells[np.asarray(marked.column("cell"))] = np.asarray(marked.column("bits"))
    return Filter(bits, cells.view(np.uint8))


def near_words(words: DataFrame, many: int) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways. words: a saved table (word, n) of ``many`` rows."""
    alphabet = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()]
    codes = np.array(sorted(ord(c) for c in alphabet), np.uint8)  # 90 letters at most
    known = words.sparkSession.sparkContext.broadcast(_filter_of(words, many))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.column(0).slice(at, 256)
                for mine, letters in _matrices(some):
                    own = some.take(pa.array(mine))
                    for row, made in neighbours(letters, codes, held):
                        if len(row):
                            yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), _text(made)], ["word", "near"])

    dealt = words.select("word").repartition(max(1, -(-many // WORDS_A_TASK)), "word")
    candidates = dealt.mapInArrow(emit, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, twice as far each round. A form counts at least twice its word, so few rounds do."""
    now = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while now.where("moved").limit(1).count():
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = saved(now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form: the near word of largest n (of equal ones the first by code point) where that is at least twice the word's n.
    """
    words = saved(vocabulary(docs), "vocabulary")
    near = near_words(words, words.count())
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    form_n = F.when(-F.col("best.m") >= 2 * F.col("n"), -F.col("best.m"))
    found = saved(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.near")).alias("form")), "variants")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
