"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces are bucketed by length into padded matrices of token ids. In each round every row merges its leftmost
pair of least rank; ranks come from a hashed table of pairs, and rows without a pair left are compacted away.

Defined cases: a null text is an empty one and has no tokens; every text is encoded whole; strings that look like
special tokens are plain text; repeated rows give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import mapped, texts_of

NO_RANK = np.int32(2**31 - 1)
#: Cells of a padded matrix, and the piece length from which a heap replaces the matrix (its rounds would be too many).
MATRIX_CELLS, LONG_PIECE = 1 << 19, 256
#: Remembered words in a task; the memory is emptied when full.
MEMORY = 500_000
#: White space other than a blank or a line feed, and runs of blanks where the pattern looks past the next character.
_SIGNS = frozenset(",.;:!?")
_RARE_SPACE = regex.compile(r"[^\S \n]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id (and so the rank) of what they make."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.mask = np.uint64((1 << max(4, int(4 * len(keys) + 1).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.values = np.full(int(self.mask) + 1, NO_RANK, np.int32)
        slot, todo, made = self._slot(keys), np.arange(len(keys)), np.array(made, np.int32)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            ask = todo[free]
            self.keys[slot[ask]] = keys[ask]  # of several for a slot the last one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = made[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_RANK where a pair makes no token or where padding (-1) takes part."""
        real = (left >= 0) & (right >= 0)
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(keys.shape, NO_RANK, np.int32).ravel()
        keys, todo = keys.ravel(), np.flatnonzero(real.ravel())
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(left.shape)


class ByteBpe:
    """Encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.table, self.whole, self.pattern = PairTable(ranks), ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    # -- pieces to ids
    def encode_pieces(self, found: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct pieces."""
        out, buckets = {}, {}
        for piece in found:
            if (rank := self.whole.get(piece)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) >= LONG_PIECE:
                out[piece] = self._merge_long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4, []).append(piece)
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                self._merge_rows(rows[at : at + step], width, out)
        return out

    def _merge_rows(self, rows: list[bytes], width: int, out: dict[bytes, bytes]) -> None:
        sizes = np.array([len(x) for x in rows])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_id[raw], np.int32(-1))
        which = np.arange(len(rows))
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            over = best == NO_RANK
            if over.any():
                for r, row in zip(which[over].tolist(), ids[over].astype("<i4"), strict=True):
                    out[rows[r]] = row[row >= 0].tobytes()
                keep = ~over
                ids, rank, which, at, best = ids[keep], rank[keep], which[keep], at[keep], best[keep]
                if not len(which):
                    return
            n, w = np.arange(len(at)), ids.shape[1]
            ids[n, at] = best
            move = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ids = np.take_along_axis(ids, move, 1)
            if w == 2:
                rank = np.full((len(at), 1), NO_RANK, np.int32)
                ids = np.concatenate([ids, np.full((len(at), 1), -1, np.int32)], 1)
                continue
            rank = np.take_along_axis(rank, np.minimum(move[:, : w - 2], w - 2), 1)
            right = np.minimum(at, w - 3)
            rank[n, right] = self.table.ranks(ids[n, right], ids[n, right + 1])
            left = np.maximum(at - 1, 0)
            rank[n, left] = self.table.ranks(ids[n, left], ids[n, left + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges by a heap over a linked list, for pieces of very many bytes."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = self.table.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(pair) if r != NO_RANK]
        heapq.heapify(heap)
        known = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.table.ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
            return known[a, b]

        end = len(ids)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= end or rank_of(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end and (new := rank_of(ids[k], ids[after[k]])) != NO_RANK:
                    heapq.heappush(heap, (new, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _cut(self, word: str, said: str) -> list[str]:
        """The pattern's matches in ``said``; letters, alone or before one sign, need no search."""
        if word.isalpha():
            return [said]
        if word[-1:] in _SIGNS and word[:-1].isalpha():
            return [said[:-1], said[-1]]
        return self.pattern.findall(said)

    # -- texts to ids
    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Words are remembered, for the pattern never joins a word to what stands before its blank."""
        if len(self.bare) + len(self.spaced) > MEMORY:
            self.bare.clear(), self.spaced.clear()
        plain = [not ("  " in t or " \n" in t or "\n " in t or "\n\n\n" in t or t.endswith("\n\n") or _RARE_SPACE.search(t)) for t in texts]
        split = [[line.split(" ") for line in t.split("\n")] if p else None for t, p in zip(texts, plain, strict=True)]
        firsts, rests = set(), set()
        for words in split:
            for line in words or ():
                firsts.add(line[0])
                rests.update(line[1:])
        firsts.difference_update(self.bare)
        rests.difference_update(self.spaced)
        firsts.discard("")
        odd = [self.pattern.findall(t) for t, p in zip(texts, plain, strict=True) if not p]
        new = [[(w, self._cut(w, w)) for w in firsts], [(w, self._cut(w, " " + w)) for w in rests]]
        asked = {p for part in new for _, found in part for p in found}
        asked.update(p for found in odd for p in found)
        asked.add("\n")
        asked = {p: p.encode("utf-8", "surrogatepass") for p in asked}
        ids = self.encode_pieces(set(asked.values()))
        for memory, part in ((self.bare, new[0]), (self.spaced, new[1])):
            for w, found in part:
                memory[w] = b"".join([ids[asked[p]] for p in found])
        self.bare[""] = b""
        feed, out, at = ids[b"\n"], [], iter(odd)
        bare, spaced = self.bare, self.spaced
        for words in split:
            if words is None:
                out.append(b"".join([ids[asked[p]] for p in next(at)]))
            else:
                out.append(feed.join([bare[line[0]] + b"".join([spaced[w] for w in line[1:]]) for line in words]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """The encoder of a file, built once in a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Tokens of every whole text: doc_id, n_tokens, digests of the ids and of the bytes they decode to.

    ``with_ids`` adds the ids themselves (``ids``, little-endian unsigned 32-bit). The file is read where a task runs,
    from the installed tokenizer package, so nothing of it is broadcast.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.binary())] if with_ids else [])])

    def make():
        gc.disable()  # the memory holds no cycles, and walking it again and again costs more than the encoding
        coder = encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = coder.encode(texts_of(batch.column(1)))
            back = [hashlib.sha256(coder.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in coded]
            cols = [batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(back)]
            return pa.RecordBatch.from_arrays(cols + ([pa.array(coded, pa.binary())] if with_ids else []), schema=schema)

        return step

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(chosen, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, "text")
