"""Words of Arrow text batches by whole arrays: where they stand, 64-bit names, and the distinct ones as text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillstream.llm.shared import _LOWER, _powers, mix

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SCATTER = mix(np.arange(1, 257, dtype=np.uint64))


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, row) of the maximal runs of bytes marked in ``inside``; no run goes beyond a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[firsts] = inside[firsts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    stop[lasts] = inside[lasts]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, stops, np.searchsorted(bounds, starts, side="right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`spans` of everything between ASCII white space."""
    return spans(data, bounds, _WORD[data])


def names(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit name for the bytes of each span; equal bytes have equal names."""
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_SCATTER[low] * up[: len(low)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def strings(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    sizes = stops - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    held = low[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes()))
