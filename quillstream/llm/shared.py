"""What several operators need: shared scratch tables, Arrow batches in bounded pieces, text hashing.

Scratch tables stand in ``spark.checkpoint.dir``, which every executor reaches, so a lost executor costs only the
tasks that it ran. Where a local session has no such setting (tests in one process), a folder of this process serves;
a session on a cluster without it gets an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 2 << 20
_own_folder: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="quillstream-")
        root = f"file://{_own_folder}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name``, or with underscores after it, as no column is called, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at ``path``, in whatever file system that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)
    return offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)


def raw_texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' bounds in them; a null is empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    offsets = _offsets(array)
    data = array.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(array: pa.Array) -> list[str]:
    """The rows as Python strings; a null is empty."""
    return [x or "" for x in array.to_pylist()]


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, column: str) -> DataFrame:
    """``mapInArrow`` over slices bounded by bytes of ``column``; ``make`` builds the per-task function.

    Where ``make`` turns the collector of cycles off, it is on again after the task: workers serve other tasks too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        try:
            step = make()
            for piece in pieces(batches, column):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out
        finally:
            if collects:
                gc.enable()

    return df.mapInArrow(run, schema)


# --- hashing of words and word shingles, whole batches at a time ---------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_power_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _power_cache or len(_power_cache["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = np.uint64(1)
        _power_cache.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _power_cache["up"][:n], _power_cache["down"][:n]


#: Blanks for words without signs: white space and ASCII punctuation.
SIGNS_TOO = _SPACE.copy()
SIGNS_TOO[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray, blanks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lowered, cut at ``blanks``: ASCII white space) and the rows' bounds in that list."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    blank = blanks[data]
    head = ~blank
    start = head.copy()
    start[1:] &= blank[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[first] = head[first]
    stop = head.copy()
    stop[:-1] &= blank[1:]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    stop[last] = head[last]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[_LOWER[data]] * up[:n], out=sums[1:])
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(starts, bounds).astype(np.int64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, or one for all of a shorter list; none for no words."""
    if not len(words):
        return words
    span = min(width, len(words))
    count = len(words) - span + 1
    total = np.full(count, np.uint64(span))
    for k in range(span):
        total = total * np.uint64(0xA24BAED4963EE407) + words[k : k + count]
    return mix(total)
