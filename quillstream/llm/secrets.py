"""Secret scanning with an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its content. The ledger holds what each pair of blob and rule
version yielded, the empty yields included, so a run scans only pairs that the ledger lacks; the findings are then
joined back to all paths (here: documents) that hold the blob. Copies are dropped within a task before the shuffle.

Defined cases: a null text is an empty blob without findings; every text is scanned whole; repeated rows give repeated
results; other columns are ignored. Appending a pair twice (a retried run) does no harm: readers take one row of a pair.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.shared import exists, mapped, saved, scratch_path
from quillstream.llm.token_counts import first_in_task

#: Name of the rules below; a change of them takes another name, under which every blob is scanned again.
RULES = "2"
#: Kinds in order. The first three are the base; the others are spans that this method adds.
KINDS = ("assign", "access", "hex", "pem", "jwt")
LEDGER_SCHEMA = "blob string, rules string, findings array<struct<kind: int, start: long, stop: long>>"

_ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def find(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in code points, by start and then kind. Cheap searches of the bytes decide which rules run."""
    raw = text.encode() if raw is None else raw
    lower, out = raw.lower(), []
    if any(w in lower for w in _WORDS):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    gaps = np.flatnonzero(~_IS_HEX[np.frombuffer(raw, np.uint8)])
    if len(raw) >= 32 and np.diff(gaps, prepend=-1, append=len(raw)).max() > 32:
        out += [(2, *m.span()) for m in _HEX.finditer(text)]
    if b"PRIVATE KEY-----" in raw:
        out += [(3, *m.span()) for m in _PEM.finditer(text)]
    if b"eyJ" in raw:
        out += [(4, *m.span()) for m in _JWT.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, ledger_path: str | None = None, rules: str = RULES) -> DataFrame:
    """(doc_id, blob, findings) of every row; see LEDGER_SCHEMA.

    ``ledger_path``: the ledger, kept from run to run; it is made where it isn't there. Without one, the ledger serves
    this call alone.
    """
    spark: SparkSession = docs.sparkSession
    kept = ledger_path is not None and exists(spark, ledger_path)
    ledger_path = ledger_path or scratch_path(spark, "blob-ledger")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    unseen = first_in_task(named, "blob", "text")
    if kept:
        seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).where(F.col("rules") == rules).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")

    def make():
        opener, last = zstandard.ZstdDecompressor(), [None]
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
        schema = pa.schema([("blob", pa.string()), ("rules", pa.string()), ("findings", pa.list_(kind))])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            blobs, found = [], []
            for blob, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob != last[0]:  # equal blobs come one after the other
                    last[0] = blob
                    raw = opener.decompress(packed)
                    blobs.append(blob)
                    found.append([{"kind": k, "start": s, "stop": e} for k, s, e in find(raw.decode(), raw)])
            return pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array([rules] * len(blobs), pa.string()), pa.array(found, pa.list_(kind))], schema=schema)

        return step

    mapped(unseen.repartition("blob").sortWithinPartitions("blob"), make, LEDGER_SCHEMA, "packed").write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).where(F.col("rules") == rules)
    ledger = ledger.select("blob", "findings")
    if kept:  # runs at the same time may have scanned a blob twice; written, so that the join stays one whose hot keys Spark splits
        ledger = saved(ledger.dropDuplicates(["blob"]), "ledger")
    return named.select("doc_id", "blob").join(ledger, "blob").select("doc_id", "blob", "findings")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, from ``scan``'s rows."""
    spell = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, spell), ",")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"), (F.size("findings") - F.size(base)).cast("long").alias("n_added"), F.col("blob"),
    )
