"""Helpers shared by the operators: reading text columns as byte arrays,
hashing words without building Python strings, and writing intermediate
results to the shared checkpoint folder.

Texts arrive in Python workers as Arrow buffers. ``slices`` hands them on
in pieces of bounded size; a document longer than the bound is a slice of
its own. Word hashes are polynomial in the word's bytes modulo 2**64 with
random byte values, mixed at the end, so equal words have equal hashes in
every task and process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir
from riskloom.sources.store import RELEASE, scratch_path, shuffles_released  # noqa: F401

SLICE_BYTES = 4 << 20
#: bytes that are hashed at a time: each takes some forty bytes of arrays, part of which stays
HASH_BYTES = 1 << 20
U64 = np.uint64

#: the six bytes between words: space, tab, line feed, vertical tab, form feed, carriage return
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest piece seen."""
    if len(_POWERS[0]) < n + 1:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _BASE_INVERSE)):
                step = np.full(n + 1, base, U64)
                step[0] = 1
                _POWERS[i] = np.cumprod(step, dtype=U64)
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """Hash of every byte span; spans ascend and do not overlap."""
    out = np.empty(len(starts), U64)
    values = BYTE_VALUE_LOWER if lower else BYTE_VALUE
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        n = int(ends[upto - 1] - base)
        power, inverse = _powers(n)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(values[data[base:base + n]] * power[:n], dtype=U64, out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
        at = upto
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows of the batch, bytes, offsets), each of about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield (batch.slice(at, upto - at), data[offsets[at]:offsets[upto]],
                   offsets[at:upto + 1] - offsets[at])
            at = upto


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes; no run crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    return starts, ends


def document_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each span, given the documents' offsets."""
    return np.searchsorted(offsets, starts, "right") - 1


def sums_by(rows: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions: the caller sizes it with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder in spark.checkpoint.dir and go on from there."""
    checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew: ``df`` was planned before the setting


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: unlike
    after ``checkpoint`` the planner then knows its size."""
    path = scratch_path(df.sparkSession, "table")
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: for small tables that joins may broadcast once their size is known
stored = materialized


def ship_package(spark: SparkSession) -> None:
    """In local mode, let Python workers import this package wherever the driver was
    started. On a cluster the job is submitted with it (``--py-files`` or PYTHONPATH)."""
    sc = spark.sparkContext
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if local and not getattr(sc, "_riskloom_shipped", False):
        import os

        import riskloom
        sc.addFile(os.path.dirname(os.path.abspath(riskloom.__file__)), recursive=True)
        sc._riskloom_shipped = True


class RaggedCache:
    """Values of variable length by 64-bit key, kept sorted, bounded in number.

    ``find`` gives the row of each (sorted, distinct) key or -1; ``add`` takes
    the missing ones. Over the bound the old entries go before new ones come.
    """

    def __init__(self, dtype, bound: int = 1_000_000):
        self.bound, self.dtype = bound, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.rows = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, values: list, lengths: np.ndarray) -> None:
        """``values``: one flat array of the new entries, in the order of ``keys``."""
        rows = np.arange(len(keys), dtype=np.int64) + len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.pool = np.concatenate([self.pool, np.asarray(values, self.dtype)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.rows = np.insert(self.rows, at, rows)

    def resolve(self, keys: np.ndarray, make) -> np.ndarray:
        """Rows of sorted distinct ``keys``; ``make(positions)`` gives (flat values,
        lengths) of those that are not there yet."""
        if len(self.keys) > self.bound:
            self.clear()
        rows = self.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            values, lengths = make(missing)
            self.add(keys[missing], values, np.asarray(lengths, np.int64))
            rows = self.find(keys)
        return rows


def ragged_take(pool: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple:
    """Concatenate the entries ``rows`` of a ragged array; also their lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(offsets[rows] - (ends - lengths), lengths)
    return pool[np.arange(total) + shift], lengths


def distinct_spans(data, starts, ends, lower: bool = False) -> tuple:
    """Distinct span hashes (sorted), a span for each, and the inverse."""
    return np.unique(span_hashes(data, starts, ends, lower), return_index=True, return_inverse=True)
