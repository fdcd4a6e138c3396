"""Packing token sequences into windows by best-fit decreasing.

Tokenising: texts are cut at ASCII white space (tokens never span it), the
ids of each distinct word come from the tokenizer library once per worker
(bounded cache), and a document's ids are the ragged concatenation, then
the end id. Documents longer than a window are first cut into full
windows, whose checksums are known at once; one remainder per document is
left. Ids never leave the task: only piece rows do.

Packing: remainders are dealt by a hash of their document into groups of
about ``group_pieces`` (so the number of groups grows with the data and a
group has a bounded size); within a group they are placed longest first
into the open window with the least sufficient room, found in a segment
tree over the remaining capacities. Full windows are sequences of their
own. Sequence ids are (group, number) packed into one long.

Edge cases: null and empty texts are the end id alone; equal lengths are
taken in order of doc_id, then row checksum; repeated rows are packed as
documents of their own; an empty table gives an empty result; a sequence
never exceeds the window.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import (
    RaggedCache, checkpointed, distinct_spans, document_of, ragged_take, slices, sums_by, word_spans,
)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: a sequence id is group * SEQUENCES + number within the group
SEQUENCES = 1 << 24


@functools.lru_cache(maxsize=2)
def _tools(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path), RaggedCache(np.uint32)


def _plain_ids(word: str, model) -> list[int] | None:
    """Ids of ASCII letters with at most one full stop or comma behind them, straight
    from the library's pair model: its normaliser and splitter leave those as they are."""
    stem = word[:-1] if word[-1] in ".," else word
    if not (stem.isascii() and stem.isalpha()):
        return None
    ids = [t.id for t in model.tokenize(stem.lower())]
    return ids if stem is word else ids + [t.id for t in model.tokenize(word[-1])]


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of a slice's documents and the number of each."""
    tokenizer, cache = _tools(path)
    starts, ends = word_spans(data, offsets)
    rows = document_of(starts, offsets)
    # the vocabulary lower-cases; special strings are matched before that, so
    # texts that may hold one keep their case in the cache key
    lower = b"<|" not in data.tobytes()
    keys, sample, inverse = distinct_spans(data, starts, ends, lower)

    def make(missing):
        words = [data[starts[i]:ends[i]].tobytes().decode() for i in sample[missing]]
        ids = [_plain_ids(w, tokenizer.model) for w in words]
        rest = [k for k, row in enumerate(ids) if row is None]
        found = tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)
        for k, e in zip(rest, found):
            ids[k] = e.ids
        return [i for row in ids for i in row], [len(row) for row in ids]

    found = cache.resolve(keys, make)
    flat, lengths = ragged_take(cache.pool, cache.offsets, found[inverse])
    return flat, sums_by(rows, len(offsets) - 1, lengths.astype(float)).astype(np.int64)


def cut(ids: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the full windows and of what is left."""
    ids = np.ascontiguousarray(ids, "<u4")
    return [(at, min(window, len(ids) - at), zlib.crc32(ids[at:at + window].tobytes()))
            for at in range(0, len(ids), window)]


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """One row per piece: full windows and a remainder of each document."""

    def run(batches):
        for part, data, offsets in slices(batches):
            flat, counts = token_ids(data, offsets, vocabulary)
            tail = np.array([end_id], np.uint32)
            out, at = [], 0
            for doc_id, n in zip(part.column(0).to_pylist(), counts):
                ids = np.concatenate([flat[at:at + n], tail])
                at += n
                out += [(doc_id, *piece, len(ids)) for piece in cut(ids, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class RoomTree:
    """Segment tree over remaining capacities 0..size: counts of open windows,
    searched for the smallest capacity of at least a given value."""

    def __init__(self, size: int):
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, step: int) -> None:
        at = room + self.base
        while at:
            self.count[at] += step
            at //= 2

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that an open window has."""
        count, at = self.count, need + self.base
        if count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit(lengths, window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths must descend."""
    tree, numbers, offsets, opened = RoomTree(window), [], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room is None:
            room, number = window, opened
            opened += 1
        else:
            number = tree.pop(room)
        numbers.append(number)
        offsets.append(window - room)
        if room > n:
            tree.push(room - n, number)
    return numbers, offsets


def pack(piece_rows: DataFrame, window: int, group_pieces: int = 50_000) -> DataFrame:
    """Place pieces of at most ``window`` tokens; returns them with sequence_id, offset."""
    n = piece_rows.count()
    groups = max(1, -(-n // group_pieces))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "ids_crc32", "start"],
                                  ascending=[False, True, True, True], kind="stable")
        numbers, offsets = best_fit(frame["length"].tolist(), window)
        frame["sequence_id"] = frame["grp"] * SEQUENCES + np.array(numbers, np.int64)
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns="grp")

    # the row checksum spreads repeated doc_ids over the groups as well
    grp = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))
    return piece_rows.withColumn("grp", grp).groupBy("grp").applyInPandas(place, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1,
                   group_pieces: int = 50_000) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(checkpointed(pieces(docs, vocabulary, window, end_id)), window, group_pieces)
