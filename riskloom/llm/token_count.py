"""Token counts by rank-synchronous merging of byte pairs.

Texts are cut at places where the split pattern always cuts (before a
space that follows a visible byte, around single line feeds); each
distinct chunk is split by the pattern once, and the distinct pre-tokens
of a slice are merged together: all are held in one flat symbol array
with ragged offsets, every round finds the lowest-rank pair of each
sequence, merges all its occurrences at once, and drops sequences without
a pair. The surviving symbols are the tokens. Chunk counts are kept in a
bounded cache per worker.

Edge cases: null and empty texts have 0 bytes and 0 tokens; the special
string inside a text is one token (the library's default); repeated rows
give repeated rows; extra columns are not read; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import IS_SPACE, RaggedCache, distinct_spans, document_of, slices, sums_by

# The split pattern of byte-level pair vocabularies; white space is spelt
# out as Unicode's White_Space property.
SPACE_CLASS = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE_CLASS + r"\p{L}\p{N}]+|["
           + SPACE_CLASS + r"]+(?![^" + SPACE_CLASS + r"])|[" + SPACE_CLASS + r"]+")

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else 256 and up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PairRanks:
    """Merge table of a byte-level pair vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.none = len(pairs)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        names = np.arange(len(tokens))
        keep = lengths > 1
        symbols, lengths, names = symbols[np.repeat(keep, lengths)], lengths[keep], names[keep]
        while len(names):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rank = np.empty(len(symbols), np.int64)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[ends - 1] = self.none
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, lengths)) & (rank < self.none)
            # equal neighbours overlap: of each run of hits take every other one
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit, -1, at))
            hit &= (at - run) % 2 == 1
            where = np.flatnonzero(hit)
            symbols[where] = self.merged[rank[where]]
            gone = np.zeros(len(symbols), bool)
            gone[where + 1] = True
            lengths = lengths - np.add.reduceat(gone, starts, dtype=np.int64)
            symbols = symbols[~gone]
            counts[names] = lengths
            live = (lowest < self.none) & (lengths > 1)
            symbols, lengths, names = symbols[np.repeat(live, lengths)], lengths[live], names[live]
        return counts


@functools.lru_cache(maxsize=2)
def _tools(path: str):
    return PairRanks(path), regex.compile(PATTERN), RaggedCache(np.int32)


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut each document where the pattern cuts in any case."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 2:
        visible = ~IS_SPACE[data] & (data < 128)
        seen = np.concatenate([[False], visible[:-1]])
        ahead = np.concatenate([visible[1:], [False]])
        high = np.concatenate([[False], data[:-1] >= 128])
        cut[:-1] |= (data == 32) & (seen | (high & ahead))
        feed = (data == 10) & seen
        cut[:-1] |= feed
        cut[1:] |= feed & ahead
    marks = np.flatnonzero(cut)
    return marks[:-1], marks[1:]


def count_slice(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each document of a slice."""
    table, pattern, cache = _tools(path)
    starts, ends = chunk_spans(data, offsets)
    rows = document_of(starts, offsets)
    keys, sample, inverse = distinct_spans(data, starts, ends)

    def make(missing):
        chunks = [data[starts[i]:ends[i]].tobytes().decode() for i in sample[missing]]
        owners, words, extra = [], [], np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            parts = [chunk]
            if table.special and table.special.search(chunk):
                parts = table.special.split(chunk)
                extra[k] = len(parts) - 1
            for part in parts:
                # letters with at most a space before them are one pre-token
                found = [part] if part.lstrip(" ").isalpha() and part[1:2] != " " \
                    else pattern.findall(part)
                words += found
                owners += [k] * len(found)
        index: dict[str, int] = {}
        place = [index.setdefault(w, len(index)) for w in words]
        each = table.count([w.encode() for w in index]) if index else np.zeros(0, np.int64)
        total = extra + sums_by(np.array(owners, np.int64), len(chunks),
                                each[place].astype(float) if place else None).astype(np.int64)
        return total, np.ones(len(chunks), np.int64)

    found = cache.resolve(keys, make)
    counts = cache.pool[cache.offsets[found]]
    return sums_by(rows, len(offsets) - 1, counts[inverse].astype(float)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens. ``vocabulary`` is
    the path of a byte-level pair vocabulary, the same on every executor."""

    def run(batches):
        for part, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(np.diff(offsets)),
                 pa.array(count_slice(data, offsets, vocabulary))],
                names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """``count_tokens`` with over_limit: more than ``limit`` tokens."""
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
