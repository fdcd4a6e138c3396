"""Ranked lexical search over K2-treaps.

``build_index`` cuts the documents into shards (what one task reads, in
pieces of about ``shard_bytes``) and lays each shard's term-document grid
out as a K2-treap: rows are terms, the most frequent first, columns are
documents by length and id, and a non-empty cell holds the impact of the
term in the document. Each quadtree cell stores four bits (which quarters
are not empty) and the largest impact below it, as the difference from its
parent's; empty quarters take no space, and both are stored compressed. Impacts need only the number of
documents and of terms, so these are counted first; a term's weight depends
on its document frequency and is applied by the search.

``search`` takes items in blocks of bounded bytes. A first job sums the
document frequencies of a block's terms from the shards' dictionaries, a
second one walks the shards. For an item, the row paths of all its terms go
down together: an entry of the queue is a range of documents with the cell
that each term's path has there, its bound the sum of the weighted maxima.
The best entries are opened next, a few at a time; a range whose bound is
below the item's k-th score (or equal, with larger ids only) is not opened.
Single documents have exact scores. The k best found so far in a task bound
its later shards, and each task hands on k rows an item, so the last
window is small.

Score: sum over the item's terms, repeats included, of
``weight * ((10**9 * tf) div (1000 * tf + k1 * m))`` with
``m = 100 - b + (b * n * N) div L`` and
``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))``.

Edge cases: null, empty and term-less texts match nothing and do not count
in N; terms are told apart by 64-bit digests; equal scores rank by ascending
doc_id, a null doc_id last; a repeated document row counts as a document of
its own; items that repeat id and text count once, items that share an id
with other texts are ranked each for itself; extra columns are not read;
empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import U64, document_of, slices, span_hashes, stored

INDEX = "docs binary, terms binary, rows binary, df binary, sizes binary, cells binary, maxima binary"
NO_ID = (1 << 63) - 1

#: bytes of a term: digits, ASCII letters, and everything beyond ASCII
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
POP = np.array([bin(i).count("1") for i in range(16)], np.int32)
BELOW = np.array([0, 1, 3, 7], np.uint8)


@dataclass(frozen=True)
class Settings:
    shard_bytes: int = 8 << 20
    block_bytes: int = 4 << 20
    batch: int = 32
    b: int = 25
    k1: int = 12


@dataclass
class Index:
    shards: DataFrame
    n_docs: int
    n_terms: int


# -- terms -----------------------------------------------------------------------

def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of term bytes; no run crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends


def term_counts(data: np.ndarray, offsets: np.ndarray):
    """Terms of some texts: their distinct digests, and per (text, term) the text, the
    position of the digest and the count."""
    starts, ends = term_spans(data, offsets)
    terms, at = np.unique(span_hashes(data, starts, ends, lower=True), return_inverse=True)
    pairs, tf = np.unique(document_of(starts, offsets) * max(1, len(terms)) + at, return_counts=True)
    return terms, pairs // max(1, len(terms)), pairs % max(1, len(terms)), tf.astype(np.int64)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    def count(batches):
        for _, data, offsets in slices(batches):
            per_text = np.bincount(document_of(term_spans(data, offsets)[0], offsets), minlength=1)
            yield pa.RecordBatch.from_pydict({"docs": [int((per_text > 0).sum())], "terms": [int(per_text.sum())]})

    total = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


# -- K2-treap --------------------------------------------------------------------

def interleave(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Quadtree path of each cell: row and column bits alternating, row bit first."""
    def spread(x):
        x = x.astype(U64)
        for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                     (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << U64(s))) & U64(m)
        return x

    return (spread(rows) << U64(1)) | spread(cols)


def treap(paths: np.ndarray, impacts: np.ndarray, height: int):
    """(sizes, cells, maxima) of the sorted, distinct paths, the levels from the root down."""
    levels, cells = [impacts.astype(np.int32)], []
    for _ in range(height):
        parents = paths >> U64(2)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        cells.append(np.bitwise_or.reduceat(np.left_shift(1, (paths & U64(3)).astype(np.uint8)).astype(np.uint8), first))
        levels.append(np.maximum.reduceat(levels[-1], first))
        paths = parents[first]
    levels, cells = levels[::-1], cells[::-1]
    gaps = [levels[0]] + [np.repeat(up, POP[c]) - own for up, c, own in zip(levels, cells, levels[1:])]
    return np.array([len(x) for x in levels], np.int64), np.concatenate(cells), np.concatenate(gaps)


def packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpacked(data, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd"), dtype)


class Shard:
    """One decoded row of the index."""

    def __init__(self, docs, terms, rows, df, sizes, cells, maxima):
        self.docs = np.frombuffer(docs, np.int64)
        self.terms, self.rows = np.frombuffer(terms, U64), np.frombuffer(rows, np.int32).astype(np.int64)
        sizes = np.frombuffer(sizes, np.int64)
        self.height = len(sizes) - 1
        n_inner, n_cells = int(sizes[:-1].sum()), int(sizes.sum())
        inner = unpacked(cells, n_inner, np.uint8)
        self.cells = np.concatenate([inner, np.zeros(sizes[-1], np.uint8)])
        quarters = POP[inner]
        self.first = np.zeros(n_cells, np.int32)  # of a cell's quarters
        np.cumsum(quarters[:-1], out=self.first[1:n_inner])
        self.first[:n_inner] += sizes[0].astype(np.int32)
        self.maxima, at = unpacked(maxima, n_cells, np.int32).copy(), 0
        for size, below in zip(sizes.tolist(), sizes[1:].tolist()):
            own = self.maxima[at + size:at + size + below]
            np.subtract(np.repeat(self.maxima[at:at + size], quarters[at:at + size]), own, out=own)
            at += size
        # smallest id of each range of documents, by level
        self.width = max(0, int(len(self.docs) - 1).bit_length())
        level = np.full(1 << self.width, NO_ID, np.int64)
        level[:len(self.docs)] = self.docs
        self.least = [level]
        for _ in range(self.width):
            level = level.reshape(-1, 2).min(1)
            self.least.append(level)

    def quarters(self, cells: np.ndarray, rows: np.ndarray, level: np.ndarray, right: int) -> np.ndarray:
        """The cells of the rows' paths one level down, in the left or right half of the
        columns; -1 where there is none."""
        known = np.maximum(cells, 0)
        bits = np.where(cells >= 0, self.cells[known], 0)
        which = (((rows >> (level - 1)) & 1) << 1) | right
        down = self.first[known] + POP[bits & BELOW[which]]
        return np.where((bits >> which) & 1 == 1, down, -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best, batch: int) -> None:
        """Brings an item's best documents of this shard into ``best``."""
        cells = np.zeros(len(rows), np.int64)
        for level in range(self.height, self.width, -1):  # all columns lie on the left
            cells = self.quarters(cells, rows, np.int64(level), 0)
        bound = int(np.where(cells >= 0, self.maxima[cells], 0) @ weights)
        if not self.width:
            best.offer(bound, int(self.docs[0]))
            return
        queue, made = [(-bound, int(self.least[-1][0]), 0, self.width, 0, cells)], 0
        while queue:
            opened = []
            while queue and len(opened) < batch:
                if not best.can_enter(-queue[0][0], queue[0][1]):
                    queue = []
                    break
                opened.append(heapq.heappop(queue))
            if not opened:
                break
            level = np.array([e[3] for e in opened])
            column = np.array([e[4] for e in opened])
            cells = np.stack([e[5] for e in opened])
            for right in (0, 1):
                down = self.quarters(cells, rows[None, :], level[:, None], right)
                bounds = np.where(down >= 0, self.maxima[down], 0) @ weights
                for i in np.flatnonzero(bounds >= max(1, best.score())):
                    at, to, value = int(level[i]) - 1, int(column[i]) * 2 + right, int(bounds[i])
                    if at == 0:
                        best.offer(value, int(self.docs[to]))
                    else:
                        made += 1
                        heapq.heappush(queue, (-value, int(self.least[at][to]), made, at, to, down[i]))


class Best:
    """The k best (score, id): higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def score(self) -> int:
        """Least score that can still enter."""
        return self.held[0][0] if len(self.held) == self.k else 1

    def can_enter(self, score: int, doc: int) -> bool:
        return score > 0 and (len(self.held) < self.k or (score, -doc) > self.held[0])

    def offer(self, score: int, doc: int) -> None:
        if self.can_enter(score, doc):
            (heapq.heappush if len(self.held) < self.k else heapq.heapreplace)(self.held, (score, -doc))


# -- index -----------------------------------------------------------------------

def build_index(docs: DataFrame, settings: Settings = Settings()) -> Index:
    """The K2-treaps of all documents, written to the shared folder."""
    n_docs, n_terms = corpus_size(docs)

    def shard(parts) -> dict:
        ids = np.concatenate([p[0] for p in parts])
        terms = np.unique(np.concatenate([p[1] for p in parts]))
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        text = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        term = np.concatenate([np.searchsorted(terms, p[1])[p[3]] for p in parts])
        tf = np.concatenate([p[4] for p in parts])
        length = np.bincount(text, tf, minlength=len(ids)).astype(np.int64)
        order = np.lexsort((ids, length))
        order = order[length[order] > 0]
        column = np.empty(len(ids), np.int64)
        column[order] = np.arange(len(order))
        df = np.bincount(term, minlength=len(terms))
        row = np.empty(len(terms), np.int64)
        row[np.argsort(-df, kind="stable")] = np.arange(len(terms))
        m = 100 - settings.b + (settings.b * length[text] * n_docs) // max(1, n_terms)
        impact = (1_000_000_000 * tf) // (1000 * tf + settings.k1 * m)
        height = max(1, int(max(len(terms), len(order)) - 1).bit_length())
        paths = interleave(row[term], column[text])
        sort = np.argsort(paths)
        sizes, cells, maxima = treap(paths[sort], impact[sort], height)
        return {"docs": ids[order].tobytes(), "terms": terms.tobytes(), "rows": row.astype(np.int32).tobytes(),
                "df": df.astype(np.int32).tobytes(), "sizes": sizes.tobytes(), "cells": packed(cells),
                "maxima": packed(maxima)}

    def build(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.binary()) for c in INDEX.split(", ")])
        held, size = [], 0
        for rows, data, offsets in slices(batches):
            if held and size + len(data) > settings.shard_bytes:
                yield pa.RecordBatch.from_pylist([shard(held)], schema=schema)
                held, size = [], 0
            ids = rows.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            terms, text, at, tf = term_counts(data, offsets)
            if len(terms):
                held.append((ids, terms, text, at, tf))
                size += len(data)
        if held:
            yield pa.RecordBatch.from_pylist([shard(held)], schema=schema)

    shards = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX))
    return Index(shards, n_docs, n_terms)


# -- search ----------------------------------------------------------------------

def _frequencies(index: Index, wanted: np.ndarray) -> dict[int, int]:
    """Document frequency of each wanted digest that occurs (as many rows as wanted, at most)."""
    def look(batches):
        for batch in batches:
            terms_at, df_at = batch.schema.get_field_index("terms"), batch.schema.get_field_index("df")
            for i in range(batch.num_rows):
                terms = np.frombuffer(batch.column(terms_at)[i].as_buffer(), U64)
                df = np.frombuffer(batch.column(df_at)[i].as_buffer(), np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                hit = terms[at] == wanted
                yield pa.RecordBatch.from_pydict({"term": wanted[hit].view(np.int64), "df": df[at[hit]]})

    found = index.shards.select("terms", "df").mapInArrow(look, "term long, df long").groupBy("term").agg(F.sum("df"))
    return {r[0]: r[1] for r in found.collect()}


def _asked(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct term digests and their counts."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(r) for r in raw])
    terms, text, at, n = term_counts(data, offsets)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(terms[at[a:b]], n[a:b]) for a, b in zip(cut, cut[1:])]


def _search_block(index: Index, ids: list, texts: list[str], k: int, settings: Settings, columns: str) -> DataFrame:
    asked = _asked(texts)
    wanted = np.unique(np.concatenate([np.zeros(0, U64), *[t for t, _ in asked]]))
    df = _frequencies(index, wanted)
    queries = []
    for no, (terms, n) in enumerate(asked):
        weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) if t in df else 0
                            for t in terms.view(np.int64).tolist()], np.int64) * n
        queries.append((no, terms[weights > 0], weights[weights > 0]))

    def walk(batches):
        best = [Best(k) for _ in queries]
        for batch in batches:
            names = [c.split()[0] for c in INDEX.split(", ")]
            for i in range(batch.num_rows):
                shard = Shard(*[batch.column(batch.schema.get_field_index(c))[i].as_buffer() for c in names])
                for no, terms, weights in queries:
                    at = np.minimum(np.searchsorted(shard.terms, terms), len(shard.terms) - 1)
                    hit = shard.terms[at] == terms
                    if hit.any():
                        shard.search(shard.rows[at[hit]], weights[hit], best[no], settings.batch)
        out = [(no, score, -doc) for no, b in enumerate(best) for score, doc in b.held]
        if out:
            no, score, doc = zip(*out)
            yield pa.RecordBatch.from_pydict({
                "no": pa.array(no, pa.int32()), "item_id": pa.array([ids[i] for i in no], pa.int64()),
                "doc_id": pa.array([None if d == NO_ID else d for d in doc], pa.int64()),
                "score": pa.array(score, pa.int64())})

    found = index.shards.mapInArrow(walk, columns)
    w = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def search(index: Index, items: DataFrame, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    columns = "no int, item_id long, doc_id long, score long"
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    items = stored(items)
    n_bytes = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // settings.block_bytes))
    out = None
    for block in range(n_blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        held.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        found = _search_block(index, [r["item_id"] for r in held], [r["text"] for r in held], k, settings, columns)
        if n_blocks > 1:
            found = stored(found)
        out = found if out is None else out.unionByName(found)
    return out
