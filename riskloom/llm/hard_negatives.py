"""Hard negatives by inner product, from an STR-packed R-tree.

Vectors are scaled to integers, so scores are exact. The tree is packed by
sort-tile-recursive: the rows are range-partitioned by (label, first
coordinate) into slabs and each slab by the next coordinate into shards;
a shard's task goes on with the other coordinates until tiles of
``leaf_rows`` are left. A tile (a leaf) is one row of the stored index: its
minimum bounding box, ids, labels and vectors. Equal coordinates are told
apart by the id, so one vector on a third of the rows is cut like any other.

Bounding boxes give an interval for each term ``q_i * x_i`` of an inner
product and so an interval for the score. A search task holds one shard's
leaves (with the inner boxes over them) and one block of queries. For each
query a best-first queue takes the box with the highest upper bound next;
a box outside every score window, or strictly below the k-th score of every
window, is left out, and so is one whose labels cannot match. The k best
of each shard are merged by a window over k rows per query and shard.

The anchors are a stated query set; blocks of them meet all shards. First
each anchor's positives are sought, then all windows of an anchor in one
walk: for a positive of score p the negatives' scores lie between
``low`` and ``high`` percent of p.

Edge cases: rows without id, label or vector, or with a null, NaN or
infinite component, take no part; of rows that repeat an id the least by
(label, vector) stays; shorter vectors count as padded with zeros; ties in
score go to the smaller id; a positive of score below 0 has an empty
window; anchors without positives or negatives give no row; an empty
table gives an empty result; extra columns are not read. Components are
64-bit integers and scores are exact below 2**63.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

LEAVES = ("shard int, leaf int, n int, dim int, width int, lows binary, highs binary, label_low long, "
          "label_high long, ids binary, labels binary, vectors binary")
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Settings:
    shard_rows: int = 8192
    leaf_rows: int = 256
    fanout: int = 16
    query_rows: int = 2048


# -- rows ------------------------------------------------------------------------

def integer_rows(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, v): the rows that take part, components as floor(scale * x)."""
    usable = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                      F.when(usable, ints).alias("v"))
            .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
            .groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
            .select("id", "row.label", "row.v"))


def matrix(vectors) -> np.ndarray:
    """int64 rows, padded with zeros to the longest."""
    dim = max((len(v) for v in vectors), default=0)
    if all(len(v) == dim for v in vectors):
        return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


# -- index -----------------------------------------------------------------------

def tiles(keys: np.ndarray, rows: np.ndarray, leaf_rows: int, at: int = 0):
    """Sort-tile-recursive: row numbers of each tile. ``keys``: one column a sort dimension."""
    if len(rows) <= leaf_rows:
        yield rows
        return
    left = max(1, keys.shape[1] - at)
    slabs = max(2, round((len(rows) / leaf_rows) ** (1 / left) + 0.5))
    ordered = rows[np.argsort(keys[rows, at % keys.shape[1]], kind="stable")]
    for part in np.array_split(ordered, slabs):
        yield from tiles(keys, part, leaf_rows, at + 1)


def narrow(a: np.ndarray) -> np.ndarray:
    """The narrowest integer type that holds every value."""
    top = max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0
    return a.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def build_index(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The packed leaves of (id, label, v), written to the shared folder."""
    n_shards = max(1, -(-rows.count() // settings.shard_rows))
    slabs = max(1, round(n_shards ** 0.5))
    slabbed = rows.repartitionByRange(slabs, "label", F.get("v", F.lit(0)), "id").withColumn(
        "slab", F.spark_partition_id())
    sharded = slabbed.repartitionByRange(n_shards, "slab", F.get("v", F.lit(1)), "id").select("id", "label", "v")

    def pack(frames):
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held)
        shard = TaskContext.get().partitionId()
        ids, labels = frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        vectors = matrix(frame["v"].to_list())
        keys = np.column_stack([labels, vectors])
        out = []
        for i, part in enumerate(tiles(keys, np.argsort(ids, kind="stable"), settings.leaf_rows)):
            box = narrow(vectors[part])
            out.append((shard, i, len(part), box.shape[1], box.itemsize,
                        box.min(0).tobytes(), box.max(0).tobytes(), int(labels[part].min()), int(labels[part].max()),
                        ids[part].tobytes(), labels[part].tobytes(), box.tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEAVES.split(", ")])

    return stored(sharded.mapInPandas(pack, LEAVES))


class Tree:
    """One shard's leaves with the inner boxes over them, in packing order."""

    def __init__(self, leaves: pd.DataFrame, fanout: int, dim: int, dtype):
        leaves = leaves.sort_values("leaf")
        kind = {2: np.int16, 4: np.int32, 8: np.int64}
        self.vectors, self.ids, self.labels = [], [], []
        low, high = np.zeros((len(leaves), dim), dtype), np.zeros((len(leaves), dim), dtype)
        for i, r in enumerate(leaves.itertuples(index=False)):
            t = kind[r.width]
            wide = np.zeros((r.n, dim), dtype)
            wide[:, :r.dim] = np.frombuffer(r.vectors, t).reshape(r.n, r.dim)
            low[i, :r.dim], high[i, :r.dim] = np.frombuffer(r.lows, t), np.frombuffer(r.highs, t)
            self.vectors.append(wide)
            self.ids.append(np.frombuffer(r.ids, np.int64))
            self.labels.append(np.frombuffer(r.labels, np.int64))
        first, last = leaves["label_low"].to_numpy(np.int64), leaves["label_high"].to_numpy(np.int64)
        self.levels = [(low, high, first, last)]
        while len(first) > fanout:
            cut = np.arange(0, len(first), fanout)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((low, high, first, last))
        self.fanout = fanout

    def _opened(self, level: int, node: int, q, label: int, same: bool):
        """(upper, lower, child) of a node's boxes whose labels can match."""
        low, high, first, last = self.levels[level]
        a = 0 if node < 0 else node * self.fanout
        b = len(first) if node < 0 else min(len(first), a + self.fanout)
        fits = ((first[a:b] <= label) & (last[a:b] >= label)) if same \
            else ((first[a:b] != label) | (last[a:b] != label))
        for i in np.flatnonzero(fits):
            x, y = q * low[a + i], q * high[a + i]
            yield int(np.maximum(x, y).sum()), int(np.minimum(x, y).sum()), int(a + i)

    def search(self, q, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int):
        """For each (lowest, highest) score window the k best (score, id) of the rows with
        the same, or another, label; the id ``own`` is left out."""
        best = [([], []) for _ in windows]  # scores and ids, best first
        top = len(self.levels) - 1
        queue = [(-u, low, top, c) for u, low, c in self._opened(top, -1, q, label, same)]
        heapq.heapify(queue)
        while queue:
            upper, lower, level, node = heapq.heappop(queue)
            upper = -upper
            reach = [w for w, (a, _) in enumerate(windows)
                     if upper >= a and (len(best[w][0]) < k or upper >= best[w][0][-1])]
            if not reach:  # no later box is higher
                break
            reach = [w for w in reach if lower <= windows[w][1]]
            if not reach:
                continue
            if level:
                for u, low, c in self._opened(level - 1, node, q, label, same):
                    heapq.heappush(queue, (-u, low, level - 1, c))
                continue
            fits = (self.labels[node] == label) == same
            fits &= self.ids[node] != own
            scores, ids = (self.vectors[node] @ q)[fits], self.ids[node][fits]
            for w in reach:
                a, b = windows[w]
                held, whose = best[w]
                least = max(a, held[-1]) if len(held) == k else a
                take = np.flatnonzero((scores >= least) & (scores <= b))
                if len(take):
                    s = np.concatenate([held, scores[take]]).astype(scores.dtype)
                    i = np.concatenate([whose, ids[take]]).astype(np.int64)
                    order = np.lexsort((i, -s))[:k]
                    best[w] = ([int(x) for x in s[order]], [int(x) for x in i[order]])
        return best


# -- search ----------------------------------------------------------------------

def _searched(index: DataFrame, queries: DataFrame, same: bool, k: int, settings: Settings) -> DataFrame:
    """(query, tag, id, score): per query window (``windows``: tag, low, high) and shard the
    k best. ``queries``: id, label, v, windows."""
    n_blocks = max(1, -(-queries.count() // settings.query_rows))
    last_shard = index.agg(F.max("shard")).first()[0] or 0
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    left = index.withColumn("block", F.explode(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(last_shard))))

    def walk(leaves: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(leaves) and len(asked):
            qs = matrix(asked["v"].to_list())
            dim = max(qs.shape[1], int(leaves["dim"].max()))
            if qs.shape[1] < dim:
                qs = np.pad(qs, ((0, 0), (0, dim - qs.shape[1])))
            top = max(max(int(np.abs(np.frombuffer(b, t)).max(initial=0)) for b in (r.lows, r.highs))
                      for r in leaves.itertuples(index=False)
                      for t in ({2: np.int16, 4: np.int32, 8: np.int64}[r.width],))
            most = dim * top * int(np.abs(qs).max(initial=0))
            dtype = np.float64 if most < 1 << 53 else np.int64  # both are exact
            tree = Tree(leaves, settings.fanout, dim, dtype)
            for q, own, label, windows in zip(qs.astype(dtype), asked["id"], asked["label"], asked["windows"]):
                found = tree.search(q, own, label, same, [(w["low"], w["high"]) for w in windows], k)
                for w, (scores, ids) in zip(windows, found):
                    out += [(own, w["tag"], i, s) for s, i in zip(scores, ids)]
        return pd.DataFrame(out, columns=["query", "tag", "id", "score"])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        walk, "query long, tag long, id long, score long")


def positives(index: DataFrame, anchors: DataFrame, k: int, settings: Settings = Settings()) -> DataFrame:
    """(query, id, score, rank): each anchor's k best other rows of its label."""
    all_scores = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(NO_LOW).alias("low"),
                                  F.lit(NO_HIGH).alias("high")))
    found = _searched(index, anchors.withColumn("windows", all_scores), True, k, settings)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("tag")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50,
         high: int = 95, settings: Settings = Settings()) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (see ``integer_rows``): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    rows = stored(rows)
    index = build_index(rows, settings)
    anchors = rows.where(is_anchor)
    pos = stored(positives(index, anchors, n_positives, settings))
    # low% of p and high% of p, rounded inwards
    window = F.struct(F.col("id").alias("tag"), F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)")
                      .alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"))
    asked = anchors.join(pos.withColumn("w", window).where("w.low <= w.high").groupBy(F.col("query").alias("id"))
                         .agg(F.sort_array(F.collect_list("w")).alias("windows")), "id")
    found = _searched(index, asked, False, n_negatives, settings)
    w = Window.partitionBy("query", "tag").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives)
    scores = pos.select("query", F.col("id").alias("tag"), F.col("score").alias("positive_score"))
    return best.join(scores, ["query", "tag"]).select(
        F.col("query").alias("anchor_id"), F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
