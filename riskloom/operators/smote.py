"""k-nearest neighbours (exact, or approximate by hashing) and SMOTE oversampling.

kNN
---
``method`` is the caller's choice and never depends on the data's size:

* ``'exact'`` compares every pair of distinct vectors: the work grows with
  the square of their number. Use it for classes of up to some 100 000.
* ``'cells'`` puts the vectors into about sqrt(n) cells (``operators.cells``)
  and compares each with the members of the ``probes`` cells nearest to
  it, and of more while these hold no more than ``k`` vectors: about
  ``probes * sqrt(n)`` candidates a point, in exact (distance, id) order.
  The share of true neighbours among them depends on how the vectors
  cluster; ``probes`` is the caller's, and recall can be measured against
  ``'exact'``.
* ``'lsh'`` compares only vectors that share a bucket in one of ``tables``
  hash tables; a bucket is the signs of ``bits`` dot products with fixed
  directions, which split the space around the origin. Neighbours are in
  exact (distance, id) order among those candidates; a point may have
  fewer than ``k``.

'lsh' and 'cells' walk the points of a bucket or cell in tiles: points are
dealt by a hash into blocks of about ``block_rows``, and a task compares one
block with another, keeping the k best per point (``nearest``: a product of
matrices leaves few pairs to compute in full). So no task holds more than two
blocks, however large a bucket is, and k rows per point and tile leave it;
pairs are never rows. A vector is sent to as many tiles as its bucket has
blocks. 'exact' has one bucket, where that would send every vector to as many
tiles as there are blocks: there the blocks (of ``HELD_BYTES``) go to the tasks
by broadcast, one after the other, and the points stay where they are, so what
is shuffled and written grows with the points and k rows a point and block.

Repeated vectors are folded first: the search runs over distinct vectors,
each carrying its k+1 smallest ids (a row_number limit that Spark applies
before the shuffle as well as after it). A point's neighbours are then the
other ids of its own vector at distance 0, followed by the k smallest ids
of each of its vector's k nearest distinct vectors, sorted by (distance,
id) inside the row. At most k distinct vectors can contribute to a
point's k nearest ids, so this is exact; and one vector repeated on a
third of the rows is one point of the search.

SMOTE
-----
Minority rows are raised to the majority count. Row i (in hash order)
makes ``n_syn // m`` copies, plus one if i < ``n_syn % m``; copy c takes
neighbour number ``hash(id, c) % n + 1`` of the row's n neighbours (k; in
'lsh' mode those found, or the row itself if none) and the point
``x + u * (neighbour - x)`` with ``u = hash'(id, c) / 2**32``. Every
choice is a hash of (id, copy, seed), so a rerun or a retried task
gives the same rows. Each row's neighbours are gathered next to it before
its copies are made, so no synthetic row is ever shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash, qcol
from riskloom.operators import cells as C
from riskloom.operators.assemble import union_by_name
from riskloom.operators.rank import global_position
from riskloom.session import checkpoint_dir
from riskloom.sources.store import stored

HASH_RANGE = 2 ** 32
BLOCK_ROWS = 8192
#: distances that a tile computes at a time
TILE = 1 << 20
#: columns of a tile that are taken together for a first bound
GROUPS = 16
#: a parent's copies are made in at most this many pieces, dealt over the tasks
PIECES = 16
#: ... and no more than it takes for this many pieces in all
PIECE_ROWS = 8192
#: bytes of vectors that exact search hands to every task at a time
HELD_BYTES = 32 << 20
METHODS = ("exact", "lsh", "cells")


def directions(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Fixed unit-free directions, the same wherever they are computed."""
    return np.round(np.random.default_rng(seed).normal(size=(tables, bits, dim)), 6)


def _dot(v, u):
    """v . u, terms added in order, for a direction given as floats."""
    lits = F.array(*[F.lit(float(c)) for c in u])
    return F.aggregate(F.zip_with(v, lits, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def hash_buckets(pts: DataFrame, tables: int, bits: int, dim: int, seed: int) -> DataFrame:
    """(id, v, t, bucket): each point once per table, with the signs of its dot products."""
    dirs = directions(tables, bits, dim, seed)
    codes = []
    for t in range(tables):
        code = F.lit(0)
        for j in range(bits):
            code = code + F.when(_dot(F.col("v"), dirs[t, j].tolist()) >= 0, F.lit(1 << j)).otherwise(F.lit(0))
        codes.append(F.struct(F.lit(t).alias("t"), code.cast("int").alias("bucket")))
    return pts.select("id", "v", F.inline(F.array(*codes)))


def candidate_pairs(buckets: DataFrame) -> int:
    """Ordered pairs that share a bucket, counted once per table."""
    sizes = buckets.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("s"))
    return sizes.agg(F.sum(F.col("s") * (F.col("s") - 1))).first()[0] or 0


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 5, method: str = "exact", tables: int = 8,
        bits: int = 8, seed: int = 7, block_rows: int | None = None, cells: int | None = None, probes: int = 25,
        steps: int = 2) -> DataFrame:
    """k nearest neighbours within ``df``: (id, nbr_id, rank, dist). All vectors have
    the same length; rows with a missing id or vector are left out. ``tables`` and
    ``bits`` belong to 'lsh', ``cells``, ``probes`` and ``steps`` to 'cells'. ``block_rows``:
    vectors of a block (BLOCK_ROWS; in 'exact' as many as HELD_BYTES hold)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    checkpoint_dir(df.sparkSession)
    pts = df.select(qcol(id_col).alias("id"), qcol(vec_col).cast("array<double>").alias("v")) \
        .where(F.col("v").isNotNull() & F.col("id").isNotNull())
    pts = pts.withColumn("h", F.xxhash64("v"))
    uniq = distinct_vectors(pts, k + 1).checkpoint(eager=True)
    stats = uniq.agg(F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("d0"), F.count(F.lit(1)).alias("n")).first()
    if stats["d"] != stats["d0"]:
        raise ValueError("vectors differ in length")
    search = uniq.select(F.col("uid").alias("id"), "v")
    if method == "cells" and stats["n"]:
        asking, held = searched_cells(search, stats["n"], stats["d"], k, cells, probes, steps, seed)
        near = _tile_topk(_bucketed(asking), _bucketed(held), k, block_rows or BLOCK_ROWS)
    elif method == "lsh":
        search = hash_buckets(search, tables, bits, stats["d"] or 0, seed)
        near = _tile_topk(search, search, k, block_rows or BLOCK_ROWS)
    else:
        near = _all_nearest(search, stats["n"], stats["d"] or 0, k, block_rows)
    pair = lambda d, i: F.struct(d.alias("dist"), i.alias("nbr_id"))
    far = (near.join(uniq.select(F.col("uid").alias("nbr_id"), F.slice("ids", 1, k).alias("nids")), "nbr_id")
           .groupBy(F.col("id").alias("uid"))
           .agg(F.flatten(F.collect_list(F.transform("nids", lambda i: pair(F.col("dist"), i)))).alias("far")))
    own = F.transform("ids", lambda i: pair(F.lit(0.0), i))
    cand = uniq.join(far, "uid", "left").select(
        "h", "v", F.concat(own, F.coalesce(F.col("far"), F.slice(own, 1, 0))).alias("cand"))
    # per point: drop itself, order by (dist, id) inside the row, keep k
    top = pts.join(cand, ["h", "v"]).select("id", F.slice(F.array_sort(
        F.filter("cand", lambda c: c["nbr_id"] != F.col("id"))), 1, k).alias("top"))
    return top.select("id", F.posexplode("top").alias("pos", "c")).select(
        "id", F.col("c.nbr_id").alias("nbr_id"), (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("c.dist").alias("dist"))


def searched_cells(points: DataFrame, n: int, dim: int, k: int, cells: int | None, probes: int, steps: int,
                   seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, v, cell) of the cells that each point's search visits, and of its own cell."""
    centres = C.fit_cells(points, n, dim, cells, steps, seed)
    held = C.own_cells(points, centres).checkpoint(eager=True)
    sizes = C.cell_sizes(held, len(centres))
    return C.probed_cells(points, centres, sizes, probes, k + 1), held


def _bucketed(points: DataFrame) -> DataFrame:
    return points.select("id", "v", F.lit(0).alias("t"), F.col("cell").alias("bucket"))


def distinct_vectors(pts: DataFrame, n_ids: int) -> DataFrame:
    """(h, v, uid, ids): each distinct vector with its ``n_ids`` smallest ids.

    ``pts`` has (id, v, h = hash of v); the hash leads the key so sorts and
    hash tables compare whole arrays only on a collision. The row_number
    limit is planned as a partial WindowGroupLimit before the shuffle, so a
    vector repeated on many rows sends at most ``n_ids`` ids per map task.
    """
    first_ids = Window.partitionBy("h", "v").orderBy("id")
    return (pts.withColumn("_r", F.row_number().over(first_ids)).where(F.col("_r") <= n_ids)
            .groupBy("h", "v").agg(F.min("id").alias("uid"), F.array_sort(F.collect_list("id")).alias("ids")))


def _plain_nearest(a: np.ndarray, b: np.ndarray, own: np.ndarray, k: int):
    """``nearest`` by every distance."""
    rows, cols, dists = [], [], []
    step = max(1, TILE // len(b))
    for at in range(0, len(a), step):
        part = a[at:at + step]
        total = np.zeros((len(part), len(b)))
        for d in range(a.shape[1]):
            gap = part[:, d, None] - b[None, :, d]
            total += gap * gap
        dist = np.sqrt(total)
        mine = np.flatnonzero(own[at:at + step] >= 0)
        dist[mine, own[at + mine]] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(dist, order, axis=1)
        row, place = np.nonzero(np.isfinite(best))
        rows.append(at + row)
        cols.append(order[row, place])
        dists.append(best[row, place])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def nearest(a: np.ndarray, b: np.ndarray, own: np.ndarray, k: int):
    """(row of a, row of b, distance) of the k nearest rows of b to each row of a, by
    (distance, row of b); ``own`` is the row of b that is left out, or -1. Distances that are
    not finite do not count.

    A product of matrices in single precision gives all squared distances up to a bounded
    error. Only pairs that may be among the k nearest within twice that error are computed
    in full, terms added in order as in SQL, so the result is that of comparing all.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    left, right = np.flatnonzero(np.isfinite(a).all(1)), np.flatnonzero(np.isfinite(b).all(1))
    if not len(left) or not len(right):
        return none
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b[right].mean(0)
        x, y = a[left] - middle, b[right] - middle
        nx, ny = (x * x).sum(1), (y * y).sum(1)
        wide = (a[left] ** 2).sum(1) + (b[right] ** 2).sum(1).max()
    if not (nx.max() < 1e30 and ny.max() < 1e30 and wide.max() < 1e300):
        return _plain_nearest(a, b, own, k)
    slack = 8 * (a.shape[1] + 8)
    error = slack * (np.finfo(np.float32).eps * (nx + ny.max()) + np.finfo(float).eps * wide) + 1e-30
    # a row's own square does not change its order: |y|^2 - 2 x.y, by one product
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    y = np.concatenate([-2 * y, ny[:, None]], axis=1).T.astype(np.float32)
    column = np.full(len(b) + 1, -1)
    column[right] = np.arange(len(right))
    skip = column[own[left]]  # the last entry stands for -1
    rows, cols, dists = [], [], []
    step = max(1, TILE // len(right))
    for at in range(0, len(left), step):
        near = x[at:at + step] @ y
        mine = np.flatnonzero(skip[at:at + step] >= 0)
        near[mine, skip[at + mine]] = np.inf
        # the k-th of the least of k or more groups of columns is no less than the k-th of all
        low, wide = near, len(right) // GROUPS
        if wide >= k:
            low = near[:, :wide].copy()
            for j in range(1, GROUPS):
                np.minimum(low, near[:, j * wide:(j + 1) * wide], out=low)
        bound = np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * error[at:at + step] if k < len(right) \
            else np.full(len(near), np.inf)
        row, col = np.divmod(np.flatnonzero(near <= bound[:, None].astype(np.float32)), len(right))
        row, col = left[at + row], right[col]
        total = np.zeros(len(row))
        for d in range(a.shape[1]):
            gap = a[row, d] - b[col, d]
            total += gap * gap
        dist = np.sqrt(total)
        keep = np.flatnonzero(np.isfinite(dist) & (col != own[row]))
        keep = keep[np.lexsort((col[keep], dist[keep], row[keep]))]
        row, col, dist = row[keep], col[keep], dist[keep]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[first])
        cols.append(col[first])
        dists.append(dist[first])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _all_nearest(points: DataFrame, n: int, dim: int, k: int, block_rows: int | None) -> DataFrame:
    """The k nearest (id, nbr_id, dist) of each of ``n`` points (id, v; distinct vectors) among
    all of them. One block of them after the other is broadcast."""
    blocks = max(1, math.ceil(n / max(1, block_rows or HELD_BYTES // (8 * max(1, dim)))))
    spark, schema = points.sparkSession, f"id {dict(points.dtypes)['id']}, nbr_id {dict(points.dtypes)['id']}, dist double"
    if blocks > 1:  # small and many enough pieces for all passes
        points = points.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").checkpoint()

    def among(block: int):
        near = points.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block).toArrow()
        ids, flat = near["id"].to_numpy(), near["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")  # ties in distance go by id
        shared = spark.sparkContext.broadcast((ids[order], flat.reshape(len(ids), dim)[order]))

        def search(frames):
            others, b = shared.value
            for f in frames:
                if len(f) and len(others):
                    own = f["id"].to_numpy()
                    at = np.minimum(np.searchsorted(others, own), len(others) - 1)
                    row, col, dist = nearest(np.stack(f["v"].to_list()).astype(float), b, np.where(others[at] == own, at, -1), k)
                    yield pd.DataFrame({"id": own[row], "nbr_id": others[col], "dist": dist})

        return shared, points.mapInPandas(search, schema)

    if blocks == 1:
        return among(0)[1]
    best = []
    for block in range(blocks):
        shared, found = among(block)
        best.append(stored(found))
        shared.destroy()
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    return union_by_name(best).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _tile_topk(asking: DataFrame, held: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The k nearest (id, nbr_id, dist) of each asking point among those held in the same
    bucket. Both are (id, v, t, bucket) with distinct vectors in a bucket. Where both are
    the same, a tile of two blocks serves the points of both."""
    id_type = dict(asking.dtypes)["id"]
    same = asking is held

    def blocks(points, name):
        return (points.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("s"))
                .select("t", "bucket", F.ceil(F.col("s") / block_rows).cast("int").alias(name), "s"))

    sizes = blocks(asking, "asking_blocks")
    if same:  # a point alone in its bucket meets nobody
        sizes = sizes.where("s > 1").withColumn("held_blocks", F.col("asking_blocks"))
    else:
        sizes = sizes.drop("s").join(blocks(held, "held_blocks").drop("s"), ["t", "bucket"])

    def dealt(points, own, others):
        block = F.pmod(F.xxhash64("id", F.lit("block")), F.col(own)).cast("int")
        return points.join(sizes, ["t", "bucket"]).withColumn("own", block).select(
            "t", "bucket", "own", F.explode(others).alias("other"), "id", "v")

    first, last = F.lit(0), lambda name: F.col(name) - 1
    left = dealt(asking, "asking_blocks", F.sequence(F.col("own") if same else first, last("held_blocks"))) \
        .withColumnsRenamed({"own": "i", "other": "j"})
    right = dealt(held, "held_blocks", F.sequence(first, F.col("own") if same else last("asking_blocks"))).select(
        F.col("t").alias("t2"), F.col("bucket").alias("bucket2"), F.col("other").alias("i2"), F.col("own").alias("j2"),
        F.col("id").alias("id2"), F.col("v").alias("v2"))

    def compare(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "nbr_id": [], "dist": []})
        # ties in distance go by id
        x, y = x.sort_values("id", kind="stable"), y.sort_values("id2", kind="stable")
        a, b = np.stack(x["v"].to_list()).astype(float), np.stack(y["v2"].to_list()).astype(float)
        ids, others = x["id"].to_numpy(), y["id2"].to_numpy()

        def found(points, p_ids, near, n_ids):
            at = np.minimum(np.searchsorted(n_ids, p_ids), len(n_ids) - 1)
            row, col, dist = nearest(points, near, np.where(n_ids[at] == p_ids, at, -1), k)
            return pd.DataFrame({"id": p_ids[row], "nbr_id": n_ids[col], "dist": dist})

        out = found(a, ids, b, others)
        return pd.concat([out, found(b, others, a, ids)]) if same and key[2] != key[3] else out

    best = left.groupBy("t", "bucket", "i", "j").cogroup(right.groupBy("t2", "bucket2", "i2", "j2")).applyInPandas(
        compare, f"id {id_type}, nbr_id {id_type}, dist double").distinct()
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _needed(df: DataFrame, label_col: str, minority, target_count: int | None) -> tuple:
    """(minority, its rows, new rows): the rarest label unless it is given."""
    per_label = df.groupBy(qcol(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    if minority is None:
        minority = per_label.orderBy("n", F.col("y").cast("string")).first()["y"]
    totals = per_label.agg(F.max("n").alias("top"), F.sum(F.when(F.col("y") == F.lit(minority), F.col("n")))
                           .alias("m")).first()
    m = totals["m"] or 0
    goal = target_count if target_count is not None else (totals["top"] or 0)
    return minority, m, max(0, goal - m)


def _with_copies(mins: DataFrame, m: int, n_syn: int, seed: int) -> DataFrame:
    """The minority rows (id, ...) of which copies are made, with their number ``n_copies``."""
    base, extra = divmod(n_syn, m)
    return (global_position(mins, "id", seed=seed, name="pos", n_rows=m)
            .withColumn("n_copies", F.lit(base) + (F.col("pos") < extra).cast("int"))
            .where(F.col("n_copies") > 0))


def _row_key() -> Column:
    return F.concat_ws(":", F.col("id").cast("string"), F.col("copy").cast("string"))


def synthetic_keys(df: DataFrame, id_col: str, label_col: str, seed: int = 0, minority=None,
                   target_count: int | None = None) -> DataFrame:
    """``row_key`` of the rows that ``smote`` makes, without their vectors."""
    minority, m, n_syn = _needed(df, label_col, minority, target_count)
    mins = df.where(qcol(label_col) == F.lit(minority)).select(qcol(id_col).alias("id"))
    if n_syn == 0 or m == 0:
        return mins.select(F.lit("").alias("row_key")).limit(0)
    return (_with_copies(mins, m, n_syn, seed)
            .select("id", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")).select(_row_key().alias("row_key")))


def smote(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, seed: int = 0,
          minority=None, target_count: int | None = None, method: str = "exact", keep=None, **knn_args) -> DataFrame:
    """Synthetic minority rows up to the majority count (``sampling_strategy='auto'``).

    Returns only the new rows: row_key, parent_id, copy, nbr_id, gap,
    label, vector (array<double>). Union them with the input for the
    resampled table. Raises if the minority has no more than ``k`` rows.
    Without ``minority`` the rarest label is found first (one aggregate
    over labels, of which the rarest and the most frequent come back).
    ``keep`` (row_key -> condition) names the new rows that a caller wants:
    the vectors of others are not made.
    """
    minority, m, n_syn = _needed(df, label_col, minority, target_count)
    mins = df.where(qcol(label_col) == F.lit(minority)).select(
        qcol(id_col).alias("id"), qcol(vec_col).cast("array<double>").alias("v"))
    if n_syn == 0:
        return mins.select(F.lit("").alias("row_key"), F.col("id").alias("parent_id"),
                           F.lit(0).alias("copy"), F.col("id").alias("nbr_id"), F.lit(0.0).alias("gap"),
                           F.lit(minority).alias("label"), F.col("v").alias("vector")).limit(0)
    if m <= k:
        raise ValueError(f"the minority has {m} rows; {k} neighbours need more than {k}")
    nn = knn(mins, "id", "v", k, method=method, seed=seed + 7, **knn_args)
    vectors = mins.select(F.col("id").alias("nbr_id"), F.col("v").alias("nv"))
    near = (nn.join(vectors, "nbr_id").groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "nbr_id", "nv"))).alias("near")))
    copies = _with_copies(mins, m, n_syn, seed).join(near, "id", "left")
    itself = F.array(F.struct(F.lit(1).alias("rank"), F.col("id").alias("nbr_id"), F.col("v").alias("nv")))
    copies = copies.withColumn("near", F.coalesce("near", itself))
    # a parent's copies in pieces, so that few parents still fill many tasks; a piece
    # holds the parent and its neighbours, and copies are made where it lands. Many
    # parents fill the tasks as they are: one piece each, which stays where it is
    pieces = min(PIECES, n_syn // m + 1, -(-PIECE_ROWS // m))
    copies = copies.withColumn("piece", F.explode(F.sequence(F.lit(1), F.lit(pieces))))
    if pieces > 1:
        copies = copies.repartition("id", "piece").where(F.col("piece") <= F.col("n_copies"))
    copies = (copies.sortWithinPartitions("id", "piece")  # the same rows in the same order, run by run
              .withColumn("copy", F.explode(F.sequence(F.col("piece"), F.col("n_copies"), F.lit(pieces)))))
    if keep is not None:
        copies = copies.where(keep(_row_key()))
    picks = (copies
             .withColumn("pick", (portable_hash("id", "copy", seed=seed) % F.size("near") + 1).cast("int"))
             .withColumn("gap", portable_hash("id", "copy", seed=seed + 1).cast("double") / float(HASH_RANGE))
             .withColumn("nbr", F.element_at("near", F.col("pick"))))
    vector = F.zip_with("v", F.col("nbr.nv"), lambda a, b: a + F.col("gap") * (b - a))
    return picks.select(_row_key().alias("row_key"),
                        F.col("id").alias("parent_id"), F.col("copy").cast("int").alias("copy"),
                        F.col("nbr.nbr_id").alias("nbr_id"), "gap", F.lit(minority).alias("label"),
                        vector.alias("vector"))
