"""A coarse index for neighbour search: cells around centres.

``fit_cells`` starts from the vectors with the smallest hashes, one a cell,
and moves them by a few steps of k-means on a hash sample of
``SAMPLE_PER_CELL`` vectors a cell (every vector of small tables). Means
are snapped to a binary grid, so the order in which Spark adds does not
show and a retried task or another engine finds the same cells. The number
of cells is the root of the number of vectors unless the caller says
otherwise; the centres are held on the driver and broadcast, so their
number is also bounded by ``MAX_CENTRE_BYTES`` (cells then grow, and the
search cuts large cells into blocks).

``own_cells`` puts every vector into the cell of its nearest centre, and
``probed_cells`` lists for every vector the cells that its search visits:
the ``probes`` nearest ones, and as many more as it takes for them to hold
``least`` vectors, so that a search for k neighbours finds k wherever there
are that many. With roots of n cells, a vector meets about
``probes * sqrt(n)`` candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash

SAMPLE_PER_CELL = 64
MAX_CENTRE_BYTES = 64 << 20
#: centres lie on multiples of 1 / GRID
GRID = 1 << 20
HASH_RANGE = 1 << 32


def cells_for(n: int, dim: int, cells: int | None = None) -> int:
    """Number of cells for ``n`` vectors."""
    wanted = cells or math.ceil(math.sqrt(n))
    return max(1, min(wanted, n, MAX_CENTRE_BYTES // (8 * max(1, dim))))


def squared_distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of all rows to all centres; terms are added in order, as in SQL."""
    total = np.zeros((len(v), len(centres)))
    for d in range(v.shape[1]):
        gap = v[:, d, None] - centres[None, :, d]
        total += gap * gap
    return total


def _assigned(points: DataFrame, centres: np.ndarray, visit, schema: str) -> DataFrame:
    """``visit(distances)`` gives each row's cells; points are (id, v)."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    step = max(1, (1 << 21) // max(1, len(centres)))

    def assign(frames):
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at:at + step]
                v = np.stack(part["v"].to_list())
                yield pd.DataFrame({"id": part["id"], "v": part["v"],
                                    "cell": visit(squared_distances(v, shared.value))})

    return points.select("id", "v").mapInPandas(assign, schema)


def _schema(points: DataFrame, cell: str) -> str:
    return f"id {dict(points.dtypes)['id']}, v array<double>, cell {cell}"


def own_cells(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, cell): the nearest centre; of equally near ones the first."""
    return _assigned(points, centres, lambda d: d.argmin(1).astype(np.int32), _schema(points, "int"))


def fit_cells(points: DataFrame, n: int, dim: int, cells: int | None = None, steps: int = 2,
              seed: int = 0) -> np.ndarray:
    """Centres for the (id, v) rows with distinct vectors."""
    c = cells_for(n, dim, cells)
    order = [portable_hash("id", seed=seed), F.col("id")]
    first = points.select("id", "v").orderBy(*order).limit(c).collect()
    centres = np.array([r["v"] for r in first], float).reshape(len(first), dim)
    share = SAMPLE_PER_CELL * c / n
    sample = points if share >= 1 else points.where(order[0] < int(share * HASH_RANGE))
    sample = sample.select("id", "v").checkpoint(eager=True) if steps else sample
    for _ in range(steps):
        mean = F.floor(F.avg("x") * GRID + 0.5) / float(GRID)
        moved = (own_cells(sample, centres).select("cell", F.posexplode("v").alias("d", "x"))
                 .groupBy("cell", "d").agg(mean.alias("x")).groupBy("cell")
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v")))
        for r in moved.collect():  # a row a cell; empty cells stay where they are
            centres[r["cell"]] = r["v"]
    return centres


def probed_cells(points: DataFrame, centres: np.ndarray, sizes: np.ndarray, probes: int, least: int) -> DataFrame:
    """(id, v, cell): one row for each cell that a vector's search visits."""
    def visit(distances):
        near = np.argsort(distances, axis=1, kind="stable")
        before = np.cumsum(sizes[near], axis=1) - sizes[near]
        keep = (np.arange(near.shape[1])[None, :] < probes) | (before < least)
        return [row[k].tolist() for row, k in zip(near.astype(np.int32), keep)]

    listed = _assigned(points, centres, visit, _schema(points, "array<int>"))
    return listed.select("id", "v", F.explode("cell").alias("cell"))


def cell_sizes(members: DataFrame, n_cells: int) -> np.ndarray:
    """Vectors in each cell (a row a cell comes to the driver)."""
    sizes = np.zeros(n_cells, np.int64)
    for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    return sizes


def candidates_per_point(probed: DataFrame, members: DataFrame) -> float:
    """Mean number of vectors that a search compares with, itself included."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    asked = probed.groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    total = asked.join(sizes, "cell").agg(F.sum(F.col("q") * F.col("m"))).first()[0] or 0
    return total / max(1, members.count())
