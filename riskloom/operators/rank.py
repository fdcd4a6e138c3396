"""Exact global positions without a single-partition window.

``global_position`` numbers rows 0..n-1 in the order of a repeatable
hash of a key and a seed (ties by key). A window with no partition
would pull every row into one task; instead:

1. bucket = high bits of the hash (buckets are contiguous hash ranges),
2. row count per bucket (a partial aggregate, at most 2**bits rows),
3. running total over the bucket counts (tiny) -> bucket offsets,
4. offsets joined back on the bucket (at most 2**bits rows per ``by``
   group; the join shares its partitioning with the window), and
   row_number within each bucket.

The result equals a global ``row_number() over (order by hash, key)``.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash, qcol

HASH_BITS = 32
ROWS_PER_BUCKET = 2_000_000


def bucket_bits_for(n_rows: int) -> int:
    """Bits so that a bucket holds about ``ROWS_PER_BUCKET`` rows."""
    return max(4, math.ceil(math.log2(max(n_rows, 1) / ROWS_PER_BUCKET)))


def global_position(df: DataFrame, key: str, seed=0, by: str | None = None,
                    name: str = "pos", bucket_bits: int | None = None,
                    hash_col: Column | None = None, n_rows: int | None = None) -> DataFrame:
    """Add ``name`` = exact 0-based position in hash order (within ``by``).

    ``key`` must be unique (within ``by``) for the order to be total.
    ``bucket_bits`` None sizes the buckets from ``n_rows`` (counted when
    not given).
    """
    if bucket_bits is None:
        bucket_bits = bucket_bits_for(df.count() if n_rows is None else n_rows)
    h = hash_col if hash_col is not None else portable_hash(key, seed=seed)
    # a struct compares equal to itself also where its field is NULL, so rows of a
    # NULL group are numbered like any other
    part = ["_rl_g"] if by else []
    d = (df.withColumn("_rl_h", h)
         .withColumn("_rl_b", F.shiftright(F.col("_rl_h"), HASH_BITS - bucket_bits)))
    if by:
        d = d.withColumn("_rl_g", F.struct(qcol(by).alias("g")))
    grp = part + ["_rl_b"]
    counts = d.groupBy(*grp).agg(F.count(F.lit(1)).alias("_rl_n"))
    w = Window.partitionBy(*part).orderBy("_rl_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*grp, F.coalesce(F.sum("_rl_n").over(w), F.lit(0)).alias("_rl_off"))
    wi = Window.partitionBy(*grp).orderBy("_rl_h", qcol(key))
    # No broadcast hint: the window below hash-partitions on the same
    # columns, so a shuffled join costs no extra exchange; AQE still
    # broadcasts the offsets when they are measured small.
    out = (d.join(offsets, grp)
           .withColumn(name, (F.col("_rl_off") + F.row_number().over(wi) - 1).cast("bigint")))
    return out.drop("_rl_h", "_rl_b", "_rl_off", "_rl_g")
