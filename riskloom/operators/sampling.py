"""Samples and folds from a repeatable hash of the key (no ``rand()``).

The hash is a pure function of (key, seed), so a retried task, a lost
executor or a different partitioning gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash, qcol
from riskloom.operators.rank import global_position

HASH_RANGE = 2 ** 32
#: bits of the hash by which ``hash_cut`` counts rows at a time
CUT_BITS = 16


def hash_sample(df: DataFrame, key: str, fraction: float, seed=0) -> DataFrame:
    """Fraction sample (R1): keep rows whose hash falls below the fraction.
    A pure filter; the row count is close to, not exactly, the fraction."""
    return df.where(portable_hash(key, seed=seed) < F.lit(int(fraction * HASH_RANGE)))


def exact_sample(df: DataFrame, key: str, n: int, seed=0, bucket_bits=None,
                 n_rows: int | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows (R2): the first n in hash order.
    ``n_rows`` (the input's row count, if known) saves a counting job."""
    pos = global_position(df, key, seed, name="_rl_pos", bucket_bits=bucket_bits, n_rows=n_rows)
    return pos.where(F.col("_rl_pos") < n).drop("_rl_pos")


@dataclass(frozen=True)
class HashCut:
    """Where the first rows in hash order end: at the rows of this hash and key, of which
    ``taken`` of ``held`` are among them."""
    seed: int
    hash: int
    key: object
    taken: int
    held: int

    def before(self, key) -> Column:
        h, k = portable_hash(key, seed=self.seed), qcol(key) if isinstance(key, str) else key
        first = k.isNull() | (k < F.lit(self.key)) if self.key is not None else F.lit(False)  # nulls come first
        return (h < F.lit(self.hash)) | ((h == F.lit(self.hash)) & first)

    def at(self, key) -> Column:
        k = qcol(key) if isinstance(key, str) else key
        return (portable_hash(key, seed=self.seed) == F.lit(self.hash)) & k.eqNullSafe(F.lit(self.key))


def hash_cut(keys: DataFrame, key: str, n: int, seed=0) -> HashCut | None:
    """The cut below which the first ``n`` > 0 rows of ``exact_sample`` lie; None: all rows do.
    The rows are filtered by it where they are, so only counts are shuffled: by the high bits
    of the hash, by the low bits within the range of the n-th row, by the keys of its hash."""
    h = keys.select(qcol(key).alias("k"), portable_hash(key, seed=seed).alias("h"))
    low = 32 - CUT_BITS

    def nth(rows, at, place):
        """The value of ``at`` (at most 2**CUT_BITS, or the keys of one hash) that holds the row
        of this place, and the number of rows before it and of it."""
        counts = rows.groupBy(at.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        for r, upto in zip(counts, accumulate(r["n"] for r in counts)):
            if upto > place:
                return r["v"], upto - r["n"], r["n"]
        return None, place, 0

    place = n - 1
    high, before, held = nth(h, F.shiftright("h", low), place)
    if not held:
        return None
    place, of_high = place - before, F.shiftright("h", low) == F.lit(high)
    rest, before, _ = nth(h.where(of_high), F.col("h").bitwiseAND(F.lit((1 << low) - 1)), place)
    place, value = place - before, (high << low) + rest
    k, before, held = nth(h.where(F.col("h") == F.lit(value)), F.col("k"), place)
    return HashCut(seed, value, k, place - before + 1, held)


def kfold(df: DataFrame, key: str, k: int = 5, seed=1001, name: str = "fold",
          bucket_bits=None) -> DataFrame:
    """Shuffled k-fold (R3): fold = position in hash order mod k.
    Fold sizes differ by at most one, like ``KFold(shuffle=True)``."""
    pos = global_position(df, key, seed, name="_rl_pos", bucket_bits=bucket_bits)
    return pos.withColumn(name, (F.col("_rl_pos") % k).cast("int")).drop("_rl_pos")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed=1001,
                     name: str = "fold", bucket_bits=None) -> DataFrame:
    """Stratified k-fold (R4): positions are counted within each label."""
    pos = global_position(df, key, seed, by=label, name="_rl_pos", bucket_bits=bucket_bits)
    return pos.withColumn(name, (F.col("_rl_pos") % k).cast("int")).drop("_rl_pos")
