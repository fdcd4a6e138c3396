"""Exact duplicates with counting quotient filters.

A text's 64-bit fingerprint splits into a quotient (its high bits, the
slot) and a remainder. Every partition builds a filter: per occupied slot
a run of sorted remainders, a run-end bit for each entry and a counter. Runs ascend, so filters merge losslessly by merging
sorted remainders, and the slot range can be cut into shards: each task
emits one small filter per shard and each shard is merged on its own. The
whole fingerprint is kept (slot + remainder), so a merged count above one
means equal fingerprints, and only those texts go to byte verification:
they are grouped by their full text, with map-side combining, so a group
of copies shrinks to one row per task before the shuffle.

Edge cases: null and empty texts are equal to each other (both empty);
the largest doc_id of equal texts stays (null ids lose to any other); of
rows that repeat the same doc_id and text one stays; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import U64, checkpointed, partitions, stored

#: remainder bits; the other bits of the fingerprint are the slot
REMAINDER_BITS = 32
FILTERS = "shard long, slots binary, occupied binary, run_ends binary, remainders binary, counters binary"


class CountingQuotientFilter:
    """Sorted runs of remainders by slot, with counters.

    ``occupied`` holds the slots in use (ascending), ``run_ends``
    one bit per remainder, set at the last one of a slot's run; ``counters`` the
    number of times that each fingerprint was added.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints`` ascend and are distinct."""
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sums the counters of equal (slot, remainder) entries."""
        keys = np.concatenate([f.fingerprints for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # a merge of the sorted runs
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return cls(keys[first], np.add.reduceat(counts, first)) if len(keys) else cls(keys, counts)

    def encode(self) -> dict[str, bytes]:
        slots = self.fingerprints >> U64(REMAINDER_BITS)
        last = np.concatenate([slots[1:] != slots[:-1], [True]]) if len(slots) else np.zeros(0, bool)
        used = slots[last]
        return {"slots": len(slots).to_bytes(8, "little"), "occupied": used.astype(np.uint32).tobytes(),
                "run_ends": np.packbits(last).tobytes(),
                "remainders": self.fingerprints.astype(np.uint32).tobytes(),
                "counters": self.counts.astype(np.int64).tobytes() if (self.counts > 1).any() else b""}

    @classmethod
    def decode(cls, slots, occupied, run_ends, remainders, counters) -> CountingQuotientFilter:
        n = int.from_bytes(slots, "little")
        last = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=n).astype(bool)
        run = np.cumsum(last) - last
        high = np.frombuffer(occupied, np.uint32).astype(U64)[run]
        keys = (high << U64(REMAINDER_BITS)) | np.frombuffer(remainders, np.uint32).astype(U64)
        counts = np.frombuffer(counters, np.int64) if counters else np.ones(n, np.int64)
        return cls(keys, counts)

    def shards(self, n: int):
        """(shard, filter of its slot range) for the non-empty ones of n equal ranges."""
        shard = shard_of(self.fingerprints, n)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(shard)]):
            yield int(shard[a]), CountingQuotientFilter(self.fingerprints[a:b], self.counts[a:b])


def shard_of(fingerprints: np.ndarray, n: int) -> np.ndarray:
    return (((fingerprints >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def repeated_fingerprints(hashed: DataFrame, shards: int, batch_rows: int = 1 << 20) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, through merged filters."""

    def build(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(U64))
                rows += batch.num_rows
            if rows >= batch_rows:
                yield from emit(held)
                held, rows = [], 0
        if held:
            yield from emit(held)

    def emit(held):
        whole = CountingQuotientFilter.build(np.concatenate(held))
        out = [{"shard": k, **f.encode()} for k, f in whole.shards(shards)]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("shard", pa.int64()), *((c, pa.binary()) for c in
             ("slots", "occupied", "run_ends", "remainders", "counters"))]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([
            CountingQuotientFilter.decode(*row) for row in
            frame[["slots", "occupied", "run_ends", "remainders", "counters"]].itertuples(index=False)])
        many = whole.counts > 1
        return pd.DataFrame({"fp": whole.fingerprints[many].view(np.int64), "n": whole.counts[many]})

    return (hashed.select("fp").mapInArrow(build, FILTERS)
            .groupBy("shard").applyInPandas(merge, "fp long, n long"))


def _verdicts(docs: DataFrame, shards: int | None) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    hashed = checkpointed(texts.select(
        "doc_id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("text_sha256")))
    repeated = stored(repeated_fingerprints(hashed, shards or partitions(docs.sparkSession)))
    # byte verification: grouping by the text itself compares bytes; the digest then
    # names each verified class, also where two texts share a fingerprint
    classes = (texts.withColumn("fp", F.xxhash64("text")).join(repeated.select("fp"), "fp", "left_semi")
               .groupBy("fp", "text")
               .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return hashed, stored(classes)


def duplicate_classes(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. ``shards``:
    into how many slot ranges the merged filter is cut (default: shuffle partitions)."""
    hashed, classes = _verdicts(docs, shards)
    keep = F.coalesce("keep_id", "doc_id")
    return (hashed.join(classes, ["fp", "text_sha256"], "left")
            .select("doc_id", keep.alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is not that of a row with a larger doc_id; of
    rows that repeat both id and text one stays. All columns stay."""
    hashed, classes = _verdicts(docs, shards)
    losers = stored(hashed.join(classes, ["fp", "text_sha256"])
                    .where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
                    .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct())
    twice = stored(hashed.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
                   .count().where("count > 1").drop("count"))
    named = docs.withColumn("__text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))

    def pick(df, other, how):
        return df.join(other, df["doc_id"].eqNullSafe(other["_id"])
                       & (df["__text_sha"] == other["_sha"]), how)

    rows = pick(named, losers, "left_anti")
    if not twice.isEmpty():
        once = pick(rows, twice, "left_semi").dropDuplicates(["doc_id", "__text_sha"])
        rows = pick(rows, twice, "left_anti").unionByName(once)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
