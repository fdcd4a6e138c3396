"""Lines that occur in many documents, with levelled sorted runs of line hashes.

DataFrame functions only. A line's key is the line without blanks at both
ends, A-Z lower-cased; its digest is two 64-bit hashes of the key. A run is
a table of (digest, number of documents), bucketed by the digest and sorted
inside the buckets. Documents arrive in batches:

1. a batch's distinct (document, digest) rows are merge-anti-joined with the
   run of digests that are known to be frequent, since these need no count;
2. what is left is counted and added as a run of the first level;
3. when a level holds two runs they are compacted: a merge (a full outer
   sort-merge join of two bucketed, sorted tables, without a shuffle) adds
   their counts, digests that reach ``min_docs`` move to the frequent run,
   the others form a run of the next level.

``finish`` merges what is left on all levels; counts are exact, as every
digest below the bound stays in the runs. A new batch can be added later.

Dropping: documents are cut into lines once more, frequent digests give the
numbers of the lines to drop, and these meet their documents again by id
and text hash. A digest that a third of all documents holds is one row of a
run and, on the side of the documents, a join key that Spark can split.

Edge cases: null and empty texts are one empty line; keys shorter than
``min_chars`` code points are never dropped; a line that a document repeats
counts once for it and goes everywhere; each row is a document of its own,
also if it repeats an id; a document that loses all lines is empty; other
columns pass through, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import partitions
from riskloom.sources.store import scratch_path, stored, stored_buckets

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"
DIGEST = ["h1", "h2"]
#: columns that the operator adds on its way; ``n_lines`` and ``n_dropped`` are its results
ID, LINES, DROPPED, T1, T2 = "__ld_id", "__ld_lines", "__ld_dropped", "__ld_t1", "__ld_t2"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    cut = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(cut) == F.length(cut)
    return F.when(ascii_only, F.lower(cut)).otherwise(F.translate(cut, UPPER, UPPER.lower()))


def digest(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def document_digests(docs: DataFrame, text: str = "text", min_chars: int = 1, batch: Column | None = None) -> DataFrame:
    """(h1, h2, batch): one row for each document and each of its distinct keys."""
    keys = F.array_distinct(F.transform(lines_of(F.col(f"`{text}`")), line_key))
    batch = F.lit(0) if batch is None else batch
    return (docs.select(batch.alias("batch"), F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
            .select(*digest(F.col("key")), "batch"))


class LineRuns:
    """Levels of sorted runs. ``add`` takes a batch's (h1, h2) rows, one for each document
    and key; ``frequent`` has the digests found in ``min_docs`` documents or more."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.min_docs, self.buckets = min_docs, buckets or partitions(spark)
        self.levels: list[list[DataFrame]] = [[]]
        self.frequent = self._run(spark.createDataFrame([], "h1 long, h2 long"))

    def _run(self, rows: DataFrame) -> DataFrame:
        return stored_buckets(rows, DIGEST, self.buckets)

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n", "m"), DIGEST, "full")
        return both.select(*DIGEST, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _settle(self, run: DataFrame) -> DataFrame:
        """Moves the run's frequent digests to the frequent run; returns the others."""
        found = run.where(F.col("n") >= self.min_docs).select(*DIGEST)
        if not found.isEmpty():
            grown = self.frequent.join(found, DIGEST, "full").select(*DIGEST)
            self.frequent = self._run(grown)
        return run.where(F.col("n") < self.min_docs)

    def add(self, rows: DataFrame) -> None:
        fresh = rows.select(*DIGEST).join(self.frequent, DIGEST, "left_anti")
        level, run = 0, self._run(fresh.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n")))
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(self._settle(run))
            if len(self.levels[level]) < 2:
                return
            run = self._run(self.merge(*self.levels[level]))
            self.levels[level] = []
            level += 1

    def finish(self) -> DataFrame:
        """Merges the levels into one run; returns the frequent digests."""
        left = [run for level in self.levels for run in level]
        while len(left) > 1:
            left = [self._settle(self._run(self.merge(*left[:2]))), *left[2:]]
        self.levels = [[] for _ in self.levels] + [left]
        return self.frequent


def frequent_digests(docs: DataFrame, min_docs: int, text: str = "text", min_chars: int = 1, batches: int = 4,
                     buckets: int | None = None) -> DataFrame:
    """Digests found in ``min_docs`` documents or more, by way of ``batches`` batches."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    batch = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(batches)).cast("int")
    document_digests(docs, text, min_chars, batch).write.partitionBy("batch").parquet(path)
    written = spark.read.schema("h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, buckets)
    for i in range(batches):
        runs.add(written.where(F.col("batch") == i).select(*DIGEST))
    return runs.finish()


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines whose digest is in ``frequent``; adds ``n_lines`` (before)
    and ``n_dropped``, in place of columns of these names."""
    frequent = stored(frequent)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the text alone decides; the id only spreads the copies of a text over the tasks
    spread = F.xxhash64("doc_id") if "doc_id" in docs.columns else F.lit(0).cast("long")
    names = [spread.alias(ID), F.xxhash64(body).alias(T1), F.xxhash64(F.lit(1), body).alias(T2)]
    each = docs.select(*names, F.posexplode(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    keyed = each.select(ID, T1, T2, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hit = keyed.select(ID, T1, T2, "pos", *digest(F.col("key"))).join(frequent, DIGEST, "left_semi")
    dropped = hit.groupBy(ID, T1, T2).agg(F.collect_set("pos").alias(DROPPED))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    whole = docs.select(*names, *[F.col(f"`{c}`") for c in others], lines_of(F.col(f"`{text}`")).alias(LINES))
    # the lines are an array column below the join, so they are cut once and picked by number
    met = whole.join(dropped, [ID, T1, T2], "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), F.col(DROPPED))
    kept = F.when(F.col(DROPPED).isNull(), F.array_join(LINES, "\n")).otherwise(
        F.array_join(F.transform(numbers, lambda i: F.get(F.col(LINES), i)), "\n"))
    out = [kept.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c in others or c == text]
    return met.select(*out, F.size(LINES).cast("long").alias("n_lines"),
                      F.coalesce(F.size(DROPPED), F.lit(0)).cast("long").alias("n_dropped"))


def drop_frequent_lines(docs: DataFrame, min_docs: int, text: str = "text", min_chars: int = 1,
                        batches: int = 4) -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` documents or more (see ``drop_lines``)."""
    return drop_lines(docs, frequent_digests(docs, min_docs, text, min_chars, batches), text, min_chars)
