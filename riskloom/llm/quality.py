"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in its features; the probability that one
is preferred to another is the logistic function of the difference of
their strengths. Preference pairs join preferred with other labelled
documents that fall into the same slot of a salted hash, so there are no
more pairs than ``pairs_per_row`` times the labelled rows in expectation,
and no cross join. The weights minimise the logistic loss on feature
differences (no intercept). The cut is a quantile of the training rows'
strengths, at the share of labels 0; it is placed at ``cut_score``, so
score = logistic(strength - cut + logit(cut_score)).

Fitting uses all labelled rows (a caller may set ``max_rows``: those of the
smallest id hash); scoring reads all rows and whole texts. Labels, lang,
source and doc_id are never features. Edge cases: null and empty texts have the
features of an empty text and get a score like any other; labels that are
null are ignored; rows of a doc_id with several labels count as their
largest; with labels of one kind only every score is 0.5; repeated rows
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, slices, stored
from riskloom.llm.features import shape_features


#: rows of (id, label) that are broadcast
BROADCAST_IDS = 4_000_000
#: bytes of text whose features are computed together
SLICE = 1 << 20


@dataclass(frozen=True)
class Settings:
    max_rows: int | None = None
    pairs_per_row: int = 4
    cut_score: float = 0.3
    penalty: float = 1e-4


@dataclass
class Ranking:
    """Weights over standardised features, and the strength at the cut."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    cut_score: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        # features beyond those seen in training count as the farthest seen by far
        return np.clip((rows - self.center) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        shift = np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(self.strength(rows) - self.cut + shift, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int | None = None) -> DataFrame:
    """doc_id, text, label of the labelled documents, all or at most ``max_rows``."""
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max(label).cast("double").alias("label")))
    if max_rows is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = stored(ids.withColumnRenamed("doc_id", "_id"))
    # up to a bound the ids go to the texts; beyond it both are shuffled
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def featured(rows: DataFrame, compute) -> DataFrame:
    """doc_id, label and ``compute``'s features as an array."""

    def run(batches):
        for part, data, offsets in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(list(compute(data, offsets)), pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"])

    return rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Ranking:
    """Learn from labelled rows; the caller leaves held-out rows out of ``labels``."""
    rows = checkpointed(featured(labelled_sample(docs, labels, label, settings.max_rows), shape_features))
    width = F.size("x")
    stats = (rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
             .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect())
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("label")).alias("low"),
                      F.max(width).alias("w")).first()
    n, low = counts["n"], counts["low"] or 0
    if not n or not 0 < low < n:
        return Ranking(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 0.5)
    center = np.array([r["m"] for r in stats])
    scale = np.array([r["s"] if r["s"] > 1e-9 else 1.0 for r in stats])
    slots = max(1, min(int(low), int(n - low)))

    def side(kind, name):
        salted = rows.where(F.col("label") == kind).withColumn(
            "salt", F.explode(F.sequence(F.lit(1), F.lit(settings.pairs_per_row))))
        return salted.select("salt", F.pmod(F.xxhash64("doc_id", "salt", F.lit(int(kind))), F.lit(slots))
                             .alias("slot"), F.col("x").alias(name), F.col("doc_id").alias(f"id_{name}"))

    pairs = side(1.0, "better").join(side(0.0, "worse"), ["salt", "slot"])
    centered = F.array(*[F.lit(float(v)) for v in scale])
    difference = F.zip_with(F.zip_with("better", "worse", lambda a, b: a - b), centered, lambda a, s: a / s)
    flip = F.pmod(F.xxhash64("id_better", "id_worse"), F.lit(2))
    data = pairs.select(difference.alias("d"), flip.alias("flip")).select(
        F.when(F.col("flip") == 1, 0.0).otherwise(1.0).alias("label"),
        array_to_vector(F.when(F.col("flip") == 1, F.transform("d", lambda v: -v)).otherwise(F.col("d")))
        .alias("features"))
    learner = LogisticRegression(fitIntercept=False, standardization=False, regParam=settings.penalty, maxIter=60)
    weights = learner.fit(checkpointed(data)).coefficients.toArray()
    ranking = Ranking(center, scale, weights, 0.0, settings.cut_score)
    strengths = score_with(rows.select("doc_id", F.lit(None).cast("string").alias("text"), "x"), ranking)
    ranking.cut = quantile(strengths, "strength", low / n)
    return ranking


def quantile(rows: DataFrame, column: str, share: float) -> float:
    """Exact quantile between the two nearest values, as ``percentile`` gives it, without all
    values in one task: values are counted, dealt into ranges, and only the ranges that hold
    the two places are numbered."""
    counts = checkpointed(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"))
                          .agg(F.count(F.lit(1)).alias("n")).repartitionByRange("v")
                          .withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    place = (sum(r["n"] for r in parts) - 1) * share

    def value(at: int) -> float:
        before = 0
        for r in parts:
            if before + r["n"] > at:
                break
            before += r["n"]
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
        return (counts.where(F.col("part") == r["part"]).withColumn("upto", upto + before)
                .where(F.col("upto") > at).agg(F.min("v")).first()[0])

    low, high = math.floor(place), math.ceil(place)
    below = value(low)
    return below if low == high else (high - place) * below + (place - low) * value(high)


def score_with(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """Strengths of rows that already hold their features."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(ranking.strength(x))], names=["strength"])

    return rows.mapInArrow(run, "strength double")


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for part, data, offsets in slices(batches, limit=SLICE):
            values = ranking.score(shape_features(data, offsets)) if len(ranking.weights) > 1 \
                else np.full(part.num_rows, ranking.cut_score)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(values)],
                                             names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs`` at or above the cut, with all their columns."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices([batch], limit=SLICE):
                values = ranking.score(shape_features(data, offsets)) if len(ranking.weights) > 1 \
                    else np.full(part.num_rows, ranking.cut_score)
                yield part.filter(pa.array(values >= ranking.cut_score))

    return docs.mapInArrow(run, docs.schema)
