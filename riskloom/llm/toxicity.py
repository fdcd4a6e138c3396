"""Toxicity by gradient-boosted trees over dense features.

Features of a whole text: densities of two lexicons, how near their hits
are to words of the second person, capitals, punctuation, obfuscation
(letters mixed with digits or symbols inside a word) and length. One
lexicon is a list of insults (a parameter); the other is learned from the
training rows: words and word beginnings that occur in at least
``least_share`` of the toxic rows and whose toxic documents are at least
``purity`` of all that have them. Words are compared in lower case with
common look-alikes (0 1 3 4 5 7 @ $) read as letters.

Trees are fitted on one part of the training rows and calibrated by
isotonic regression on the other, so a score is the share of label 1 at
that margin. Fitting uses all labelled rows (a caller may set ``max_rows``:
those of the smallest id hash); scoring reads all rows and whole texts.

Edge cases: null and empty texts have the features of an empty text; null
labels are ignored and several labels of a doc_id count as their largest;
with labels of one kind only every score is that label; without any, 0;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BYTE_VALUE, U64, checkpointed, document_of, mix, slices, span_hashes, sums_by
from riskloom.llm.features import (
    CALL, DIGIT, HIGH, LETTER, LOWERCASE, MARK, UPPER, byte_set, member_of, per_document, share, text_keys,
    token_runs,
)
from riskloom.llm.quality import featured, labelled_sample

INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic scum trash worthless disgusting clown garbage "
    "vermin filth imbecile coward jerk idiota estúpido estúpida imbécil basura escoria asqueroso patético inútil "
    "débile crétin ordure minable abruti connard salaud dumm blöd abschaum versager dreck trottel widerlich"
).split()
SECOND_PERSON = ("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre "
                 "tú ti usted ustedes vos").split()

WORD = LETTER | DIGIT | byte_set(b"@$")
#: look-alikes read as letters, then lower case
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
for _shape, _letter in zip(b"013457@$", b"oieastas"):
    PLAIN[_shape] = _letter
#: byte lengths of the word beginnings that may enter the learned lexicon
BEGINNINGS = (4, 5, 6, 8)
NEAR = 6
#: rows of a task when trees are fitted
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    max_rows: int | None = None
    least_share: float = 0.015
    purity: float = 0.9
    trees: int = 20
    depth: int = 3
    insults: tuple = tuple(INSULTS)


def run_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte runs, look-alikes read as letters, independent of place."""
    return span_hashes(PLAIN[data], starts, ends)


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row per length in BEGINNINGS (hash of the first bytes, 0 where the run is
    shorter) and a last row for the whole run."""
    plain = PLAIN[data]
    out = np.zeros((len(BEGINNINGS) + 1, len(starts)), U64)
    total = np.zeros(len(starts), U64)
    size = ends - starts
    for i in range(max(BEGINNINGS)):
        has = size > i
        at = np.minimum(starts + i, max(len(data) - 1, 0))
        total = np.where(has, mix(total + BYTE_VALUE[plain[at]]), total)
        if i + 1 in BEGINNINGS:
            out[BEGINNINGS.index(i + 1)] = np.where(has, total, U64(0))
    out[-1] = run_keys(data, starts, ends)
    return out


def compute(data, offsets, insults: np.ndarray, second: np.ndarray, learned: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends = token_runs(data, offsets, WORD)
    rows = document_of(starts, offsets)
    words = sums_by(rows, n).astype(float)
    heads = beginnings(data, starts, ends)
    whole = heads[-1]
    listed = member_of(whole, insults)
    taught = np.zeros(len(starts), bool)
    for row in heads:
        taught |= member_of(row, learned) & (row != 0)
    hit = listed | taught

    def inside(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]

    letters, capitals = inside(LETTER[data]), inside(UPPER[data])
    odd = inside((DIGIT | byte_set(b"@$"))[data])
    near = np.zeros(len(starts), bool)
    place = np.flatnonzero(member_of(whole, second))
    if len(place) and hit.any():
        at = np.flatnonzero(hit)
        right = np.minimum(np.searchsorted(place, at), len(place) - 1)
        for side in (right, np.maximum(right - 1, 0)):
            near[at] |= (np.abs(place[side] - at) <= NEAR) & (rows[place[side]] == rows[at])
    of = lambda flags: share(sums_by(rows, n, flags.astype(float)), words)
    chars = per_document(WORD[data] | MARK[data] | CALL[data], offsets)
    hits = sums_by(rows, n, hit.astype(float))
    return np.stack([
        of(listed), of(taught), np.log1p(hits), np.log1p(sums_by(rows, n, listed.astype(float))),
        share(sums_by(rows, n, near.astype(float)), hits),
        share(per_document(UPPER[data], offsets), chars), of((capitals >= 2) & (capitals == letters)),
        share(per_document(CALL[data], offsets), chars), share(per_document(MARK[data], offsets), chars),
        of((odd > 0) & (letters > 0)), of(hit & (odd > 0)), np.log1p(words),
        share(per_document(LOWERCASE[data] | HIGH[data], offsets), chars),
    ], axis=1)


def learn_lexicon(sample: DataFrame, settings: Settings) -> np.ndarray:
    """Hashes of words and beginnings that mark toxic documents of the sample."""

    def run(batches):
        for part, data, offsets in slices(batches):
            label = part.column(2).to_numpy()
            starts, ends = token_runs(data, offsets, WORD)
            rows = document_of(starts, offsets)
            heads = beginnings(data, starts, ends)
            # a beginning and a whole word that hash alike would be one entry: harmless
            keys, owner = heads.ravel(), np.tile(rows, len(heads))
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) \
                if len(keys) else np.zeros(0, bool)
            keys, owner = keys[first], owner[first]
            distinct, inverse = np.unique(keys, return_inverse=True)
            toxic = sums_by(inverse, len(distinct), label[owner])
            total = sums_by(inverse, len(distinct)).astype(float)
            # all keys leave the slice: one that is clean here may be toxic in another
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(toxic), pa.array(total)],
                names=["key", "toxic", "total"])

    toxic = sample.agg(F.sum("label")).first()[0] or 0
    found = (sample.mapInArrow(run, "key long, toxic double, total double").groupBy("key")
             .agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
             .where((F.col("toxic") >= max(3.0, settings.least_share * toxic)) & (F.col("key") != 0)
                    & (F.col("toxic") >= settings.purity * F.col("total"))).select("key").collect())
    return np.unique(np.array([r["key"] for r in found], np.int64).view(U64))


@dataclass
class Detector:
    trees: GBTClassificationModel | None
    calibration: object | None
    constant: float
    insults: np.ndarray
    second: np.ndarray
    learned: np.ndarray

    def features(self):
        insults, second, learned = self.insults, self.second, self.learned
        return lambda data, offsets: compute(data, offsets, insults, second, learned)


def plain_keys(words) -> np.ndarray:
    return text_keys([w.encode().translate(bytes(PLAIN)) for w in words])


def margins(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    """``rows`` (with x) and the trees' probability of label 1."""
    scored = trees.transform(rows.withColumn("features", array_to_vector("x")))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", "x")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Detector:
    """Learn from labelled rows; the caller leaves held-out rows out of ``labels``."""
    sample = checkpointed(labelled_sample(docs, labels, label, settings.max_rows))
    insults, second = plain_keys(settings.insults), plain_keys(SECOND_PERSON)
    detector = Detector(None, None, 0.0, insults, second, learn_lexicon(sample, settings))
    rows = checkpointed(featured(sample, detector.features()))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    grow, tune = rows.where(part != 0), rows.where(part == 0)
    kinds = {r["label"] for r in grow.select("label").distinct().collect()}
    if len(kinds) < 2:
        detector.constant = max(kinds, default=0.0)
        return detector
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=settings.depth,
                            maxIter=settings.trees, seed=7, cacheNodeIds=False)
    detector.trees = learner.fit(checkpointed(grow.select("label", array_to_vector("x").alias("features")))
                                 .coalesce(max(4, rows.count() // FIT_ROWS)))
    held = margins(tune, detector.trees)
    if held.isEmpty():
        held = margins(grow, detector.trees)
    detector.calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(
        held.select("label", "p"))
    return detector


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id and score of every row."""
    if detector.trees is None:
        return docs.select("doc_id", F.lit(detector.constant).alias("score"))
    rows = featured(docs.select("doc_id", "text", F.lit(0.0).alias("label")), detector.features())
    return detector.calibration.transform(margins(rows, detector.trees)).select(
        "doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))
