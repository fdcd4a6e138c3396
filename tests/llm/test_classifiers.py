"""The parts of the quality and toxicity classifiers against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.llm import quality, toxicity
from riskloom.llm.common import U64, fold_of
from riskloom.llm.features import shape_features

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(fold_of() != 0)


def test_ranking_weights_minimise_the_pair_loss(spark, tables):
    docs, labels = tables
    settings = quality.Settings()
    model = quality.fit(docs, labels, settings=settings)
    sample = quality.labelled_sample(docs, labels, "quality", settings.max_rows)
    rows = quality.featured(sample, shape_features).withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(settings.pairs_per_row))))
    low = sample.where("label = 0").count()
    n = sample.count()
    slots = max(1, min(low, n - low))
    salted = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "salt", F.col("label").cast("int")), F.lit(slots))).collect()
    sides = defaultdict(lambda: ([], []))
    for r in salted:
        sides[r["salt"], r["slot"]][int(r["label"])].append(np.array(r["x"]))
    gaps = np.array([(b - w) / model.scale for worse, better in sides.values() for b in better for w in worse])
    assert len(gaps) > 1000
    # gradient of mean log(1 + exp(-w.d)) + penalty / 2 |w|^2
    slope = -(gaps * (1 / (1 + np.exp(gaps @ model.weights)))[:, None]).mean(0) + settings.penalty * model.weights
    start = -(gaps * 0.5).mean(0)
    assert np.abs(slope).max() < 0.01 * np.abs(start).max()
    # standardised features, and the cut at the share of low labels
    x = {r["doc_id"]: np.array(r["x"]) for r in salted}
    values = np.array(list(x.values()))
    assert np.allclose(model.center, values.mean(0)) and np.allclose(model.scale, np.where(values.std(0) > 1e-9, values.std(0), 1.0))
    assert model.cut == pytest.approx(np.percentile(model.strength(values), 100 * low / n))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for d, v in x.items():
        z = float(np.clip((v - model.center) / model.scale, -8, 8) @ model.weights) - model.cut + np.log(0.3 / 0.7)
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-9)


def test_all_labelled_rows_teach(spark):
    """More than 12 000 labelled rows, of which the last ones by id hash alone are long."""
    n = 13_000
    ids = spark.range(n).withColumn("r", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")))
    rows = ids.select(F.col("id").alias("doc_id"), (F.col("r") % 2).alias("quality"), (F.col("r") % 2).alias("toxic"),
                      F.when((F.col("r") > 12_000) & (F.col("r") % 2 == 1), "late word").otherwise("a b c d").alias("text")).cache()
    assert quality.labelled_sample(rows, rows, "quality").count() == n
    assert quality.labelled_sample(rows, rows, "quality", 100).count() == 100
    model = quality.fit(rows.select("doc_id", "text"), rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(
        spark.createDataFrame([(1, "late word"), (2, "a b c d")], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > got[2]
    settings = toxicity.Settings(least_share=0.01)
    sample = quality.labelled_sample(rows, rows, "toxic", settings.max_rows)
    assert int(toxicity.plain_keys(["late"])[0]) in set(toxicity.learn_lexicon(sample, settings).tolist())


def test_quantile_is_the_exact_percentile(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500).round(1), np.full(300, 0.25), rng.normal(size=7)])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(7)
    for share in (0.0, 0.013, 0.25, 0.5, 0.77, 1.0):
        assert quality.quantile(rows, "x", share) == rows.agg(F.percentile("x", share)).first()[0]


def words_of(text):
    """The operator's words of a text, look-alike characters read as letters."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    starts, ends = toxicity.token_runs(data, np.array([0, len(data)]), toxicity.WORD)
    return [toxicity.PLAIN[data[a:b]].tobytes() for a, b in zip(starts, ends)]


@pytest.mark.parametrize("parts", [1, 40])
def test_lexicon_counts(spark, tables, parts):
    docs, labels = tables
    settings = toxicity.Settings()
    sample = quality.labelled_sample(docs, labels, "toxic", settings.max_rows).repartition(parts).checkpoint()
    learned = toxicity.learn_lexicon(sample, settings)
    toxic, total, n_toxic = defaultdict(int), defaultdict(int), 0
    for r in sample.collect():
        n_toxic += r["label"]
        for w in set(words_of(r["text"] or "")):
            toxic[w] += r["label"]
            total[w] += 1
    least = max(3.0, settings.least_share * n_toxic)
    want = {w for w in total if toxic[w] >= least and toxic[w] >= settings.purity * total[w]}
    taught = set(learned.tolist())
    have = {w for w in total if w.isascii() and int(toxicity.plain_keys([w.decode()])[0]) in taught}
    assert have == {w for w in want if w.isascii()} and len(learned.astype(U64)) >= len(have)


def test_densities_and_proximity():
    insults, second = toxicity.plain_keys(["idiot", "loser"]), toxicity.plain_keys(["you"])
    texts = ["you are an idiot", "an idiot " + "word " * 60 + "you", "IDIOT LOSER fine words", "id1ot", "nothing here", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    x = toxicity.compute(data, offsets, insults, second, np.zeros(0, U64))
    assert np.allclose(x[:, 0], [1 / 4, 1 / 63, 2 / 4, 1.0, 0, 0])      # lexicon density
    assert np.allclose(x[:, 3], np.log1p([1, 1, 2, 1, 0, 0]))            # number of hits
    assert np.allclose(x[:, 4], [1, 0, 0, 0, 0, 0])                      # second person near a hit
    assert np.allclose(x[:, 6], [0, 0, 2 / 4, 0, 0, 0])                  # words in capitals
    assert np.allclose(x[:, 10], [0, 0, 0, 1.0, 0, 0])                   # hits with odd characters


def pool_adjacent(p, y):
    """Least-squares monotone fit: (p, value) of the distinct p, ascending."""
    order = np.argsort(p, kind="stable")
    blocks = []  # [sum, weight, points]
    for v in np.unique(p[order]):
        own = y[p == v]
        blocks.append([own.sum(), len(own), [v]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, points = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + points]
    return {v: s / w for s, w, points in blocks for v in points}


def test_isotonic_calibration(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    sample = quality.labelled_sample(docs, labels, "toxic", 12_000)
    rows = quality.featured(sample, model.features()).where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0)
    held = toxicity.margins(rows, model.trees).select("doc_id", "label", "p").collect()
    p, y = np.array([r["p"] for r in held]), np.array([r["label"] for r in held])
    want = pool_adjacent(p, y)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(held) > 50 and len(set(want.values())) > 1
    assert all(got[r["doc_id"]] == pytest.approx(want[r["p"]], abs=1e-9) for r in held)
