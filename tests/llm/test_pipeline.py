"""The pipeline's stages, one after the other, against plain versions."""

import time

import corpus_pipeline
import pytest
from brute import base_spans, exact_groups, near_components
from pyspark.sql import functions as F

from riskloom.llm import near_dup
from riskloom.llm.common import RELEASE, checkpointed, materialized


def test_stages(spark, small, rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).checkpoint()
        got = out.collect()
        if name == "quality":
            assert 0.6 * len(seen) < len(got) <= len(seen)
        elif name == "exact_dedup":
            assert sorted(r["doc_id"] for r in got) == sorted(max(g) for g in exact_groups(seen).values())
        elif name == "near_dedup":
            want = near_components(seen, 5)
            assert sorted(r["doc_id"] for r in got) == sorted(d for d, (_, c) in want.items() if c == d)
        elif name == "pii":
            assert len(got) == len(seen)
            text = dict(seen)
            for r in got:
                spans = base_spans(text[r["doc_id"]])
                if not spans:
                    assert not any(k in (r["text"] or "") for k in ("[EMAIL]", "[CARD]")) or text[r["doc_id"]]
                for k, a, b in spans:
                    assert f"[{k.upper()}]" in r["text"] or len(spans) > 1
                    assert text[r["doc_id"]][a:b] not in r["text"] or k in ("ip", "card")
        else:
            assert {r["doc_id"] for r in got} == {d for d, _ in seen}
        if name != "packing":
            assert out.columns == docs.columns
        docs, seen = out, [(r["doc_id"], r["text"]) for r in got] if name != "packing" else seen


def test_run_equals_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    found = blocks.getAllBlocks()
    return {n for i in range(found.size()) if (n := found.apply(i).name()).startswith("shuffle_")}


@pytest.mark.parametrize("write", [checkpointed, materialized])
def test_written_steps_leave_no_shuffle_files(spark, write):
    """They go when the step is written, not when the driver next collects its garbage."""
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    step = rows.groupBy("k").count().join(rows.repartition(3, "id"), "k")  # planned before it is written
    before, setting = shuffle_files(spark), spark.conf.get(RELEASE, "false")
    out = write(step)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(RELEASE, "false") == setting
    assert out.count() == 1000 and sorted(out.collect()) == sorted(step.collect())


@pytest.mark.parametrize("links, written", [
    ([], 2), ([(5, 1), (1, 9), (1, 9), (4, 4), (7, 3)], 2), ([(i, i + 1) for i in range(40)], 20)])
def test_components_end_when_all_are_stars(spark, monkeypatch, links, written):
    """Links that are stars already take no step: they are written and looked at once."""
    calls = []
    monkeypatch.setattr(near_dup, "checkpointed", lambda df: calls.append(1) or checkpointed(df))
    got = near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {}
    for a, b in sorted((min(p), max(p)) for p in links if p[0] != p[1]):
        old, new = want.get(b, b), want.get(a, a)
        want |= {a: new, b: new} | {k: min(old, new) for k, v in want.items() if v in (old, new)}
    assert sorted((r["id"], r["root"]) for r in got) == sorted(want.items())
    assert len(calls) <= written


class Seen(Exception):
    pass


def test_all_labels_and_all_documents_teach(spark, small, monkeypatch):
    """No fold of the labels is held out, and the redaction's trees learn from every document:
    base spans of all, planted spans in all."""
    docs = spark.range(1300).selectExpr("id AS doc_id", "concat('write to a', id, '@b.org') AS text")
    got = {}

    def seen(name):
        def stop(*args):
            got[name] = args[-1].select("doc_id").distinct().count()
            raise Seen
        return stop

    monkeypatch.setattr(corpus_pipeline.quality, "fit", seen("labels"))
    monkeypatch.setattr(corpus_pipeline.pii, "planted", seen("planted"))
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.redacted):
        with pytest.raises(Seen):
            stage(spark, docs, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert got == {"labels": labels.select("doc_id").distinct().count(), "planted": 1300}
