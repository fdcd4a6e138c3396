"""Every registered query against a plain version on a small table with edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest
from brute import (
    base_spans, exact_groups, fold, likeness, near_components, sha, unigram,
)

from riskloom.llm import exact_dedup, lm_score, near_dup, packing, pii, quality, sp_nbest, token_count
from riskloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def results(spark, small):
    held = {}

    def get(name):
        if name not in held:
            held[name] = [r.asDict() for r in QUERIES[name](spark, small).collect()]
        return held[name]

    return get


def test_lm_base_and_score(results, rows):
    want, n = unigram(rows)
    held_out = [0.0, 0.0]
    for r in results("op1_lm_bloom"):
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (fold(r["doc_id"]) == 1)
        assert np.isfinite(r["score"]) and r["score"] <= 0
        if r["held_out"]:
            held_out[0] += r["score"]
            held_out[1] += r["base_score"]
    assert held_out[0] > held_out[1]  # pairs make unseen texts likelier
    assert len(results("op1_lm_bloom")) == len(rows)


def test_lm_beyond_broadcast_bounds(spark, small, results):
    """With bounds of one byte: base scores by the join are the same, the filter is pruned."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tiny = lm_score.Settings(max_filter_bytes=1000, max_table_bytes=1)
    model, merged = lm_score.fit(docs.where(lm_score_fold()), tiny)
    assert model.word_keys is None and len(model.filter.bytes) < 4000
    got = {r["doc_id"]: r for r in lm_score.score(docs, model, merged).collect()}
    for r in results("op1_lm_bloom"):
        assert got[r["doc_id"]]["n_known"] == r["n_known"]
        assert got[r["doc_id"]]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)


def test_lm_large_filter_in_passes(spark, small, results, monkeypatch):
    """A filter beyond its bound is read in passes over the texts: equal scores, no (document,
    pair) rows, and no pairs stored but in the filter."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, merged = lm_score.fit(docs.where(lm_score_fold()), lm_score.Settings(max_filter_bytes=60_000), keep_pairs=False)
    assert model.apart and "pair_keys" not in merged.columns
    monkeypatch.setattr(lm_score, "_probed_score", None)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, model, merged).collect()}
    want = {r["doc_id"]: r["score"] for r in results("op1_lm_bloom")}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)
    assert lm_score.shard_groups([(2, 5), (0, 3), (1, 4), (3, 20)], 8) == [[0, 1], [2], [3]]


def lm_score_fold():
    from riskloom.llm.common import fold_of
    return fold_of() != 1


def test_filter_counts_are_never_too_low(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, merged = lm_score.fit(docs)
    low = high = n = 0
    for r in merged.collect():
        keys = np.frombuffer(r["pair_keys"], np.uint64)
        levels = np.frombuffer(r["pair_levels"], np.uint8)
        read = model.filter.levels(keys)
        low += int((read < levels).sum())
        high += int((read > levels).sum())
        n += len(keys)
    assert low == 0 and high < 0.05 * n
    absent = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert (model.filter.levels(absent) > 0).mean() < 0.03


def test_levels_are_monotone():
    counts = np.arange(1, 5000)
    levels = lm_score.level_of(counts, 1.5)
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    values = lm_score.level_values(1.5)
    assert values[0] == 0 and values[1] == 1 and (np.diff(values[:40]) >= 0).all()


def test_pii_base_spans(results, rows):
    text = dict(rows)
    for r in results("op2_pii"):
        spans = base_spans(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha(joined), (r, joined[:200])
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        every = r["spans"].split(",") if r["spans"] else []
        assert set(joined.split(",") if joined else []) <= set(every)
        assert len(every) <= len(spans) + 6


def test_pii_trees_and_redaction(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {r["doc_id"]: r for r in pii.redact(docs, pii.Detector(None, 2.0)).collect()}
    assert out[100013]["text"].startswith("mail [EMAIL], [EMAIL][EMAIL] [IP] 256.1.1.1 [IP].5.6.7.8"[:27])
    assert "example.com" not in out[100013]["text"] and out[100001]["text"] is None
    assert out[100013]["n_chars"] == len(out[100013]["text"])
    assert out[100013]["spans"] == "s" and out[100013]["base"] == "b" and out[100013]["_id"] == "7"
    assert out[100007]["text"] == "one two three four five six seven eight nine ten"


def test_pii_printed_trees_give_the_model_scores(spark, small):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    data = spark.createDataFrame([(float(a[0] * a[1] > 0.1), a.tolist()) for a in x], "label double, x array<double>")
    data = data.withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(data)
    both = model.transform(data).select(vector_to_array("probability")[1].alias("p"),
                                        F.expr(pii.tree_score(model)).alias("q")).collect()
    assert all(abs(r["p"] - r["q"]) < 1e-9 for r in both)


def test_nbest_matches_the_library(tmp_path):
    """The same scores as the library's own lattice, with its model kind set to unigram."""
    import public_tokenizers
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor

    from riskloom.llm.common import slices
    path = public_tokenizers.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    at = raw.find(b"\x18\x02", raw.find(b"tok_v0"))
    other = SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2:])
    texts = ["hello world", "the the the", "a  b", "x\ny é 日本", "naïve—test!! 123", " lead", "trail ", "▁mark x",
             "Haen as. In reatin this are. Eres thnded ntednd the erthing or"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for _, data, offsets in slices([batch]):
        for text, best in zip(texts, sp_nbest.segment_slice(data, offsets, path, 5)):
            want = [x.score for x in other.nbest_encode_as_proto(text, nbest_size=5).nbests]
            assert np.allclose(want, [s for s, _ in best], rtol=1e-5), text
            table = sp_nbest.PieceTable(path)
            for _, ids in best:
                assert table.decode(ids.tolist()) == other.decode(ids.tolist())


def test_nbest_order_against_all_segmentations():
    import public_tokenizers
    import pyarrow as pa

    from riskloom.llm.common import slices
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = sp_nbest.PieceTable(path)
    texts = ["the cat", "aa aa", "ab c d", "x1 y2", "to be or"]

    def every(ends, b):
        if b == 0:
            return [(0, ())]
        return [(c0 + c, ids + i0) for a, c, ids in ends[b] for c0, i0 in every(ends, a)]

    for _, data, offsets in slices([pa.record_batch([pa.array(texts)], names=["text"])]):
        for text, best in zip(texts, sp_nbest.segment_slice(data, offsets, path, 6)):
            ends = table.edges("▁" + text.replace(" ", "▁"))
            want = sorted(every(ends, len(ends) - 1))[:6]
            assert [(table.score(c), ids[::-1]) for c, ids in want] == [(s, tuple(i.tolist())) for s, i in best]


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_nbest_of_parts_together_equals_one_by_one(n):
    """The batched search and the heap agree: ties, unknown characters, long parts, one character."""
    import public_tokenizers
    table = sp_nbest.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(n)
    texts = ["".join(rng.choice(list("▁abetinorsé日🙂."), size)) for size in [*range(1, 25), 60, 69, 300]]
    texts += ["a" * 50, "▁" * 9, "lll", "🙂🙂", "▁the"]
    lists = sp_nbest.PartLists(table, texts, n)
    for p, text in enumerate(texts):
        want = table.n_best(text, n)
        assert lists.of(p) == want, text
        assert lists.units[p] == want[0][0] // table.STEP
        assert tuple(lists.pool[lists.at[lists.row[p]]:lists.at[lists.row[p] + 1]].tolist()) == want[0][1][::-1]
        assert lists.loss[p] == (float(want[1][0] - want[0][0]) if len(want) > 1 else np.inf)


def test_nbest_does_not_depend_on_earlier_calls():
    """Another N in the same process starts anew."""
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    data = np.frombuffer(b"the cat sat", np.uint8)
    counts = [len(next(iter(sp_nbest.segment_slice(data, np.array([0, 11]), path, n)))) for n in (1, 3, 2)]
    assert counts == [1, 3, 2]


def test_nbest_rows(results, rows):
    text = dict(rows)
    for r in results("op3_sp_nbest"):
        t = text[r["doc_id"]] or ""
        assert r["n_chars"] == len(t) and r["n_best"] == len(r["scores"]) == len(set(r["ids_crc32"]))
        assert r["scores"] == sorted(r["scores"], reverse=True)
        if "▁" not in t:
            assert r["round_trip"] and r["decoded_sha256"] == sha(t), r["doc_id"]


def test_nbest_gives_every_segmentation_and_its_text(spark):
    """All n best ones with their ids and decoded texts, not only checksums and the best one's text."""
    import zlib

    import public_tokenizers
    texts = ["to be or not", "x\ny é 日本🙂", "", None, "the ▁mark", "a" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = sp_nbest.PieceTable(path)
    for r in sp_nbest.n_best(docs, path, n=4).collect():
        text = texts[r["doc_id"]] or ""
        assert r["n_best"] == len(r["ids"]) == len(r["decoded"]) == len(r["restored"]) == (4 if text else 1)
        assert r["n_pieces"] == [len(i) for i in r["ids"]] and len({tuple(i) for i in r["ids"]}) == r["n_best"]
        assert r["ids_crc32"] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in r["ids"]]
        assert r["decoded"] == [table.decode(i) for i in r["ids"]] == [text.replace("▁", " ")] * r["n_best"]
        assert r["restored"] == ["▁" not in text] * r["n_best"]


def test_nbest_query_digests_every_decoding(results, rows):
    for r in results("op3_sp_nbest"):
        assert len(r["decoded_sha256s"]) == r["n_best"] and r["decoded_sha256s"][0] == r["decoded_sha256"]


def test_exact_dedup(results, rows):
    groups = exact_groups(rows)
    text = dict(rows)
    for r in results("op4_exact_dedup"):
        own = groups[text[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (
            max(own), len(own), r["doc_id"] == max(own), sha(text[r["doc_id"]]))
    assert len(results("op4_exact_dedup")) == len(rows)
    assert set(ORACLE) <= set(QUERIES)


def test_counting_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**64, 400, dtype=np.uint64, endpoint=False) for _ in range(5)]
    parts = [np.concatenate([p, p[:50], parts[0][:30]]) for p in parts]
    whole = Counter(np.concatenate(parts).tolist())
    for shards in (1, 7):
        merged: Counter = Counter()
        pieces: dict[int, list] = {}
        for p in parts:
            for k, f in exact_dedup.CountingQuotientFilter.build(p).shards(shards):
                again = exact_dedup.CountingQuotientFilter.decode(*f.encode().values())
                assert (again.fingerprints == f.fingerprints).all() and (again.counts == f.counts).all()
                pieces.setdefault(k, []).append(again)
        for fs in pieces.values():
            f = exact_dedup.CountingQuotientFilter.merge(fs)
            merged.update(dict(zip(f.fingerprints.tolist(), f.counts.tolist())))
        assert merged == whole


def test_drop_copies_keeps_one_row_of_each_text(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r["text"] or "") for r in got) == sorted(exact_groups(rows))
    assert all(r["doc_id"] == max(exact_groups(rows)[r["text"] or ""]) for r in got)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_dedup(spark, small, rows, shingle):
    want = near_components(rows, shingle)
    got = near_dup.near_duplicates(spark.read.parquet(f"{small}/documents.parquet"), shingle).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_dedup_long_chains(spark):
    """Each text is near the next one only: one component, through many hops."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[i * 8:i * 8 + 120]) for i in range(20)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(5000, " ".join(base[300:]))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    want = near_components(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) == 2


def test_jaccard_estimates():
    rng = np.random.default_rng(5)
    for overlap in (0.95, 0.8, 0.5, 0.1):
        err = []
        for size in (40, 300, 5000):
            both = rng.integers(0, 2**63, int(size * overlap), dtype=np.uint64)
            rest = [rng.integers(0, 2**63, size - len(both), dtype=np.uint64) for _ in range(2)]
            a, b = (near_dup.mix(np.concatenate([both, r])) for r in rest)
            a, b = np.unique(a), np.unique(b)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = near_dup.estimate(near_dup.sketch_of(a)[None], near_dup.sketch_of(b)[None],
                                    np.array([len(a)]), np.array([len(b)]))[0]
            err.append(abs(got - true))
        assert max(err) < 0.16


def test_packing_against_the_tokenizer(results, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    copies = Counter(d for d, _ in rows)
    pieces = results("op7_packing")
    total: Counter = Counter()
    sequences: dict[int, list] = {}
    for r in pieces:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        total[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == {d: copies[d] * len(ids) for d, ids in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    padding = sum(2048 - sum(n for _, n in p) for p in sequences.values())
    assert padding <= 2048 + 0.01 * sum(total.values())


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    for window in (16, 100):
        lengths = sorted(rng.integers(1, window + 1, 300).tolist(), reverse=True)
        numbers, offsets = packing.best_fit(lengths, window)
        rooms: list[int] = []
        for n, number, offset in zip(lengths, numbers, offsets):
            fits = [r for r in rooms if r >= n]
            if fits:
                assert rooms[number] == min(fits)
            else:
                assert number == len(rooms)
                rooms.append(window)
            assert offset == window - rooms[number]
            rooms[number] -= n


def test_token_counts(results, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(rows)
    for r in results("op8_token_count"):
        t = text[r["doc_id"]] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512), t[:40]


def test_rank_synchronous_merges_random_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    chars = "aab eth.,'  \n\t é日1² x"
    texts = ["".join(rng.choice(list(chars), rng.integers(0, 40))) for _ in range(400)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = token_count.count_slice(data, offsets, path)
    assert got.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_fingerprints(results, rows):
    text = {d: t or "" for d, t in rows}
    ids = sorted((d for d, _ in rows), reverse=True)
    after = {}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        after.setdefault(a, []).append(b)
    prints: dict[str, str] = {}
    got = results("op9_fingerprint")
    assert len(got) == len(rows)
    for r in got:
        own = text[r["doc_id"]]
        half = len(own) // 2
        fits = []
        for other in after[r["doc_id"]]:
            edited = own[:len(own) - half] + text[other][:half]
            fits.append(r["edited_sha256"] == sha(edited) and r["n_chars"] == len(own)
                        and abs(r["near_edited"] - likeness(own, edited)) < 1e-9
                        and abs(r["near_next"] - likeness(own, text[other])) < 1e-9)
        assert any(fits), r["doc_id"]
        assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("name,label,least", [("op10_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, results, small, name, label, least):
    """Scores follow the labels on rows that the fit did not see (sf0.01)."""
    got = {r["doc_id"]: r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[d], y) for d, y in labels.items() if got[d]["held_out"]]
    assert len(held) > 40
    assert all(r["held_out"] == (fold(d) == 0) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert np.mean([r["predicted"] == y for r, y in held]) >= least


def test_classifiers_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    from riskloom.llm import toxicity
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def test_quality_filter_keeps_columns(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.Ranking(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 0.3)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)


FAST = ["op1_lm_bloom", "op3_sp_nbest", "op4_exact_dedup", "op5_toxicity", "op6_near_dup", "op7_packing",
        "op8_token_count", "op9_fingerprint", "op10_quality", "op2_pii", "op11_line_dedup"]


@pytest.mark.parametrize("name", FAST)
def test_empty_tables(spark, empty, name):
    out = QUERIES[name](spark, empty)
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", ["op1_lm_bloom", "op4_exact_dedup", "op6_near_dup", "op7_packing", "op9_fingerprint",
                                  "op8_token_count", "op2_pii", "op3_sp_nbest", "op5_toxicity", "op10_quality",
                                  "op11_line_dedup"])
def test_rows_without_id(spark, nameless, name):
    n = spark.read.parquet(f"{nameless}/documents.parquet").count()
    out = QUERIES[name](spark, nameless).collect()
    assert len(out) >= n and any(r["doc_id"] is None for r in out)
    if name != "op7_packing":
        assert len(out) == n
