"""Inputs on which a shortcut would give less than the whole result."""

import numpy as np
import pytest
from brute import near_components
from pyspark.sql import functions as F

from riskloom.llm import fingerprint, lm_score, near_dup, pii, toxicity
from riskloom.llm.common import fold_of


def hot_template(groups, template, shared, own):
    """(doc_id, text) of ``groups`` pairs: one template, the pair's shared words, a text's own."""
    words = lambda name, n: [f"{name}x{i}" for i in range(n)]
    ids = np.random.default_rng(5).permutation(2 * groups)
    return [(int(ids[2 * g + s]), " ".join(words("t", template) + words(f"g{g}", shared) + words(f"g{g}s{s}", own)))
            for g in range(groups) for s in (0, 1)]


def test_near_dedup_hot_template(spark, monkeypatch):
    """Pairs above 0.8 within a group whose other members are just below it to each other."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 40, raising=False)
    rows = hot_template(150, 400, 20, 36)
    want = near_components(rows, 4)
    assert len({c for _, c in want.values()}) == 150
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def met_pairs(spark, sets, roots):
    rows = [(i, int(r), s.tobytes()) for i, (s, r) in enumerate(zip(sets, roots))]
    held = spark.createDataFrame(rows, "id long, root long, held binary")
    counts = spark.sparkContext.broadcast(near_dup.counted(held))
    found = near_dup.meeting(near_dup.prefixes(held, counts, 80), 80).collect()
    assert len({tuple(r) for r in found}) == len(found)
    return {tuple(r) for r in found}


def near_sets(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("block", [3, 1024])
def test_meeting_loses_no_pair_of_other_components(spark, monkeypatch, block):
    """Sets of many sizes around one base; a third has one root, the rest have roots of their own."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    fresh = lambda n: np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
    base = fresh(60)
    sets = [np.sort(np.concatenate([base[rng.permutation(len(base))[:n]], fresh(4)])) for n in rng.integers(40, 60, 45)]
    sets += [sets[3][:1], sets[3][:1], sets[4][:5], sets[4][:6]]
    roots = np.arange(len(sets))
    roots[20:40] = 20
    want = {(a, b) for b in range(len(sets)) for a in range(b) if roots[a] != roots[b] and near_sets(sets[a], sets[b])}
    got = met_pairs(spark, sets, roots)
    assert len(want) > 20 and want <= got
    assert all(roots[a] != roots[b] for a, b in got)


@pytest.mark.parametrize("groups", [200, 1600])
def test_meeting_of_a_hot_template_grows_with_its_members(spark, groups):
    """All members share a template and are just below the bound; only a group's two reach it."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    template = fresh(200)
    sets = []
    for _ in range(groups):
        shared = fresh(20)
        sets += [np.unique(np.concatenate([template, shared, fresh(10)])) for _ in range(2)]
    assert near_sets(sets[0], sets[1]) and not near_sets(sets[0], sets[2])
    got = met_pairs(spark, sets, np.arange(2 * groups))
    assert got == {(2 * g, 2 * g + 1) for g in range(groups)}


def test_lexicon_does_not_depend_on_the_partitions(spark):
    """Ordinary words fall into few documents of a slice; their clean ones count all the same."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join([*(f"word{j}" for j in rng.integers(0, 60, 6)), *(["zork"] if i % 5 == 0 else [])]),
             float(i % 5 == 0)) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label double")
    one, many = (toxicity.learn_lexicon(sample.repartition(n), toxicity.Settings()) for n in (1, 200))
    assert len(one) and one.tolist() == many.tolist()


def test_lm_scores_are_equal_beyond_the_filter_bound(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train = docs.where(fold_of() != 1)
    want, got = ({(r["doc_id"], r["n_tokens"]): r for r in lm_score.score(docs, *lm_score.fit(train, s)).collect()}
                 for s in (lm_score.Settings(), lm_score.Settings(max_filter_bytes=1000)))
    assert want.keys() == got.keys()
    for key, r in want.items():
        assert got[key]["score"] == pytest.approx(r["score"], rel=1e-9)
        assert got[key]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)


@pytest.mark.parametrize("step", [2, 100])
def test_looser_pii_is_found_when_rare_and_when_frequent(spark, step):
    rows = []
    for i in range(400):
        loose = f" call ({200 + i}) 555-{1000 + i} at noon" if i % step == 0 else ""
        rows.append((i, f"write to a{i}@b.org or 300.1.1.{i % 9} on 2024-01-15 1030{loose}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.detect(docs, pii.fit(docs)).select("doc_id", pii.listed(pii.ALL_SPANS).alias("s"))
    for r in got.collect():
        text = rows[r["doc_id"]][1]
        spans = [s.split(":") for s in r["s"].split(",")]
        phones = [text[int(a):int(b)] for k, a, b in spans if k == "phone"]
        assert phones == ([f"({200 + r['doc_id']}) 555-{1000 + r['doc_id']}"] if r["doc_id"] % step == 0 else [])


def test_fingerprint_blocks_of_short_texts(spark):
    """Half of 40 words edited: two of three blocks of 16 words differ, one is alike."""
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    edited = " ".join(words[:20] + ["x"] * 20)
    a, b = spark.createDataFrame([(text,), (edited,)], "t string").select(
        fingerprint.paragraphs(F.col("t")).alias("p")).collect()
    assert (len(a["p"]), len(b["p"]), len(set(a["p"]) & set(b["p"]))) == (3, 3, 1)


def test_fingerprint_counts_are_not_cut(spark):
    text = "\n".join(f"line {i}" for i in range(5000))
    cells = fingerprint.sketch(fingerprint.paragraphs(F.lit(text)), fingerprint.BASE_CELLS, 1)
    row = spark.range(1).select(cells.alias("c"), fingerprint.hexed(cells).alias("h")).first()
    assert [int(x[:-32], 16) for x in row["h"].split(".")] == [c["n"] for c in row["c"]]
    assert sum(c["n"] for c in row["c"]) == 15000


def digest_sets(spark, pairs):
    return spark.createDataFrame([(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(pairs)],
                                 "i int, a array<long>, b array<long>")


def test_fingerprint_difference_holds_only_what_differs(spark):
    """Equal digests leave no cell to peel: one of three subtables' cells a differing digest."""
    rows = digest_sets(spark, [({1, 2, 3}, {1, 2, 3}), ({1, 2, 3}, {2, 3}), (set(), set())])
    a, b = (fingerprint.sketch(F.col(c), fingerprint.BASE_CELLS, 1) for c in "ab")
    left = fingerprint.subtract(a, b, fingerprint.BASE_CELLS)
    got = rows.select("i", *[c.alias(f"t{j}") for j, c in enumerate(left)]).orderBy("i").collect()
    assert [[len(r[f"t{j}"]) for j in range(3)] for r in got] == [[0, 0, 0], [1, 1, 1], [0, 0, 0]]


@pytest.mark.parametrize("tries", [fingerprint.TRIES, ((1, 11), (2, 12))])
def test_fingerprint_differences_are_exact(spark, monkeypatch, tries):
    """Dealt sets of any size against Python's sets, also when sketches are too small."""
    monkeypatch.setattr(fingerprint, "TRIES", tries)
    pairs = [({d * 7919 for d in range(n)}, {d * 7919 for d in range(lo, lo + m)})
             for n, m, lo in [(0, 0, 0), (1, 0, 0), (0, 5, 0), (9, 9, 0), (20, 20, 10), (60, 40, 55), (700, 900, 300)]]
    got = digest_sets(spark, pairs).select("i", fingerprint.dealt_difference(F.col("a"), F.col("b")).alias("r"))
    assert {r["i"]: (r["r"]["done"], r["r"]["plus"], r["r"]["minus"]) for r in got.collect()} == {
        i: (True, len(a - b), len(b - a)) for i, (a, b) in enumerate(pairs)}
