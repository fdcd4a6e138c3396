"""op11 to op13 against plain versions on small tables with edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives, lexical, line_dedup
from riskloom.llm.queries import QUERIES

BLANK = " \t\n\x0b\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- lines -----------------------------------------------------------------------

def kept_lines(texts, min_docs, min_chars=1):
    """(n_lines, n_dropped, kept text) of each text."""
    keys = [[lower(x.strip(BLANK)) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for t, ks in zip(texts, keys):
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, ks) if len(k) < min_chars or seen[k] < min_docs]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_line_query_on_edge_cases(spark, small, rows):
    got = sorted(tuple(r) for r in QUERIES["op11_line_dedup"](spark, small).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    want = kept_lines([t for _, t in rows], 10)
    assert got == sorted((d, n, x, sha(k)) for (d, _), (n, x, k) in zip(rows, want))
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("batches", [1, 3])
def test_frequent_lines_whatever_the_batches(spark, batches):
    """A hot line in a third of all documents, lines at the bound, repeats, odd blanks."""
    texts = [f"Footer \n own line {i}\n\n\tTIE {i % 7} \r\nShared Ä{i % 3}\x0b" for i in range(40)]
    texts += ["footer"] * 30 + ["\n\n", "", None, "FOOTER\nfooter\n x", "tie 0", "ÉTÉ", "été", "a\x1cfooter", "İ footer"]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "n", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_lines string, h1 int")
    out = line_dedup.drop_frequent_lines(docs, min_docs=7, batches=batches)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    got = {r["h1"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == kept_lines(texts, 7)


def test_shortest_key_and_a_very_long_text(spark):
    long = "\n".join(f"line {i % 11000}" for i in range(300_000)) + "\nx"
    texts = [long, "line 5\nx", "line 5\nx", "y" * 5_000_000 + "\nline 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 2):
        out = {r["doc_id"]: r for r in line_dedup.drop_frequent_lines(docs, 3, min_chars=least).collect()}
        want = kept_lines(texts, 3, least)
        assert [(out[i]["n_lines"], out[i]["n_dropped"], out[i]["text"]) for i in range(4)] == want


def test_runs_merge_sorted_tables_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4, buckets=8)
    rng, batches = np.random.default_rng(0), []
    for _ in range(5):
        batches.append([(int(k), int(k) * 3) for k in rng.integers(0, 60, 70)])
        runs.add(spark.createDataFrame(batches[-1], "h1 long, h2 long"))
    merged = line_dedup.LineRuns.merge(runs._run(runs.frequent.withColumn("n", F.lit(1))), runs._run(
        runs.frequent.withColumn("n", F.lit(2))))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    total = Counter(k for b in batches for k in b)
    frequent = {tuple(r) for r in runs.finish().collect()}
    assert frequent == {k for k, n in total.items() if n >= 4}
    assert len(runs.levels[-1]) == 1
    left = {(r["h1"], r["h2"]): r["n"] for r in runs.levels[-1][0].collect()}
    # a digest that became frequent elsewhere may leave a remainder; the others are counted in full
    assert {k: n for k, n in left.items() if k not in frequent} == {k: n for k, n in total.items() if n < 4}


# -- hard negatives ----------------------------------------------------------------

def brute_negatives(rows, n_pos, n_neg, low, high, every):
    """rows: {id: (label, vector)}."""
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in rows.items():
        if a % every:
            continue
        ranked = sorted((-score(v, w), i, lab) for i, (lab, w) in rows.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:n_pos]:
            fits = [(i, -t) for t, i, lab in ranked if lab != label and low * -s <= 100 * -t <= high * -s][:n_neg]
            out |= {(a, p, k, i, -s, t) for k, (i, t) in enumerate(fits, 1)}
    return out


def embedding_rows(n=400, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    base = np.floor(256 * rng.normal(size=(n, dim)) / 3) / 256
    base[: n // 3] = base[0]  # one vector on a third of the rows
    base[n // 2: n // 2 + 20] = 0.0
    return [(i, base[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("settings", [hard_negatives.Settings(), hard_negatives.Settings(50, 8, 3, 3)])
def test_negatives_of_planted_vectors(spark, settings):
    rows = embedding_rows()
    odd = [(1000, None, 1), (1001, [1.0, None] + [0.0] * 4, 1), (1002, [float("nan")] * 6, 1), (1003, [1.0] * 6, None),
           (None, [1.0] * 6, 1), (1004, [float("inf")] * 6, 2), (1050, [0.5, 0.25], 1), (1100, [], 2),
           (0, rows[0][1], rows[0][2]), (1150, [3.0e4] * 6, 2), (1151, [-3.0e4] * 6, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1))
    ints = hard_negatives.integer_rows(df, "vec_id", "embedding", F.col("label"), 256)
    plain = {i: (lab, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v, lab in rows + odd[6:8] + odd[9:]}
    assert {r["id"] for r in ints.collect()} == set(plain)
    got = hard_negatives.mine(ints, F.col("id") % 10 == 0, 4, 3, 50, 95, settings)
    assert {tuple(r) for r in got.collect()} == brute_negatives(plain, 4, 3, 50, 95, 10)


def test_every_row_is_in_one_bounded_leaf(spark):
    rows = spark.createDataFrame(embedding_rows(900), SCHEMA)
    ints = hard_negatives.integer_rows(rows, "vec_id", "embedding", F.col("label"), 256)
    index = hard_negatives.build_index(ints, hard_negatives.Settings(100, 16, 4, 64)).collect()
    ids = [i for r in index for i in np.frombuffer(r["ids"], np.int64)]
    assert sorted(ids) == list(range(900)) and max(r["n"] for r in index) <= 16
    assert max(Counter(r["shard"] for r in index).values()) * 16 < 900 / 2  # the hot vector is spread


def test_scores_beyond_doubles_are_exact(spark):
    big = [(0, [2.0 ** 20, 1.0], 1), (1, [2.0 ** 20, 2.0 ** -8], 1), (2, [2.0 ** 19, 0.0], 2), (3, [2.0 ** 19, 2.0 ** -8], 2)]
    ints = hard_negatives.integer_rows(spark.createDataFrame(big, SCHEMA), "vec_id", "embedding", F.col("label"), 256)
    got = hard_negatives.mine(ints, F.col("id") == 0, 1, 3, 10, 95).collect()
    plain = {i: (lab, [math.floor(256 * x) for x in v]) for i, v, lab in big}
    assert {tuple(r) for r in got} == {r for r in brute_negatives(plain, 1, 3, 10, 95, 100)} and len(got) == 2


def test_negatives_of_empty_and_lonely_tables(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)]):
        ints = hard_negatives.integer_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"), 256)
        assert hard_negatives.mine(ints, F.col("id") % 50 == 0).count() == 0


# -- lexical search ----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranked(docs, items, k):
    """[(item text, rank, doc_id, score)] of (doc_id, text) and item texts."""
    counts = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for text in items:
        asked, found = Counter(TERM.findall(lower(text))), []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, n in asked.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(text, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def ranked(spark, docs, items, k=20, settings=lexical.Settings(), parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(parts)
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("rank", F.lit(1))
    got = lexical.search(lexical.build_index(table, settings), asked, k, settings).collect()
    return sorted((items[r["item_id"]], r["rank"], r["doc_id"], r["score"]) for r in got)


def test_ranked_search_on_edge_cases(spark, rows):
    items = ["one two three four, THREE", "lorem ipsum dolor end", "naïve ÉCOLE 日本語 x", "a the of 9", "", "!?", "nothing-like-this zzzq"]
    items += [t[:300] for _, t in rows[:12]]
    docs = [(None if d == 100007 else d, t) for d, t in rows]
    want = sorted(brute_ranked(docs, items, 20))
    assert len(want) > 150
    # one shard, many shards, a document a shard, and blocks of a few items
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, settings=lexical.Settings(shard_bytes=30_000, block_bytes=900, batch=3)) == want


def test_many_ties_go_by_document(spark):
    docs = [(i, "same words here") for i in range(700, 0, -1)] + [(9000 + i, f"same other{i}") for i in range(50)]
    items = ["same words", "same words here words"]
    for settings in (lexical.Settings(), lexical.Settings(shard_bytes=200, batch=2)):
        got = ranked(spark, docs, items, 20, settings, parts=2)
        assert got == sorted(brute_ranked(docs, items, 20))
        assert [d for t, _, d, _ in got if t == items[0]] == list(range(1, 21))


def test_empty_tables_and_repeated_items(spark):
    assert ranked(spark, [], ["one"]) == []
    assert ranked(spark, [(1, None), (2, "  ,.")], ["one"]) == []
    table = spark.createDataFrame([(1, "one"), (2, "two three")], "doc_id long, text string")
    index = lexical.build_index(table)
    items = spark.createDataFrame([(5, "one"), (5, "one"), (5, "two"), (None, "three"), (6, None)], "item_id long, text string")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"]) for r in lexical.search(index, items).collect()), key=str)
    assert got == [(5, 1, 1), (5, 1, 2), (None, 1, 2)]
    assert lexical.search(index, items.limit(0)).count() == 0


def test_a_text_longer_than_a_slice(spark):
    long = " ".join(f"w{i % 5000}" for i in range(900_000))
    docs = [(1, long), (2, "w1 w2 rare"), (3, "w1")]
    assert len(long) > 4 << 20
    items = ["w1 rare", "w4999 w2"]
    assert ranked(spark, docs, items) == sorted(brute_ranked(docs, items, 20))
