"""The registered queries: each applies one operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    exact_dedup, fingerprint, hard_negatives, lexical, line_dedup, lm_score, near_dup, packing, pii, quality, sp_nbest,
    token_count, toxicity,
)
from riskloom.llm.common import fold_of, read_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


@register("op1_lm_bloom")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model, merged = lm_score.fit(docs.where(fold_of() != 1), keep_pairs=False)
    kept_out = docs.select("doc_id", "text")
    scored = lm_score.score(kept_out, model, merged)
    return (scored.withColumn("held_out", fold_of() == 1)
            .selectExpr("doc_id", "held_out", "n_tokens", "n_known",
                        f"CAST({model.n_tokens} AS BIGINT) AS train_tokens", "base_score", "score"))


@register("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(read_table(spark, sf_dir, "documents"))


@register("op6_near_dup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


@register("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


@register("op8_token_count")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@register("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return judged(toxicity.score(docs, toxicity.fit(docs, labels.where(fold_of() != 0))), 0.5)


@register("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return judged(quality.score(docs, quality.fit(docs, labels.where(fold_of() != 0))), 0.3)


def judged(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


@register("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = pii.detect(docs, pii.fit(docs))
    of = lambda i: lambda s: s["kind"] == i
    count = [F.size(F.filter(pii.BASE_SPANS, of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return held.select("doc_id", *count, F.sha2(pii.listed(pii.BASE_SPANS), 256).alias("base_sha256"),
                       pii.listed(pii.ALL_SPANS).alias("spans"))


@register("op9_fingerprint")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@register("op3_sp_nbest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp_nbest.n_best(read_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("piece_bpe_32k.model"), n=4)
    each = F.transform("decoded", lambda d: F.sha2(d, 256))
    return found.select("doc_id", "n_chars", "n_best", "scores", "n_pieces", "ids_crc32",
                        F.forall("restored", lambda r: r).alias("round_trip"), each[0].alias("decoded_sha256"),
                        each.alias("decoded_sha256s"))


@register("op12_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = hard_negatives.integer_rows(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, n_positives=5, n_negatives=3, low=50, high=95)


TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@register("op13_lexical", f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS terms FROM documents),
d AS (SELECT r, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS k FROM
  (SELECT item_id, unnest({TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM
  (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), c),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))
    AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
    doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(read_table(spark, sf_dir, "documents"))
    return lexical.search(index, read_table(spark, sf_dir, "benchmark"), k=20)


@register("op11_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM o JOIN d USING (r)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
