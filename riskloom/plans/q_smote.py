"""kNN and SMOTE queries on the ``embeddings`` table: class 0 against
the rest is the imbalanced binary label (50 vs 450 at sf 0.01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash_sql
from riskloom.operators.cells import GRID, HASH_RANGE, SAMPLE_PER_CELL
from riskloom.operators.smote import directions, knn, smote
from riskloom.plans import driver as D
from riskloom.plans import oracle as O
from riskloom.plans.catalog import finalize, register

MINORITY = 0
K = 5
SEED = 0

MIN_SQL = f"SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = {MINORITY}"


def _dist_sql(a, b):
    return (f"sqrt(list_reduce(list_transform(generate_series(1, len({a})), "
            f"lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])), lambda x, y: x + y))")


KNN_SQL = f"""WITH m AS ({MIN_SQL}),
pairs AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, {_dist_sql('a.v', 'b.v')} AS dist
          FROM m a JOIN m b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM pairs)
SELECT id, nbr_id, CAST(rank AS INTEGER) AS rank, dist FROM ranked WHERE rank <= {K}"""


@register("knn_minority", O.final_select(KNN_SQL, [("id", "bigint"), ("nbr_id", "bigint"), ("rank", "int"),
                                                   ("dist", "double")]))
def knn_minority(spark, sf):
    """Exact 5 nearest neighbours among the minority vectors."""
    e = D.read(spark, sf, "embeddings").where(F.col("label") == MINORITY)
    return finalize(knn(e, "vec_id", "embedding", K))


# Hash tables of the approximate mode: 24 tables of 4 signs each. Their recall@5 on
# the embeddings, of all and of the minority, is held at 0.9 in the tests.
TABLES, BITS, LSH_SEED, DIM = 24, 4, SEED + 7, 64


def _lsh_sql(source: str) -> str:
    """(id, nbr_id, rank, dist): the k nearest among the vectors that share a bucket."""
    dirs = directions(TABLES, BITS, DIM, LSH_SEED)
    dot = lambda u: ("list_reduce(list_transform(generate_series(1, len(v)), lambda i: v[i] * "  # noqa: E731
                     f"([{', '.join(repr(float(c)) for c in u)}])[i]), lambda x, y: x + y)")
    code = lambda t: " + ".join(
        f"CASE WHEN {dot(dirs[t, j])} >= 0 THEN {1 << j} ELSE 0 END" for j in range(BITS))
    hashed = " UNION ALL ".join(f"SELECT vec_id, {t} AS t, {code(t)} AS bucket FROM src" for t in range(TABLES))
    return f"""WITH src AS ({source}), hashed AS ({hashed}),
cand AS (SELECT DISTINCT a.vec_id AS id, b.vec_id AS nbr_id FROM hashed a JOIN hashed b
         ON a.t = b.t AND a.bucket = b.bucket AND a.vec_id <> b.vec_id),
pairs AS (SELECT id, nbr_id, {_dist_sql('x.v', 'z.v')} AS dist FROM cand
          JOIN src x ON x.vec_id = id JOIN src z ON z.vec_id = nbr_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM pairs)
SELECT id, nbr_id, CAST(rank AS INTEGER) AS rank, dist FROM ranked WHERE rank <= {K}"""


@register("knn_lsh", O.final_select(_lsh_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
                                    [("id", "bigint"), ("nbr_id", "bigint"), ("rank", "int"), ("dist", "double")]))
def knn_lsh(spark, sf):
    """Approximate 5 nearest neighbours among all vectors (caller-chosen hash tables)."""
    e = D.read(spark, sf, "embeddings")
    return finalize(knn(e, "vec_id", "embedding", K, method="lsh", tables=TABLES, bits=BITS, seed=LSH_SEED))


# Cells: sqrt(n) of them, each vector meets the members of its 25 nearest ones. On these
# vectors, which hardly cluster, that keeps recall@5 at 0.9 (held in the tests) up to some
# thousands of rows; candidates grow with sqrt(n).
PROBES, STEPS = 25, 2


def _cells_sql(source: str) -> str:
    """(id, nbr_id, rank, dist): the k nearest among the members of the visited cells. The
    vectors are distinct."""
    gap2 = ("list_reduce(list_transform(generate_series(1, len(s.v)), "
            "lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i])), lambda x, y: x + y)")
    h = portable_hash_sql("vec_id", seed=LSH_SEED)

    def near(points, centres):
        return (f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cell) AS r FROM "
                f"(SELECT s.vec_id, s.v, c.cell, {gap2} AS d2 FROM {points} s, {centres} c)")

    steps = "".join(f""",
m{i} AS (SELECT cell, list(x ORDER BY d) AS v FROM (SELECT cell, d, floor(avg(x) * {GRID} + 0.5) / {GRID}.0 AS x FROM
    (SELECT cell, unnest(v) AS x, unnest(generate_series(1, len(v))) AS d FROM ({near('fit', f'c{i}')}) WHERE r = 1)
    GROUP BY cell, d) GROUP BY cell),
c{i + 1} AS (SELECT cell, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cell))""" for i in range(STEPS))
    return f"""WITH src AS ({source}),
cnt AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS c FROM src),
fit AS (SELECT src.* FROM src, cnt WHERE {SAMPLE_PER_CELL} * c >= n OR {h} < floor({SAMPLE_PER_CELL} * c / n * {HASH_RANGE})),
c0 AS (SELECT r - 1 AS cell, v FROM (SELECT *, row_number() OVER (ORDER BY {h}, vec_id) AS r FROM src), cnt
  WHERE r <= c){steps},
met AS ({near('src', f'c{STEPS}')}),
own AS (SELECT vec_id, v, cell FROM met WHERE r = 1),
size AS (SELECT cell, count(*) AS s FROM own GROUP BY cell),
seen AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM met LEFT JOIN size USING (cell)),
pairs AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, {_dist_sql('a.v', 'b.v')} AS dist FROM seen a
  JOIN own b ON a.cell = b.cell AND a.vec_id <> b.vec_id WHERE a.r <= {PROBES} OR a.before < {K + 1}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM pairs)
SELECT id, nbr_id, CAST(rank AS INTEGER) AS rank, dist FROM ranked WHERE rank <= {K}"""


@register("knn_cells", O.final_select(_cells_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
                                      [("id", "bigint"), ("nbr_id", "bigint"), ("rank", "int"), ("dist", "double")]))
def knn_cells(spark, sf):
    """5 nearest neighbours among all vectors, sought in the nearest cells."""
    e = D.read(spark, sf, "embeddings")
    return finalize(knn(e, "vec_id", "embedding", K, method="cells", probes=PROBES, steps=STEPS, seed=LSH_SEED))


def _smote_sql(near: str = KNN_SQL):
    h_pos = portable_hash_sql("vec_id", seed=SEED)
    h_nbr = portable_hash_sql("vec_id", "copy", seed=SEED)
    h_gap = portable_hash_sql("vec_id", "copy", seed=SEED + 1)
    return f"""WITH m AS ({MIN_SQL}),
counts AS (SELECT COUNT(*) FILTER (WHERE label = {MINORITY}) AS mi,
                  COUNT(*) FILTER (WHERE label <> {MINORITY}) AS ma FROM embeddings),
p AS (SELECT m.*, row_number() OVER (ORDER BY {h_pos}, vec_id) - 1 AS pos FROM m),
c AS (SELECT p.*, (counts.ma - counts.mi) // counts.mi + CAST(pos < (counts.ma - counts.mi) % counts.mi AS INTEGER)
        AS n_copies FROM p, counts),
cp AS (SELECT vec_id, v, UNNEST(generate_series(1, n_copies)) AS copy FROM c WHERE n_copies > 0),
near AS ({near}),
found AS (SELECT id, COUNT(*) AS n FROM near GROUP BY id),
nn AS (SELECT id, nbr_id, rank FROM near UNION ALL
       SELECT vec_id, vec_id, 1 FROM m WHERE vec_id NOT IN (SELECT id FROM near)),
pk AS (SELECT vec_id, v, copy, CAST({h_nbr} % COALESCE(n, 1) + 1 AS INTEGER) AS rank,
              CAST({h_gap} AS DOUBLE) / {2 ** 32}.0 AS gap FROM cp LEFT JOIN found ON found.id = cp.vec_id),
syn AS (SELECT pk.vec_id, pk.copy, nn.nbr_id, pk.gap,
          list_transform(generate_series(1, len(pk.v)), lambda i: pk.v[i] + pk.gap * (b.v[i] - pk.v[i])) AS vec
        FROM pk JOIN nn ON pk.vec_id = nn.id AND pk.rank = nn.rank JOIN m b ON b.vec_id = nn.nbr_id)
SELECT CAST(vec_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR) AS row_key, vec_id AS parent_id,
  CAST(copy AS INTEGER) AS copy, nbr_id, gap, list_reduce(vec, lambda x, y: x + y) AS vec_sum,
  sqrt(list_reduce(list_transform(vec, lambda x: x * x), lambda x, y: x + y)) AS vec_norm FROM syn"""


SMOTE_COLS = [("row_key", "string"), ("parent_id", "bigint"), ("copy", "int"), ("nbr_id", "bigint"),
              ("gap", "double"), ("vec_sum", "double"), ("vec_norm", "double")]


@register("smote", O.final_select(_smote_sql(), SMOTE_COLS))
def smote_q(spark, sf):
    """Synthetic minority rows (class 0 vs rest) up to the majority size; each row
    summarised by the sum and norm of its vector."""
    return _summary(spark, sf)


@register("smote_lsh", O.final_select(_smote_sql(_lsh_sql(MIN_SQL)), SMOTE_COLS))
def smote_lsh(spark, sf):
    """The same with neighbours from the hash tables."""
    return _summary(spark, sf, method="lsh", tables=TABLES, bits=BITS)


@register("smote_cells", O.final_select(_smote_sql(_cells_sql(MIN_SQL)), SMOTE_COLS))
def smote_cells(spark, sf):
    """The same with neighbours from the nearest cells."""
    return _summary(spark, sf, method="cells", probes=PROBES, steps=STEPS)


def _summary(spark, sf, **method):
    e = D.read(spark, sf, "embeddings").withColumn("y", (F.col("label") == MINORITY).cast("int"))
    s = smote(e, "vec_id", "embedding", "y", k=K, seed=SEED, minority=1, **method)
    agg = lambda f: F.aggregate(F.col("vector"), F.lit(0.0), f)
    return finalize(s.select("row_key", "parent_id", "copy", "nbr_id", "gap",
                             agg(lambda acc, x: acc + x).alias("vec_sum"),
                             F.sqrt(agg(lambda acc, x: acc + x * x)).alias("vec_norm")))
