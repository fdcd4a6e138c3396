import numpy as np
import pytest

from riskloom.operators import cells as C
from riskloom.operators.smote import knn, searched_cells
from riskloom.plans import q_smote

REGISTERED = dict(method="cells", probes=q_smote.PROBES, steps=q_smote.STEPS, seed=q_smote.LSH_SEED)


def neighbours(df, id_col, vec_col, k, **how):
    found = {}
    for r in knn(df, id_col, vec_col, k, **how).collect():
        found.setdefault(r.id, []).append((r["rank"], r.nbr_id))
    return {i: [n for _, n in sorted(f)] for i, f in found.items()}


def true_neighbours(ids, x, k):
    out = {}
    for i, a in enumerate(ids):
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        gap[i] = np.inf
        out[a] = [ids[j] for j in np.lexsort((ids, gap))[:k]]
    return out


@pytest.mark.parametrize("sf,minority", [("0.01", False), ("0.01", True), ("0.1", False), ("0.1", True)])
def test_registered_cells_find_the_neighbours(spark, sf, minority):
    """recall@5 on the embeddings with the registered parameters."""
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    e = e.where(f"label = {q_smote.MINORITY}") if minority else e
    rows = e.select("vec_id", "embedding").collect()
    want = true_neighbours(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), q_smote.K)
    got = neighbours(e, "vec_id", "embedding", q_smote.K, **REGISTERED)
    assert got.keys() == want.keys() and all(len(n) == q_smote.K for n in got.values())
    assert np.mean([len(set(got[i]) & set(n)) / q_smote.K for i, n in want.items()]) >= 0.9


def clustered(spark, n, per_cluster=20, dim=16, seed=3):
    """Clusters whose number grows with the rows."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n // per_cluster, dim)) * 4, per_cluster, axis=0) + rng.normal(size=(n, dim)) * 0.3
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_candidates_grow_with_the_root_of_the_rows(spark):
    met = {}
    for n in (400, 1600, 6400):
        x, df = clustered(spark, n)
        asking, held = searched_cells(df, n, x.shape[1], 5, None, 4, 2, 1)
        met[n] = C.candidates_per_point(asking, held)
    assert met[1600] / met[400] < 2.6 and met[6400] / met[1600] < 2.6
    assert met[6400] < 6400 / 8
    got, want = neighbours(df, "id", "v", 5, method="cells", probes=4, seed=1), true_neighbours(np.arange(n), x, 5)
    assert np.mean([len(set(got[i]) & set(w)) / 5 for i, w in want.items()]) >= 0.9


def test_small_cells_still_give_k_neighbours(spark):
    x, df = clustered(spark, 60, per_cluster=3)
    got = neighbours(df, "id", "v", 5, method="cells", cells=30, probes=1)
    assert len(got) == 60 and all(len(n) == 5 for n in got.values())


def test_all_cells_are_exact_with_copies_and_large_cells(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([np.tile(rng.normal(size=(1, 4)), (30, 1)), rng.normal(size=(60, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    exact = neighbours(df, "id", "v", 4)
    assert neighbours(df, "id", "v", 4, method="cells", cells=3, probes=3, block_rows=8) == exact == true_neighbours(np.arange(90), x, 4)


def test_fit_is_repeatable_and_bounded(spark):
    x, df = clustered(spark, 300)
    a, b = (C.fit_cells(df.repartition(p), 300, x.shape[1], seed=2) for p in (1, 7))
    assert np.array_equal(a, b) and len(a) == 18
    assert C.cells_for(10 ** 12, 64) * 64 * 8 <= C.MAX_CENTRE_BYTES
    empty = df.where("id < 0")
    assert knn(empty, "id", "v", 3, method="cells").count() == 0
    with pytest.raises(ValueError, match="differ in length"):
        knn(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v", method="cells")
