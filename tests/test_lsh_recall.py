import numpy as np
import pytest

from riskloom.operators.smote import knn
from riskloom.plans import q_smote


@pytest.mark.parametrize("minority", [False, True])
def test_registered_tables_find_the_neighbours(spark, minority):
    """recall@5 on the embeddings with the registered tables, bits and seed."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    e = e.where(f"label = {q_smote.MINORITY}") if minority else e
    found = {}
    for method in ("exact", "lsh"):
        for r in knn(e, "vec_id", "embedding", q_smote.K, method=method, tables=q_smote.TABLES, bits=q_smote.BITS,
                     seed=q_smote.LSH_SEED).collect():
            found.setdefault(method, {}).setdefault(r.id, set()).add(r.nbr_id)
    assert all(len(n) == q_smote.K for n in found["lsh"].values()) and found["lsh"].keys() == found["exact"].keys()
    assert np.mean([len(found["lsh"][i] & n) / q_smote.K for i, n in found["exact"].items()]) >= 0.9
