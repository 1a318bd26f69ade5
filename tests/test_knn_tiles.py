import numpy as np

from skein.operators.knn import _packed, _tiled_candidates, _TopK, knn_exact
from skein.session import ship_package


class Id:
    """An id that counts how often it is compared."""
    compared = 0

    def __init__(self, n):
        self.n = n

    def __lt__(self, other):
        Id.compared += 1
        return self.n < other.n


def _ids(n):
    out = np.empty(n, dtype=object)
    out[:] = [Id(i) for i in range(n)]
    return out


def test_ids_are_compared_only_where_distances_are_equal():
    m = np.random.default_rng(2).normal(size=(3000, 8))
    m[2990:] = m[:10]
    q = np.random.default_rng(3).normal(size=(700, 8))      # more than one block of queries
    top = _TopK(np.arange(700), q, 5, False, 9)
    Id.compared = 0
    top.add_all(_ids(2990), m[:2990])
    top._rank()
    assert Id.compared == 0
    want = np.argsort(np.square(q[:, None] - m[None, :2990]).sum(2), axis=1, kind="stable")[:, :5]
    order = np.argsort(top.rows, kind="stable")
    assert [i.n for i in top.ids[order]] == want.ravel().tolist()


def test_tiles_move_packs_and_equal_the_plain_search(spark):
    ship_package(spark)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(400, 6)).astype(np.float32)
    m[300:] = m[0]                                          # 101 copies
    v = spark.createDataFrame([(f"v{(i * 7) % 400:03d}", x.tolist()) for i, x in enumerate(m)] + [("none", None)],
                              "vec_id string, vv array<float>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m[:40].astype(float))],
                              "query_id long, qv array<double>").repartition(2)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    for own in (False, True):
        got = knn_exact(q, v, k=4, query_vector="qv", vector="vv", strategy="tiled", query_block=9,
                        shard_vectors=70, tie_digits=9, exclude_self=own)
        want = knn_exact(q, v, k=4, query_vector="qv", vector="vv", strategy="broadcast", tie_digits=9,
                         exclude_self=own)
        assert key(got) == key(want) and len(key(got)) == 160
    from skein.operators.knn import _cand_schema
    v = v.where("vv is not null")
    cands = _tiled_candidates(q, v, 4, False, _cand_schema(q.schema["query_id"].dataType, v.schema["vec_id"].dataType),
                              40, 6, 9, 70, 9)
    plan = cands._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan
    packs = _packed(v.coalesce(1), 2, "<f4", 4).collect()
    assert len(packs) == 2                                  # not a row a vector
    assert [len(p["numbers"]) for p in packs] == [24 * len(p["ids"]) for p in packs]
    kept = sorted(i for p in packs for i in p["ids"])
    copies = sorted(f"v{(i * 7) % 400:03d}" for i in [0, *range(300, 400)])
    assert 299 + 4 < len(kept) <= 299 + 8 and set(copies[:4]) <= set(kept)
