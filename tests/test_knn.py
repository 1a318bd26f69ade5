import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.knn import knn_approx, knn_exact, recall_at_k, train_cells
from skein.session import ship_package


@pytest.fixture(scope="module")
def vecs(spark):
    ship_package(spark)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(100, 16)).astype(np.float32)
    rows = [(i, m[i].tolist()) for i in range(100)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), m


def test_query_equal_to_vector_ranks_first(spark, vecs):
    df, m = vecs
    q = spark.createDataFrame([(1, m[0].tolist())], "query_id long, embedding array<float>")
    top = knn_exact(q, df, k=3).orderBy("rank").collect()
    assert top[0].vec_id == 0 and top[0].distance == pytest.approx(0.0)
    d = ((m - m[0]) ** 2).sum(axis=1)
    assert [r.vec_id for r in top] == list(np.argsort(d, kind="stable")[:3])


def test_k_bounds(spark, vecs):
    df, m = vecs
    small = df.filter("vec_id < 50")
    q = spark.createDataFrame([(1, m[3].tolist())], "query_id long, embedding array<float>")
    assert knn_exact(q, small, k=5).count() == 5
    assert knn_exact(q, small, k=100).count() == 50          # k > n -> n
    assert knn_exact(q, small, k=0).count() == 0
    assert knn_exact(q, small.limit(0), k=5).count() == 0     # empty store
    with pytest.raises(ValueError):
        knn_exact(q, small, k=-5)


def test_dimension_mismatch_fails(spark, vecs):
    df, _ = vecs
    q = spark.createDataFrame([(1, [0.0] * 8)], "query_id long, embedding array<float>")
    with pytest.raises(Exception):
        knn_exact(q, df, k=3, dim=16).collect()


def test_duplicate_vectors_both_returned(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = knn_exact(q, df, k=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1]


def test_tiled_equals_broadcast(spark, vecs):
    df, _ = vecs
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    a = knn_exact(q, df, k=4, exclude_self=True).toPandas().sort_values(["query_id", "rank"])
    b = knn_exact(q, df, k=4, exclude_self=True, strategy="tiled", query_block=30,
                  shard_vectors=25).toPandas().sort_values(["query_id", "rank"])
    assert len(a) == len(b) == 400
    assert (a.vec_id.values == b.vec_id.values).all()
    assert np.allclose(a.distance.values, b.distance.values)


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = knn_exact(q, e, k=5, exclude_self=True)
    centers = train_cells(e, 8)
    full = knn_approx(q, e, k=5, centers=centers, nprobe=8, exclude_self=True, shard_vectors=40)
    assert recall_at_k(full, exact).first().recall == pytest.approx(1.0)
    part = knn_approx(q, e, k=5, centers=centers, nprobe=2, exclude_self=True)
    r = recall_at_k(part, exact).first().recall
    assert 0.0 < r < 1.0


def test_persisted_ivf_index(spark):
    import tempfile
    from skein.operators.knn import build_ivf_index, search_ivf_index
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    path = tempfile.mkdtemp(prefix="skein-ivf-")
    build_ivf_index(e, path, n_cells=8)
    full = search_ivf_index(spark, path, q, k=5, nprobe=8, exclude_self=True)
    exact = knn_exact(q, e, k=5, exclude_self=True)
    assert recall_at_k(full, exact).first().recall == pytest.approx(1.0)
    part = search_ivf_index(spark, path, q.limit(5), k=5, nprobe=1)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 25 and "cell" in plan


def test_ties_do_not_depend_on_partitions_blocks_or_id_type(spark):
    """More equal vectors than k: the smallest ids win, however rows are dealt."""
    rows = [(f"v{(i * 7919) % 3000:04d}", [0.1, 0.2, 0.3]) for i in range(3000)]
    rows += [("zero", [0.1, 0.2, 0.3000001])]
    q = spark.createDataFrame([(f"q{i}", [0.1, 0.2, 0.3 + i * 1e-3]) for i in range(7)],
                              "query_id string, embedding array<double>")
    want = None
    for parts, kw in ((1, {}), (7, {}), (64, {}),
                      (3, {"strategy": "tiled", "query_block": 2, "shard_vectors": 500})):
        df = spark.createDataFrame(rows, "vec_id string, embedding array<double>") \
            .repartition(parts)
        got = sorted(tuple(r) for r in knn_exact(q, df, k=5, tie_digits=9, **kw).collect())
        want = want or got
        assert got == want
    assert [r[1] for r in want if r[0] == "q0"] == [f"v{i:04d}" for i in range(5)]
    assert all(r[3] == 0.0 for r in want if r[0] == "q0")


def test_large_integer_ids_tie_exactly(spark):
    base = 2 ** 60
    df = spark.createDataFrame([(base + i, [1.0, 0.0]) for i in (5, 3, 4, 1, 2)],
                               "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = knn_exact(q, df, k=3).orderBy("rank").collect()
    assert [r.vec_id - base for r in got] == [1, 2, 3]


def test_ragged_vectors_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])],
                               "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="length"):
        knn_exact(q, df, k=2).collect()
    with pytest.raises(Exception, match="dimension"):
        knn_exact(q, df.filter("vec_id = 1"), k=2).collect()


def test_popular_cell_is_tiled_on_both_sides(spark, vecs):
    from skein.operators.knn import _probe_cells, default_cells
    df, _ = vecs

    def one_cell():
        return df.select((F.col("vec_id") + 0).alias("_id"),
                         F.slice("embedding", 1, 16).alias("_v"), F.lit(0).alias("cell"))
    got = _probe_cells(one_cell(), one_cell(), 4, True, shard_vectors=30, query_block=40)
    want = knn_exact(df.withColumnRenamed("vec_id", "query_id"), df, k=4, exclude_self=True)
    key = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert key(got) == key(want)
    assert default_cells(10 ** 12, 768) * 768 * 8 <= 64 << 20


def test_short_passages(spark):
    from skein.operators.retrieval import passage_matches
    docs = {1: "alpha xbetay gamma", 2: "a b", 3: None, 4: "", 5: "\U0001F600ab betay", 6: "beta"}
    items = {1: "beta", 2: "a", 3: "", 4: "xbetay gam", 5: "\U0001F600a", 6: "zz", 7: "b", 8: None}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    p = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in passage_matches(d, p).collect()}
    assert got == {(i, j) for i, t in items.items() for j, x in docs.items() if t and x and t in x}


def test_pair_keys_never_collide(spark):
    from skein.plans.registry import pair_key
    df = spark.createDataFrame([(1, 100000), (2, 0)], "a long, b long")
    assert {r[0] for r in df.select(pair_key("a", "b")).collect()} == {"1:100000", "2:0"}


@pytest.mark.parametrize("scale,digits", [(1.0, None), (1.0, 9), (1e-12, None), (1e20, None)])
def test_screening_in_single_precision_loses_nothing(scale, digits):
    from skein.operators.knn import _TopK
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 24)) * scale
    v[500:700] = v[:200]                                    # ties go to the smaller id
    v[700:800] = v[:100] + 1e-9 * scale                     # nearer than single precision tells
    v[850, 3] = np.inf
    q = np.concatenate([v[:60], rng.normal(size=(20, 24)) * scale])
    want = []
    ids = rng.permutation(900)
    for i, x in enumerate(q):
        with np.errstate(all="ignore"):
            d = np.square(x - v).sum(1)
        key = d if digits is None else np.round(d, digits)
        order = [j for j in np.lexsort((ids, key)) if np.isfinite(d[j]) and ids[j] != i]
        want += [(i, ids[j], d[j]) for j in order[:5]]
    for step in (7, 128, 900):
        top = _TopK(np.arange(len(q)), q, 5, True, digits)
        for s in range(0, 900, step):
            top.add(ids[s:s + step], v[s:s + step])
        r = top.result()
        assert list(zip(*[r.column(c).to_pylist() for c in ("query_id", "vec_id", "distance")])) == want


def test_blocks_after_the_first_are_screened_by_the_kth_alone(monkeypatch):
    from skein.operators.knn import _TopK
    sorted_blocks = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: sorted_blocks.append(1) or real(*a, **k))
    m = np.random.default_rng(1).normal(size=(1000, 8))
    top = _TopK(np.arange(50), m[:50], 5, True)
    for s in range(0, 1000, 100):
        top.add(np.arange(s, s + 100), m[s:s + 100])
    assert len(sorted_blocks) == 1


def test_tiles_grow_with_the_tables():
    from skein.operators.knn import TILE_FLOATS, _tile_size
    assert _tile_size(4096, 3000, 64, 12) == 4096
    assert _tile_size(4096, 600_000, 64, 12) == 100_000     # few copies, a few tiles a core
    assert _tile_size(4096, 10 ** 9, 64, 12) == TILE_FLOATS // 64
