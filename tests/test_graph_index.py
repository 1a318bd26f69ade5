"""Graph search: recall, work, edge cases; bounded exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.graph_index import graph_index, knn_bounded, neighbour_lists, search_graph, walk
from skein.operators.knn import knn_exact, recall_at_k
from skein.plans import retrieval
from skein.session import write_shared


def clustered(spark, n=1500, dims=16, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims)) * 6
    x = centers[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.4
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "vec_id long, embedding array<float>")


def queries_of(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    root = f"/root/testdata/{sf}"
    found = retrieval.q_knn_approx(spark, root)
    e = spark.read.parquet(f"{root}/embeddings.parquet")
    exact = knn_exact(queries_of(e), e, k=5, exclude_self=True)
    assert recall_at_k(found, exact).first().recall >= 0.95
    hits = search_graph(queries_of(e), retrieval.embedding_graph(spark, root), 5, exclude_self=True)
    n = e.count()
    share = hits.groupBy("query_id").agg(F.first("scanned").alias("s")).agg(F.avg("s")).first()[0] / n
    print(f"{sf}: {share:.2f} of the vectors measured a query")
    assert share < (0.9 if n < 1000 else 0.5)


def test_several_cells_and_parts(spark):
    df = clustered(spark)
    exact = write_shared(knn_exact(queries_of(df), df, k=5), "exact")
    index = write_shared(graph_index(df, cell_size=200), "graph")
    assert index.where("node = -1").count() == 8
    assert index.where("node >= 0").groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 400
    hits = write_shared(search_graph(queries_of(df), index, 5, nprobe=3, query_block=100), "hits")
    assert recall_at_k(hits, exact).first().recall >= 0.95
    assert hits.groupBy("query_id").agg(F.first("scanned").alias("s")).agg(F.avg("s")).first()[0] < 750
    joined = hits.join(exact.select("query_id", "vec_id", F.col("distance").alias("d")), ["query_id", "vec_id"])
    assert joined.where(F.abs(F.col("distance") - F.col("d")) > 1e-9).count() == 0


def test_graph_edge_cases(spark):
    kind = "vec_id string, embedding array<double>"
    empty = write_shared(graph_index(spark.createDataFrame([], kind)), "graph")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, embedding array<double>")
    assert search_graph(q, empty, 3).count() == 0
    assert knn_bounded(q, empty, 3)[0].count() == 0
    few = spark.createDataFrame([("v1", [1.0, 0.0]), ("v2", [1.0, 0.0]), ("v3", [0.0, 1.0]), ("v4", None)], kind)
    index = write_shared(graph_index(few), "graph")
    got = [(r["vec_id"], r["rank"], r["distance"]) for r in search_graph(q, index, 9).orderBy("rank").collect()]
    assert got == [("v1", 1, 0.0), ("v2", 2, 0.0), ("v3", 3, 2.0)]      # ties by id, k > n
    assert search_graph(q, index, 0).count() == 0
    with pytest.raises(ValueError):
        search_graph(q, index, -1)
    with pytest.raises(ValueError):
        graph_index(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], kind))


def test_walk_reaches_every_node_with_a_wide_beam():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[100:140] = m[7]                               # equal vectors
    lists = neighbour_lists(m, 8)
    links = np.full((300, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        assert i not in own and len(set(own.tolist())) == len(own)
        links[i, :len(own)] = own
    ids, dist, measured = walk(m, links, m[:20], 300)
    assert all(len(set(r.tolist())) >= 250 for r in ids) and (measured <= 300).all()


@pytest.mark.parametrize("cell_size,block", [(100, 64), (2000, 512)])
def test_bounded_is_exact(spark, cell_size, block):
    df = clustered(spark)
    index = write_shared(graph_index(df, cell_size=cell_size, degree=4), "graph")
    hits, work = knn_bounded(queries_of(df), index, 5, exclude_self=True, query_block=block)
    want = knn_exact(queries_of(df), df, k=5, exclude_self=True)
    a, b = (sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in x.collect())
            for x in (hits, want))
    assert a == b
    done = work.agg(F.sum("measured")).first()[0]
    if cell_size == 100:
        assert done < 0.25 * 1500 * 1500            # most of all pairs are never measured


def test_bounded_with_fewer_than_k_in_the_first_cell(spark):
    rows = [(i, [float(i // 3 * 10), float(i % 3)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = write_shared(graph_index(df, cell_size=3, degree=2), "graph")
    hits, _ = knn_bounded(queries_of(df), index, 7)
    want = knn_exact(queries_of(df), df, k=7)
    a, b = (sorted((r["query_id"], r["rank"], r["vec_id"]) for r in x.collect()) for x in (hits, want))
    assert a == b


def test_bounded_copies_queries_to_groups_not_to_cells(spark, monkeypatch):
    """Where the bounds rule out nothing, a query goes once to a group of cells."""
    import skein.session as session
    kept = {}

    def keep(df, name, write=session.write_shared):
        kept.setdefault(name, []).append(write(df, name))
        return kept[name][-1]
    monkeypatch.setattr(session, "write_shared", keep)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(1200, 32)))],
                               "vec_id long, embedding array<float>")
    index = write_shared(graph_index(df, cell_size=10, degree=2), "graph")
    hits, _ = knn_bounded(queries_of(df), index, 3, exclude_self=True, query_block=400, group_vectors=300)
    want = knn_exact(queries_of(df), df, k=3, exclude_self=True)
    a, b = (sorted((r["query_id"], r["rank"], r["vec_id"]) for r in x.collect()) for x in (hits, want))
    assert a == b
    first, second = kept["asked"]
    groups = second.select(F.explode("groups")).distinct().count()
    assert second.select(F.explode("groups")).count() <= 1200 * groups
    assert groups < 30 and index.where("node = -1").count() >= 100
    assert first.agg(F.max(F.size("groups"))).first()[0] == 1


def test_bounded_cuts_a_crowded_cell(spark):
    rows = [(i, [1.0, 0.0] if i < 300 else [float(i), 1.0]) for i in range(340)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = write_shared(graph_index(df, cell_size=40, degree=2), "graph")
    hits, _ = knn_bounded(queries_of(df), index, 4, exclude_self=True, query_block=50, group_vectors=60)
    want = knn_exact(queries_of(df), df, k=4, exclude_self=True)
    a, b = (sorted((r["query_id"], r["rank"], r["vec_id"]) for r in x.collect()) for x in (hits, want))
    assert a == b
