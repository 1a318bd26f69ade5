"""Cases that earlier plans got wrong."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.operators import chunk as C
from skein.operators.embed import embed_cached
from skein.operators.evaluate import latency_stats
from skein.operators.knn import knn_exact
from skein.sources.tables import read_file_index, read_url_list


def test_numeric_references(spark):
    cases = {"&#00000000065;": "A", "&#9999999;": "�", "&#99999999999;": "�", "&#0;": "�",
             "&#xD800;": "�", "&#128;": "€", "&#x80;": "€", "&#x1F600;": "\U0001F600"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", H.decode_entities("t").alias("d")).collect()}
    assert got == cases


def test_recursive_chunks_follow_the_rules():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", "\n", "\n\n", "longword"]) for _ in range(rng.randint(0, 60)))
        size = rng.randint(3, 30)
        overlap = rng.randint(0, size - 1)
        spans = list(C.recursive_spans(text, size, overlap, C.RECURSIVE_SEPARATORS)) if text else []
        assert all(b - a <= size for a, b, whole in spans if not whole)
        assert [a for a, _b, _w in spans] == sorted(a for a, _b, _w in spans)
        seen = set()
        for a, b, _w in spans:
            seen.update(range(a, b))
        assert seen == set(range(len(text)))                    # nothing is lost
        for (_, end, _w), (start, _, _w2) in zip(spans, spans[1:]):
            assert end - overlap <= start <= end


def test_cache_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    first, rows = embed_cached(df, spark.createDataFrame(
        [], "model string, text_hash string, dimensions int, created_at timestamp, embedding array<float>"))
    cache = rows.unionByName(rows)
    again, new = embed_cached(df, cache)
    assert again.count() == 1 and new.count() == 0


def test_null_group_has_percentiles(spark):
    df = spark.createDataFrame([(None, 4.0), (None, 8.0), ("a", 1.0)], "g string, v double")
    row = {r["g"]: r for r in latency_stats(df, "v", ["g"]).collect()}[None]
    assert (row["count"], row["p50"]) == (2, 6.0)


def test_ragged_vectors_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception):
        knn_exact(q, v, k=2).collect()


def test_url_list_and_unreadable_index(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a\n\t\n\t# c\n  http://b\t\n")
    assert [r["url"] for r in read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == \
        ["http://a", "http://b"]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "part-0.parquet").write_text("not parquet")
    assert read_file_index(spark, str(tmp_path / "index")).count() == 0
    assert read_file_index(spark, str(tmp_path / "none")).count() == 0
