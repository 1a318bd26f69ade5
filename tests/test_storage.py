import os
import tempfile

import pytest
from pyspark.sql import functions as F

from skein.operators import embed as E
from skein.session import ship_package
from skein.sources import sessions as SIO
from skein.sources import snapshots as SN
from skein.sources import tables as TB


def _tmp():
    return tempfile.mkdtemp(prefix="skein-test-")


def test_url_list(spark):
    d = _tmp()
    p = os.path.join(d, "urls.txt")
    with open(p, "w") as f:
        f.write("https://a.com/1\n# comment\n\n  https://b.com/2  \nhttps://a.com/1\n")
    got = [r.url for r in TB.read_url_list(spark, p).orderBy("line_no").collect()]
    assert got == ["https://a.com/1", "https://b.com/2", "https://a.com/1"]


def test_catalog_last_write_wins(spark):
    old = spark.createDataFrame([("u1", "t-old", 3, 1), ("u2", "t2", 1, 2)],
                                "article_id string, title string, chunks int, ingested_at int")
    new = spark.createDataFrame([("u1", "t-new", 5, 3)],
                                "article_id string, title string, chunks int, ingested_at int")
    got = {r.article_id: r for r in TB.catalog_upsert(old, new).collect()}
    assert got["u1"].title == "t-new" and got["u1"].chunks == 5 and got["u2"].chunks == 1


def test_vectors_append_and_dim_check(spark):
    d = os.path.join(_tmp(), "vec")
    ok = spark.createDataFrame([(0, [1.0, 0.0], "m0"), (1, [0.0, 1.0], "m1")],
                               "vec_id long, embedding array<float>, meta string")
    TB.append_vectors(ok, d, dim=2)
    TB.append_vectors(ok, d, dim=2)   # duplicates allowed
    df, good = TB.read_vectors(spark, d, expected_count=4)
    assert good and df.count() == 4
    bad = spark.createDataFrame([(2, [1.0, 0.0, 0.0], "m2")],
                                "vec_id long, embedding array<float>, meta string")
    with pytest.raises(Exception):
        TB.append_vectors(bad, d, dim=2)
    _, good = TB.read_vectors(spark, d, expected_count=5)
    assert not good
    _, good = TB.read_vectors(spark, os.path.join(_tmp(), "missing"))
    assert not good


def test_snapshots(spark):
    root = _tmp()
    vec = spark.createDataFrame([(0, [1.0], "a"), (1, [2.0], "a"), (2, [3.0], "b")],
                                "vec_id long, embedding array<float>, article_id string")
    cat = spark.createDataFrame([("a", "ta", 2), ("b", "tb", 1)],
                                "article_id string, title string, chunks int")
    assert SN.save_snapshot(spark, root, "s1", vec, cat, "first")["success"]
    assert not SN.save_snapshot(spark, root, "s1", vec, cat, overwrite=False)["success"]
    assert SN.save_snapshot(spark, root, "s2", vec.limit(2), cat)["success"]
    loaded = SN.load_snapshot(spark, root, "s1")
    assert loaded["success"] and loaded["metadata"]["total_chunks"] == 3
    assert loaded["metadata"]["total_articles"] == 2
    assert not SN.load_snapshot(spark, root, "nope")["success"]
    lst = SN.list_snapshots(spark, root).collect()
    assert [r.name for r in lst] == ["s2", "s1"] and all(r.size_bytes > 0 for r in lst)


def test_sessions_roundtrip_and_corrupt(spark):
    d = os.path.join(_tmp(), "sessions")
    msgs = spark.createDataFrame(
        [("s1", 0, "user", "Q0"), ("s1", 1, "assistant", "A0"), ("s2", 0, "user", "hi")],
        "session_id string, seq long, role string, content string")
    SIO.save_sessions(msgs, d)
    with open(os.path.join(d, "part-corrupt.json"), "w") as f:
        f.write("invalid json {{{\n")
    got = SIO.load_sessions(spark, d).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.content) for r in got] == [
        ("s1", 0, "Q0"), ("s1", 1, "A0"), ("s2", 0, "hi")]


def test_embedding_cache_flow(spark):
    ship_package(spark)
    path = os.path.join(_tmp(), "cache")
    req = spark.createDataFrame([(i, f"Text {i % 10}") for i in range(15)], "seq int, text string")
    first = req.filter("seq < 10")
    stats0 = E.cache_stats(req, TB.read_cache(spark, path)).first()
    assert (stats0.total_requests, stats0.hits, stats0.misses, stats0.cache_size) == (15, 5, 10, 10)
    assert stats0.hit_rate == pytest.approx(1 / 3)
    out, new = E.embed_cached(first, TB.read_cache(spark, path))
    TB.append_cache(new, path)
    assert TB.read_cache(spark, path).count() == 10
    out2, new2 = E.embed_cached(req, TB.read_cache(spark, path))
    assert new2.count() == 0 and out2.filter(F.col("embedding").isNull()).count() == 0
    s = E.cache_stats(req, TB.read_cache(spark, path)).first()
    assert (s.hits, s.misses, s.cache_size) == (15, 0, 10)
    nocache = E.cache_stats(req, TB.read_cache(spark, path), use_cache=False).first()
    assert (nocache.hits, nocache.misses) == (0, 15)
    TB.clear_cache(spark, path)
    assert TB.read_cache(spark, path).count() == 0


def test_articles_sink_and_source(spark):
    from skein.operators.extract import extract_articles
    ship_package(spark)
    d = os.path.join(_tmp(), "articles")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    arts = extract_articles(pages, extracted_at=F.lit("2024-01-01 00:00:00")).drop("page_id")
    TB.write_articles(arts, d, fmt="json")
    back = TB.read_articles(spark, d)
    assert back.count() == arts.count() > 0
    assert set(TB.ARTICLE_SCHEMA.fieldNames()) <= set(back.columns)
    idx = TB.article_file_index(back).collect()
    assert all(r.filename.endswith("_20240101_000000.json") for r in idx)
    assert TB.read_file_index(spark, os.path.join(_tmp(), "missing")).count() == 0


def test_truncate(spark):
    d = os.path.join(_tmp(), "vec")
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    df.write.parquet(d)
    TB.truncate(spark.read.parquet(d), d + "_next")
    t = spark.read.parquet(d + "_next")
    assert t.count() == 0 and t.columns == ["vec_id", "embedding"]


def test_short_passages_scan(spark):
    from skein.operators.retrieval import passage_matches
    ship_package(spark)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "xbetagam yy"), (3, "none here")],
                                 "doc_id long, text string")
    passages = spark.createDataFrame([(10, "beta gam"), (11, "here"), (12, "beta gamma delta"),
                                      (13, "zzz")], "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in passage_matches(docs, passages).collect())
    assert got == [(10, 1), (11, 3), (12, 1)]


def test_snapshot_versions(spark):
    root = _tmp()
    cat = spark.createDataFrame([("a", "ta")], "article_id string, title string")
    one = spark.createDataFrame([(0, [1.0], "a")], "vec_id long, embedding array<float>, article_id string")
    assert SN.save_snapshot(spark, root, "s", one, cat)["success"]
    # a save that fails half way leaves the stored snapshot as it was
    broken = one.withColumn("embedding", F.raise_error(F.lit("lost")).cast("array<float>"))
    try:
        SN.save_snapshot(spark, root, "s", broken, cat)
        raise AssertionError("the save should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert SN.load_snapshot(spark, root, "s")["metadata"]["total_chunks"] == 1
    assert SN.save_snapshot(spark, root, "s", one.union(one), cat)["success"]
    loaded = SN.load_snapshot(spark, root, "s")
    assert loaded["vectors"].count() == 2 and SN.list_snapshots(spark, root).count() == 1
    assert SN.drop_old_versions(spark, root, "s") == 1
    assert SN.load_snapshot(spark, root, "s")["vectors"].count() == 2


def test_session_list_and_timestamps(spark):
    from skein.operators.sessions import history_text
    d = os.path.join(_tmp(), "sessions")
    msgs = spark.createDataFrame([("s1", 0, "user", "Q", "2024-01-02 03:04:05")],
                                 "session_id string, seq long, role string, content string, timestamp string")
    known = spark.createDataFrame([("s1", "2024-01-01 00:00:00"), ("s2", "2024-01-01 00:00:01")],
                                  "session_id string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    SIO.save_sessions(msgs, d, sessions=known)
    got = SIO.load_sessions(spark, d).collect()
    assert [(r.session_id, r.content, str(r.timestamp)) for r in got] == [("s1", "Q", "2024-01-02 03:04:05")]
    listed = SIO.list_sessions(spark, d).orderBy("session_id").collect()
    assert [(r.session_id, r.message_count) for r in listed] == [("s1", 1), ("s2", 0)]
    texts = history_text(msgs, sessions=known).orderBy("session_id").collect()
    assert [r.history_text for r in texts] == ["User: Q", ""]
