"""Accumulating statistics, committed vector tables, statistics blocks."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import reports as RP
from skein.operators import trackers as TR
from skein.operators.embed import cache_stats
from skein.sources import tables as TB


def _tmp():
    return tempfile.mkdtemp(prefix="skein-track-")


def test_batches_merge_like_one(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(1, 6000), np.full(2000, 0.25), rng.normal(50, 1, 40)])
    rng.shuffle(values)
    path = _tmp()
    parts = np.array_split(values, 9)
    for i, part in enumerate(parts):
        TR.track(spark.createDataFrame([(float(v),) for v in part] + [(None,)], "response_time double"), path, i)
    TR.track(spark.createDataFrame([(float(v),) for v in parts[4]], "response_time double"), path, 4)   # a retried call
    got = TR.tracked_stats(spark, path).first()
    assert got["count"] == len(values) and got["mean"] == pytest.approx(values.mean())
    assert (got["min"], got["max"]) == (values.min(), values.max())
    for name, p in TR.QUANTILES.items():
        low, high = (values < got[name]).mean(), (values <= got[name]).mean()
        assert low - 0.01 <= p <= high + 0.01, name
    assert got["median"] == got["p50"]


def test_groups_and_empty_trackers(spark):
    path = _tmp()
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0), ("c", None)], "kind string, t double")
    TR.track(rows, path, "x", "t", ["kind"])
    TR.track(rows, path, "y", "t", ["kind"])
    got = {r["kind"]: (r["count"], r["mean"], r["p50"]) for r in TR.tracked_stats(spark, path, ["kind"]).collect()}
    assert got[None] == (2, 7.0, 7.0) and got["a"][:2] == (4, 2.0) and set(got) == {None, "a", "b"}
    none = TR.merged(TR.summaries(rows.limit(0), "t", "kind")).first()
    assert none["count"] == 0 and none["mean"] is None and none["p99"] is None


def test_vector_table_commits(spark):
    path = os.path.join(_tmp(), "vectors")
    kind = "vec_id long, embedding array<float>, meta string"
    empty, ok = TB.load_vectors(spark, path, kind)
    assert not ok and empty.count() == 0 and empty.columns == ["vec_id", "embedding", "meta"]
    one = spark.createDataFrame([(0, [1.0, 0.0], "a")], kind)
    two = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b")], kind)
    assert TB.save_vectors(one, path, 2)["vectors"] == 1
    TB.save_vectors(two, path, 2)
    got, ok = TB.load_vectors(spark, path)
    assert ok and got.count() == 2
    with pytest.raises(Exception):          # a failed save leaves the table as it was
        TB.save_vectors(spark.createDataFrame([(2, [1.0], "c")], kind), path, 2)
    assert TB.load_vectors(spark, path)[0].count() == 2
    # a commit whose files are not whole does not load
    folder = TB.save_vectors(two, path, 2)
    os.makedirs(f"{path}/commits", exist_ok=True)
    with open(f"{path}/commits/part-x.json", "w") as f:
        json.dump({"version": folder["version"], "vectors": 5, "dimension": 2, "saved_at": "2999-01-01T00:00:00.000Z"}, f)
    got, ok = TB.load_vectors(spark, path)
    assert not ok and got.count() == 0
    missing, ok = TB.read_vectors(spark, os.path.join(_tmp(), "none"))
    assert not ok and missing.count() == 0 and missing.columns == ["vec_id", "embedding"]


def test_statistics_blocks(spark):
    chunks = spark.createDataFrame([("u1", "x", [1.0, 2.0]), ("u1", "y", [1.0, 2.0]), ("u2", "x", None)],
                                   "article_id string, chunk string, embedding array<float>")
    catalog = chunks.select("article_id").distinct()
    got = RP.system_stats(catalog, chunks, cache=cache_stats(chunks, None, "chunk"), params={"degree": 16}).first()
    assert (got["total_articles"], got["total_chunks"], got["store_dimension"], got["store_metadata_count"]) == (2, 3, 2, 2)
    assert (got["cache_total_requests"], got["cache_hits"], got["cache_misses"], got["store_degree"]) == (3, 1, 2, 16)
    plain = RP.system_stats(catalog, chunks).first()
    assert tuple(plain) == (2, 3, 3)
    stats = RP.vector_stats(chunks.withColumn("m", F.when(F.col("chunk") == "x", 1)), metadata="m").first()
    assert stats["metadata_count"] == 2 and stats["total_vectors"] == 3
