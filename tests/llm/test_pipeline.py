"""The pipeline's stages, each on its own input, against brute force."""

import re

import brute
import corpus_pipeline as P
import duckdb
from pyspark.sql import functions as F

from skein.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    names = [n for n, _f in P.STAGES]
    assert names == ["language_id", "near_copies", "decontamination", "personal_data", "packing"]
    junk = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "?? 12", "en", "s", 5)], docs.schema)
    one = P.language(spark, docs.unionByName(junk), SF).cache()
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} >= {r["doc_id"] for r in docs.collect()} - {10_000, 10_001}
    assert one.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    two = P.one_of_each(spark, one, SF).cache()
    assert {r["doc_id"] for r in two.collect()} == {i for i, _n, c in brute.components(rows) if i == c}
    three = P.without_benchmark(spark, two, SF).cache()
    kept = {r["doc_id"] for r in three.collect()}
    for r in two.collect():
        body = brute.plain(r["text"])
        exact = any(brute.plain(t) in body for _i, t in items)
        assert not (exact and r["doc_id"] in kept)
    weights = pii.fit(three)
    spans = {r["doc_id"]: r["pii"] for r in pii.find(three, weights).collect()}
    four = P.without_personal_data(spark, three, SF).cache()
    before = {r["doc_id"]: r for r in three.collect()}
    assert four.columns == docs.columns and four.count() == three.count()
    for r in four.collect():
        own = [(s["kind"], s["start"], s["end"]) for s in spans[r["doc_id"]]]
        assert r["text"] == brute.mask(before[r["doc_id"]]["text"], own)
        assert brute.private(r["text"])[:4] == (0, 0, 0, 0)
        assert r["n_chars"] == (len(r["text"]) if own else before[r["doc_id"]]["n_chars"])
    five = P.packed(spark, four, SF)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == kept


def test_run_is_the_chain_of_stages(spark):
    out = P.run(spark, SF)
    assert out.where("piece = 0").count() == out.select("doc_id").distinct().count() > 0
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert P.ORACLE_SQL is None and re.match("packing", P.STAGES[-1][0])


def test_awkward_rows_through_all_stages(spark):
    """Null, empty, very long and repeated rows with extra, clashing columns."""
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    lang = given.first()["lang"]
    long = given.first()["text"]
    rows = [(i, t, lang, "s", None) for i, t in brute.rows()] + [(50_000, (long + " ") * 300, lang, "s", 1)] * 2
    extra = ("lang_pred", "spans", "g", "h", "n", "id", "component_id", "item_id", "piece")
    docs = given.unionByName(spark.createDataFrame(rows, given.schema)).select(
        "*", *[F.lit("x").alias(c) for c in extra]).repartition(5)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = P.write_shared(out, name)
        assert docs.where(F.col("spans") != "x").count() == 0
    kept = docs.count()
    assert kept > 50 and docs.where("doc_id = 50000").count() <= 1
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == kept


def test_no_rows_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = P.write_shared(out, name)
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0
