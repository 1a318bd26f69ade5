"""A search is a plan: whatever reads it twice makes it run twice."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from skein.operators import rag as G
from skein.plans import conversation as CV
from skein.session import ship_package


def counted(spark, kind):
    """A column function that counts the rows it is worked out for."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x
    return seen, F.udf(see, kind)


def test_rag_hits_search_once(spark, monkeypatch):
    ship_package(spark)
    seen, see = counted(spark, "string")
    search = CV.R.search
    monkeypatch.setattr(CV.R, "search", lambda *a, **k: search(*a, **k).withColumn("chunk_id", see("chunk_id")))
    hits = CV.rag_hits(spark, SF_SMALL, 3)
    assert hits.count() == seen.value > 0


def test_rag_batch_searches_once(spark):
    ship_package(spark)
    seen, see = counted(spark, "array<float>")
    index = spark.createDataFrame([(f"c{i}", f"t{i}", f"http://x/{i}", f"chunk {i}", [float(i), 1.0]) for i in range(20)],
                                  "chunk_id string, title string, url string, chunk string, embedding array<float>")
    asked = spark.createDataFrame([(1, "s", "first", 0), (2, "s", "second", 1), (3, None, "third", 0)],
                                  "query_id long, session_id string, question string, turn_order long")
    answers, _ = G.rag_batch(asked, index.withColumn("embedding", see("embedding")), lambda ps: ["See [1]." for _ in ps],
                             embed_fn=lambda texts: [[float(len(t)), 1.0] for t in texts], k=2)
    got = {r["query_id"]: [s["url"] for s in r["sources"]] for r in answers.collect()}
    assert got == {1: ["http://x/5"], 2: ["http://x/6"], 3: ["http://x/5"]}
    # one search reads the embeddings of the index, for its null check and for the distances
    assert seen.value <= 40
