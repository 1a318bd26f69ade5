"""Embedding and search plans: ``documents`` chunks are the corpus,
``benchmark`` passages are the questions, and a document is relevant to a
passage when it contains it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunk as C
from skein.operators import evaluate as ev
from skein.operators import embed as E
from skein.operators import retrieval as R
from skein.plans.registry import load, pair_key, register, stored
from skein.session import write_shared

K = 5
DIM = E.DEFAULT_DIM
SIZE, STEP = C.DEFAULT_CHUNK_SIZE, C.DEFAULT_CHUNK_SIZE - C.DEFAULT_CHUNK_OVERLAP


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", spread=True)
    ch = C.chunk_fixed(d.select("doc_id", "lang", "source", "text"))
    return ch.select(pair_key("doc_id", "chunk_index").alias("chunk_id"),
                     F.col("doc_id").cast("string").alias("article_id"), "doc_id",
                     "chunk_index", "chunk", "lang", "source")


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table with vectors, identical chunk texts embedded once: the
    stored index that later steps read."""
    return stored(spark, sf, "chunk-vectors", ["documents"],
                  lambda s, d: E.embed_dedup(doc_chunks(s, d), "chunk"))


def search_hits(spark: SparkSession, sf: str, k: int = K, index: DataFrame | None = None) -> DataFrame:
    b = load(spark, sf, "benchmark")
    return R.search(b.select(F.col("item_id").alias("query_id"), "text"),
                    index if index is not None else chunk_vectors(spark, sf), k=k)


# --- DuckDB: the same embedding as sparse rows, distances by bucket join ----

def _sparse_sql(src: str, key: str, text: str, out: str) -> str:
    from skein.plans.sqltext import words
    return f"""
{out}_w AS (SELECT {key}, unnest({words(text)}) AS w FROM {src}),
{out}_g AS (SELECT {key}, substr(' ' || w || ' ', i + 1, 3) AS g
            FROM (SELECT {key}, w, unnest(range(0, length(w))) AS i FROM {out}_w)),
{out}_c AS (SELECT {key}, ('0x' || substr(md5(g), 1, 4))::INT % {DIM} AS bucket, count(*) AS c
            FROM {out}_g GROUP BY ALL),
{out} AS (SELECT {key}, bucket,
                 (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w
          FROM {out}_c)"""


_CHUNKS_SQL = f"""
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT doc_id, text,
             unnest(CASE WHEN n <= {SIZE} THEN [0::BIGINT] ELSE range(0, n, {STEP}) END) AS st FROM d),
ch AS (SELECT doc_id || ':' || (st // {STEP}) AS chunk_id, doc_id, st // {STEP} AS chunk_index,
              substr(text, st + 1, {SIZE}) AS chunk FROM s)"""

_SEARCH_SQL = "WITH " + _CHUNKS_SQL + "," + _sparse_sql("ch", "chunk_id", "chunk", "cv") + "," + \
    _sparse_sql("benchmark", "item_id", "text", "qv") + f""",
cn AS (SELECT ch.chunk_id, coalesce(sum(cv.w * cv.w), 0) AS nn FROM ch
       LEFT JOIN cv ON cv.chunk_id = ch.chunk_id GROUP BY ch.chunk_id),
qn AS (SELECT b.item_id AS query_id, coalesce(sum(qv.w * qv.w), 0) AS nn FROM benchmark b
       LEFT JOIN qv ON qv.item_id = b.item_id GROUP BY b.item_id),
dots AS (SELECT qv.item_id AS query_id, cv.chunk_id, sum(qv.w * cv.w) AS dot
         FROM qv JOIN cv USING (bucket) GROUP BY ALL),
pairs AS (SELECT qn.query_id, cn.chunk_id,
                 greatest(qn.nn + cn.nn - 2 * coalesce(dots.dot, 0), 0) AS distance
          FROM qn CROSS JOIN cn
          LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.chunk_id = cn.chunk_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                      ORDER BY round(distance, 9), chunk_id) AS rank
         FROM pairs QUALIFY rank <= {K})
"""


@register("embed_texts", sql="WITH " + _sparse_sql("documents", "doc_id", "text", "sv") + """
SELECT doc_id, bucket::BIGINT AS bucket, round(w, 6) AS weight FROM sv""")
def q_embed_texts(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    v = E.embed_texts(d.select("doc_id", "text"), "text", E.hashed_embedder(DIM))
    x = v.select("doc_id", F.posexplode("embedding").alias("bucket", "w"))
    return x.filter(F.col("w") != 0).select(
        "doc_id", F.col("bucket").cast("bigint"), F.round(F.col("w").cast("double"), 6).alias("weight"))


@register("embed_dedup", sql="WITH " + _CHUNKS_SQL + "," + _sparse_sql(
    "(SELECT DISTINCT chunk FROM ch)", "chunk", "chunk", "uv") + """
, agg AS (SELECT chunk, count(*) AS nnz, sum(w) AS wsum FROM uv GROUP BY chunk)
SELECT ch.chunk_id, sha256(ch.chunk) AS text_hash, coalesce(agg.nnz, 0)::BIGINT AS nnz,
       round(coalesce(agg.wsum, 0), 5) AS wsum
FROM ch LEFT JOIN agg ON agg.chunk = ch.chunk""")
def q_embed_dedup(spark, sf):
    v = E.embed_dedup(doc_chunks(spark, sf), "chunk")
    return v.select("chunk_id", "text_hash",
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nnz"),
                    F.round(F.aggregate("embedding", F.lit(0.0),
                                        lambda a, x: a + x.cast("double")), 5).alias("wsum"))


def _cache_inputs(spark, sf):
    """Requests: every document text and every benchmark passage; the cache
    already holds the passages' vectors."""
    d = load(spark, sf, "documents").select(F.col("text"))
    b = load(spark, sf, "benchmark").select(F.col("text"))
    _, cache_rows = E.embed_cached(b, None, "text", E.hashed_embedder(DIM))
    return d.unionByName(b), cache_rows


@register("embed_cached", sql="WITH req AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)," + _sparse_sql(
    "(SELECT DISTINCT text FROM req)", "text", "text", "uv") + """,
cache AS (SELECT DISTINCT sha256(text) AS h FROM benchmark),
n AS (SELECT text, count(*) AS n_requests FROM req GROUP BY text),
v AS (SELECT text, string_agg(bucket || ':' || round(w * 10000)::BIGINT, ' ' ORDER BY bucket) AS vector
      FROM uv GROUP BY text)
SELECT sha256(n.text) AS text_hash, n.n_requests, c.h IS NOT NULL AS cached, coalesce(v.vector, '') AS vector
FROM n LEFT JOIN v USING (text) LEFT JOIN cache c ON c.h = sha256(n.text)""")
def q_embed_cached(spark, sf):
    """Requests per text with whether the cache held it, and the vector's entries in
    ten-thousandths as ``bucket:weight``."""
    req, cache = _cache_inputs(spark, sf)
    out, _new = E.embed_cached(req, cache, "text", E.hashed_embedder(DIM))
    known = cache.select("text_hash", F.lit(True).alias("_k"))
    # all requests of a text have one vector: counted by its hash
    n = (out.join(known, "text_hash", "left").groupBy("text_hash")
         .agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.max("_k"), F.lit(False)).alias("cached"),
              F.max("embedding").alias("embedding")))
    entries = F.filter(F.transform("embedding", lambda w, i: F.struct(i.alias("i"), w.cast("double").alias("w"))),
                       lambda e: e["w"] != 0)
    return n.select("text_hash", "n_requests", "cached", F.array_join(F.transform(entries, lambda e: F.concat_ws(
        ":", e["i"].cast("string"), F.round(e["w"] * 10000).cast("long").cast("string"))), " ").alias("vector"))


@register("cache_stats", sql="""
WITH req AS (SELECT sha256(text) AS h FROM documents UNION ALL SELECT sha256(text) FROM benchmark),
cache AS (SELECT DISTINCT sha256(text) AS h FROM benchmark),
new AS (SELECT DISTINCT h FROM req WHERE h NOT IN (SELECT h FROM cache))
SELECT (SELECT count(*) FROM req) AS total_requests,
       (SELECT count(*) FROM req) - (SELECT count(*) FROM new) AS hits,
       (SELECT count(*) FROM new) AS misses,
       (SELECT count(*) FROM cache) + (SELECT count(*) FROM new) AS cache_size,
       ((SELECT count(*) FROM req) - (SELECT count(*) FROM new))::DOUBLE
         / (SELECT count(*) FROM req) AS hit_rate""")
def q_cache_stats(spark, sf):
    req, cache = _cache_inputs(spark, sf)
    return E.cache_stats(req, cache, "text")


@register("semantic_search", sql=_SEARCH_SQL + """
SELECT h.query_id, h.rank, h.chunk_id, round(h.distance, 6) AS distance,
       round(1.0 / (1.0 + h.distance), 6) AS similarity, ch.chunk,
       'Unknown' AS title, '' AS url
FROM hits h JOIN ch USING (chunk_id)""")
def q_semantic_search(spark, sf):
    index = chunk_vectors(spark, sf)
    hits = write_shared(search_hits(spark, sf, index=index), "hits")     # a few numbers a question
    out = R.semantic_search(hits, index.drop("embedding", "text_hash"))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                      F.round("distance", 6).alias("distance"),
                      F.round("similarity", 6).alias("similarity"), "chunk",
                      F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"))


@register("semantic_search_flat", sql=_SEARCH_SQL + """
SELECT h.query_id, h.rank, round(h.distance, 6) AS distance,
       round(1.0 / (1.0 + h.distance), 6) AS similarity, ch.chunk,
       'Unknown' AS title, '' AS url, 'Unknown' AS publish_date
FROM hits h JOIN ch USING (chunk_id)""")
def q_semantic_search_flat(spark, sf):
    index = chunk_vectors(spark, sf)
    hits = write_shared(search_hits(spark, sf, index=index), "hits")     # a few numbers a question
    out = R.semantic_search_flat(hits, index.drop("embedding", "text_hash"))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"),
                      F.round("distance", 6).alias("distance"),
                      F.round("similarity", 6).alias("similarity"), "chunk", "title", "url",
                      "publish_date")


@register("retrieve_context", sql=_SEARCH_SQL + """
SELECT h.query_id, h.rank, ch.chunk, 'Unknown' AS title, '' AS url,
       ch.doc_id::VARCHAR AS article_id, round(h.distance, 6) AS distance
FROM hits h JOIN ch USING (chunk_id)""")
def q_retrieve_context(spark, sf):
    index = chunk_vectors(spark, sf)
    hits = write_shared(search_hits(spark, sf, index=index), "hits")     # a few numbers a question
    out = R.retrieve_context(hits, index.drop("embedding", "text_hash"))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk", "title",
                      "url", "article_id", F.round("distance", 6).alias("distance"))


@register("passage_relevance", sql="""
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def q_passage_relevance(spark, sf):
    return R.passage_matches(load(spark, sf, "documents", spread=True), load(spark, sf, "benchmark"))


@register("search_eval", sql=_SEARCH_SQL + """
, rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b
          JOIN documents d ON contains(d.text, b.text)),
hr AS (SELECT h.query_id, h.rank, ch.doc_id,
              EXISTS (SELECT 1 FROM rel r WHERE r.query_id = h.query_id AND r.doc_id = ch.doc_id) AS relevant
       FROM hits h JOIN ch USING (chunk_id)),
run AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank
                                           ROWS UNBOUNDED PRECEDING) AS so_far FROM hr),
per AS (SELECT b.item_id AS query_id,
               coalesce(1.0 / min(r.rank) FILTER (WHERE r.relevant), 0.0) AS rr,
               CASE WHEN count(*) FILTER (WHERE r.relevant) > 0
                    THEN sum(r.so_far / r.rank) FILTER (WHERE r.relevant)
                         / count(*) FILTER (WHERE r.relevant) ELSE 0.0 END AS ap,
               count(r.rank) AS n_ret, count(*) FILTER (WHERE r.relevant) AS n_hit,
               count(DISTINCT r.doc_id) FILTER (WHERE r.relevant) AS n_hit_art
        FROM benchmark b LEFT JOIN run r ON r.query_id = b.item_id GROUP BY b.item_id),
nrel AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
sc AS (SELECT per.*, coalesce(nrel.n_rel, 0) AS n_rel FROM per LEFT JOIN nrel USING (query_id)),
pr AS (SELECT query_id, rr, ap,
              CASE WHEN n_ret = 0 OR n_rel = 0 THEN 0.0 ELSE n_hit / n_ret END AS p,
              CASE WHEN n_ret = 0 OR n_rel = 0 THEN 0.0 ELSE n_hit_art / n_rel END AS r
       FROM sc)
SELECT query_id, round(rr, 9) AS reciprocal_rank, round(ap, 9) AS average_precision,
       round(p, 9) AS context_precision, round(r, 9) AS context_recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1_score
FROM pr""")
def q_search_eval(spark, sf):
    b = load(spark, sf, "benchmark")
    index = chunk_vectors(spark, sf)
    hits = search_hits(spark, sf, index=index)
    hits = R.with_chunks(hits, index.select("chunk_id", "doc_id"))
    # written once: every metric reads the flagged hits, two read the relevance
    rel = write_shared(R.passage_matches(load(spark, sf, "documents", spread=True), b)
                       .select(F.col("item_id").alias("query_id"), "doc_id"), "relevance")
    flagged = write_shared(
        hits.join(rel.withColumn("relevant", F.lit(True)), ["query_id", "doc_id"], "left")
        .withColumn("relevant", F.coalesce("relevant", F.lit(False))), "hits")
    qs = b.select(F.col("item_id").alias("query_id"))
    sizes = qs.join(rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")), "query_id", "left")
    out = ev.hit_scores(flagged, sizes, item="doc_id")
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in
                                    ["reciprocal_rank", "average_precision", "context_precision",
                                     "context_recall", "f1_score"]])
