"""Report plans: ingestion results, extraction and store statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph_index as GI
from skein.operators import reports as RP
from skein.operators.embed import DEFAULT_DIM, cache_stats
from skein.operators.extract import extract_articles, extraction_stats
from skein.plans import sqltext as S
from skein.plans.chunks import _ARTICLES_SQL, SIZE, STEP
from skein.plans.registry import load, register
from skein.sources.tables import article_file_index

EXTRACT_TIME = "2024-01-01 00:00:00"

_REPORT_SQL = _ARTICLES_SQL + f""",
cnt AS (SELECT page_id, (CASE WHEN length(text) <= {SIZE} THEN 1
                              ELSE ceil(length(text) / {STEP}) END)::BIGINT AS n FROM a),
rep AS (SELECT p.page_id, p.url, coalesce(cnt.n > 0, false) AS success,
               CASE WHEN cnt.n > 0 THEN cnt.n END AS chunks_created,
               CASE WHEN cnt.n > 0 THEN cnt.n END AS embeddings_created,
               CASE WHEN cnt.n IS NULL THEN 'Failed to extract article'
                    WHEN cnt.n = 0 THEN 'Failed to generate embeddings' END AS error
        FROM pages p LEFT JOIN cnt USING (page_id))
"""


def _report(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return RP.ingest_report(p, extracted_at=F.lit(EXTRACT_TIME))


@register("ingest_report", sql=_REPORT_SQL + "SELECT * FROM rep")
def q_ingest_report(spark, sf):
    return _report(spark, sf)


@register("ingest_summary", sql=_REPORT_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful,
       count(*) FILTER (WHERE NOT success) AS failed FROM rep""")
def q_ingest_summary(spark, sf):
    return RP.ingest_summary(_report(spark, sf))


@register("extraction_stats", sql=_ARTICLES_SQL + """
SELECT (SELECT count(*) FROM a) AS total_extracted,
       (SELECT count(*) FROM pages) - (SELECT count(*) FROM a) AS total_failed,
       (SELECT count(*) FROM pages) AS total_attempts,
       coalesce((SELECT count(*) FROM a)::DOUBLE / nullif((SELECT count(*) FROM pages), 0), 0.0)
         AS success_rate""")
def q_extraction_stats(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return extraction_stats(p, extracted_at=F.lit(EXTRACT_TIME))


INDEX = {"degree": GI.DEGREE, "beam": GI.BEAM, "nprobe": GI.NPROBE, "cell_size": GI.CELL_SIZE}
_INDEX_SQL = ", ".join(f"{v} AS {{p}}{k}" for k, v in INDEX.items())


@register("vector_stats", sql=f"""
SELECT count(*) AS total_vectors, max(len(embedding))::INTEGER AS dimension,
       min(len(embedding))::INTEGER AS min_dimension,
       count(label) AS metadata_count, 'graph' AS index_type, {_INDEX_SQL.format(p='')} FROM embeddings""")
def q_vector_stats(spark, sf):
    return RP.vector_stats(load(spark, sf, "embeddings"), metadata="label", index_type="graph", params=INDEX)


@register("system_stats", sql=_ARTICLES_SQL + f""",
ch AS (SELECT article_id, substr(text, st + 1, {SIZE}) AS chunk FROM (
  SELECT article_id, text, unnest(CASE WHEN length(text) <= {SIZE} THEN [0::BIGINT]
                                       ELSE range(0, length(text), {STEP}) END) AS st FROM a)),
tot AS (SELECT count(*) AS n, count(DISTINCT article_id) AS articles, count(DISTINCT chunk) AS texts FROM ch)
SELECT articles AS total_articles, n AS total_chunks, n AS total_embeddings, n AS store_total_vectors,
       {DEFAULT_DIM} AS store_dimension, n AS store_metadata_count, n AS cache_total_requests,
       n - texts AS cache_hits, texts AS cache_misses, texts AS cache_cache_size,
       (n - texts)::DOUBLE / n AS cache_hit_rate, 'graph' AS store_index_type, {_INDEX_SQL.format(p='store_')}
FROM tot""")
def q_system_stats(spark, sf):
    """Totals of the article store with the vector store's and the cache's blocks, after
    one ingestion of all pages."""
    from skein.plans.conversation import article_index
    index = article_index(spark, sf)
    catalog = index.groupBy("article_id").agg(F.count(F.lit(1)).alias("chunks"))
    return RP.system_stats(catalog, index, cache=cache_stats(index, None, "chunk"), index_type="graph", params=INDEX)


@register("tbl_article_files", sql=_ARTICLES_SQL + """
SELECT {slug} AS filename, url, title, TIMESTAMP '{ts}' AS extracted_at,
       {dom} AS source_domain FROM a""".format(
    slug=S.file_slug("title", f"TIMESTAMP '{EXTRACT_TIME}'"), ts=EXTRACT_TIME,
    dom=S.url_domain("url")))
def q_tbl_article_files(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(EXTRACT_TIME).cast("timestamp"))
    return article_file_index(arts)


@register("src_pages", sql="""
SELECT page_id, url, length(html)::BIGINT AS html_chars FROM pages""")
def q_src_pages(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@register("similarity", sql="""
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) <= 5)
SELECT query_id, vec_id, round(1.0 / (1.0 + distance), 6) AS similarity FROM pairs""")
def q_similarity(spark, sf):
    from skein.functions.text import similarity
    from skein.operators.knn import knn_exact
    e = load(spark, sf, "embeddings")
    h = knn_exact(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k=5,
                  exclude_self=True)
    return h.select("query_id", "vec_id", F.round(similarity("distance"), 6).alias("similarity"))
