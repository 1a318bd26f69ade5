"""Chunking plans over ``documents`` and the articles extracted from ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import chunk as C
from skein.operators.extract import extract_articles
from skein.plans import sqltext as S
from skein.plans.registry import load, register

SIZE, OVERLAP = C.DEFAULT_CHUNK_SIZE, C.DEFAULT_CHUNK_OVERLAP
STEP = SIZE - OVERLAP
EXTRACT_TIME = "2024-01-01 00:00:00"

_CHUNK_SQL = f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents
           WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT doc_id, text,
             unnest(CASE WHEN n <= {SIZE} THEN [0::BIGINT] ELSE range(0, n, {STEP}) END) AS st
      FROM d)
"""


@register("chunk_fixed", sql=_CHUNK_SQL + f"""
SELECT doc_id, st // {STEP} AS chunk_index, substr(text, st + 1, {SIZE}) AS chunk FROM s""")
def q_chunk_fixed(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    out = C.chunk_fixed(d.select("doc_id", "text"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@register("article_chunk_counts", sql=f"""
SELECT doc_id,
       (CASE WHEN coalesce(length(text), 0) = 0 THEN 0
             WHEN length(text) <= {SIZE} THEN 1
             ELSE ceil(length(text) / {STEP}) END)::BIGINT AS num_chunks,
       coalesce(length(text), 0)::BIGINT AS total_characters
FROM documents""")
def q_article_chunk_counts(spark, sf):
    d = load(spark, sf, "documents")
    return C.chunk_counts(d.select("doc_id", "text"))


_ARTICLES_SQL = """
WITH f AS (SELECT page_id, url, {title} AS title, {body} AS text FROM pages),
c AS (SELECT page_id, url, {ct} AS title, {cx} AS text FROM f WHERE {valid}),
a AS (SELECT page_id, url AS article_id, url, title, text FROM c
      WHERE {q} = 'Valid')
""".format(title=S.html_title("html"), body=S.article_body("html"),
           ct=S.text_clean("title"), cx=S.text_clean("text"), valid=S.url_validate("url"),
           q=S.article_quality("title", "text", "url"))


@register("article_chunks", sql=_ARTICLES_SQL + f"""
, s AS (SELECT page_id, article_id, url, title, text,
               unnest(CASE WHEN length(text) <= {SIZE} THEN [0::BIGINT]
                           ELSE range(0, length(text), {STEP}) END) AS st FROM a)
SELECT page_id, article_id, st // {STEP} AS chunk_index, substr(text, st + 1, {SIZE}) AS chunk,
       title, url FROM s""")
def q_article_chunks(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(EXTRACT_TIME))
    # page_id is carried so that a URL seen twice keeps distinct rows
    ch = C.chunk_fixed(arts.select("page_id", F.col("url").alias("article_id"), "title",
                                   "url", "text"))
    return ch.select("page_id", "article_id", F.col("chunk_index").cast("bigint"),
                     "chunk", "title", "url")


@register("tbl_article_catalog", sql=_ARTICLES_SQL + f"""
, counts AS (SELECT page_id, article_id, url, title,
                    (CASE WHEN length(text) <= {SIZE} THEN 1
                          ELSE ceil(length(text) / {STEP}) END)::BIGINT AS chunks FROM a)
SELECT article_id, arg_max(url, page_id) AS url, arg_max(title, page_id) AS title,
       arg_max(chunks, page_id) AS chunks, max(page_id) AS ingest_seq
FROM counts GROUP BY article_id""")
def q_tbl_article_catalog(spark, sf):
    from skein.sources.tables import catalog_upsert
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(EXTRACT_TIME))
    counts = C.chunk_counts(arts.select("page_id", "url", "title", "text"))
    entries = counts.select(F.col("url").alias("article_id"), "url", "title",
                            F.col("num_chunks").alias("chunks"),
                            F.col("page_id").alias("ingest_seq"))
    return catalog_upsert(None, entries, order_col="ingest_seq")


@register("chunk_recursive")
def q_chunk_recursive(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    return C.chunk_recursive(d, "doc_id", "text")

