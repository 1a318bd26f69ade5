"""Ingestion reports and store statistics (one-row or per-input tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.chunk import chunk_counts
from skein.operators.extract import extract_articles


def ingest_report(pages: DataFrame, id_col: str = "page_id", **kw) -> DataFrame:
    """Per input page: success, chunks_created, embeddings_created, error.

    A page whose URL is invalid or whose article fails the quality gate
    reports ``Failed to extract article``; otherwise one embedding is made
    per chunk.
    """
    arts = extract_articles(pages, **kw)
    counts = chunk_counts(arts.select(id_col, "text")).select(id_col, "num_chunks")
    j = pages.select(id_col, "url").join(counts, id_col, "left")
    ok = F.col("num_chunks").isNotNull() & (F.col("num_chunks") > 0)
    return j.select(
        id_col, "url", ok.alias("success"),
        F.when(ok, F.col("num_chunks")).alias("chunks_created"),
        F.when(ok, F.col("num_chunks")).alias("embeddings_created"),
        F.when(F.col("num_chunks").isNull(), F.lit("Failed to extract article"))
         .when(~ok, F.lit("Failed to generate embeddings")).alias("error"))


def ingest_summary(report: DataFrame) -> DataFrame:
    """total, successful, failed."""
    return report.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("success")).alias("successful"),
                      F.count_if(~F.col("success")).alias("failed"))


def vector_stats(vectors: DataFrame, vector: str = "embedding", metadata: str | None = None,
                 index_type: str = "exact", params: dict | None = None) -> DataFrame:
    """total_vectors, dimension (the largest; ``min_dimension`` differs from it
    where lengths are mixed), metadata_count (rows whose ``metadata`` column is set;
    without such a column all rows carry their metadata) plus the index settings."""
    p = params or {}
    return vectors.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(F.size(vector)).alias("dimension"),
        F.min(F.size(vector)).alias("min_dimension"),
        F.count(F.col(metadata) if metadata else F.lit(1)).alias("metadata_count")).select(
        "*", F.lit(index_type).alias("index_type"),
        *[F.lit(v).alias(k) for k, v in p.items()])


def system_stats(catalog: DataFrame, vectors: DataFrame, key: str = "article_id",
                 cache: DataFrame | None = None, vector: str = "embedding", index_type: str = "exact",
                 params: dict | None = None) -> DataFrame:
    """total_articles (catalog keys) and total_chunks = total_embeddings
    (vector rows); a re-ingested article doubles vectors, not articles.
    One aggregate over the two tables stacked (no join between them).

    With ``cache`` (the row of ``cache_stats``) the two blocks follow: ``store_...``
    (vector_stats of ``vectors`` with the index settings) and ``cache_...``."""
    size = F.size(vector) if cache is not None else F.lit(None).cast("int")
    none = {"_k": "string", "_v": "int", "_d": "int"}
    if cache is not None:
        none |= {f"_cache_{f.name}": f.dataType.simpleString() for f in cache.schema}

    def rows(df: DataFrame, **own) -> DataFrame:
        return df.select(*[(own[c] if c in own else F.lit(None)).cast(t).alias(c) for c, t in none.items()])
    parts = rows(catalog, _k=F.col(key)).unionByName(rows(vectors, _v=F.lit(1), _d=size))
    if cache is not None:
        parts = parts.unionByName(rows(cache, **{f"_cache_{c}": F.col(c) for c in cache.columns}))
    counts = [F.count_distinct("_k").alias("total_articles"), F.count("_v").alias("total_chunks"),
              F.count("_v").alias("total_embeddings")]
    if cache is None:
        return parts.agg(*counts)
    out = parts.agg(*counts, F.count("_v").alias("store_total_vectors"), F.max("_d").alias("store_dimension"),
                    F.count("_d").alias("store_metadata_count"),
                    *[F.max(f"_cache_{c}").alias(f"cache_{c}") for c in cache.columns])
    return out.select("*", F.lit(index_type).alias("store_index_type"),
                      *[F.lit(v).alias(f"store_{k}") for k, v in (params or {}).items()])
