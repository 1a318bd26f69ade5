"""Table readers and writers: URL lists, article files, the article
catalog, the vector table and the embedding cache.

All tables are Parquet (or JSON for article records) written by Spark's
job committer, so a failed or retried job never leaves a half-written
table; "append" writes new files next to the old ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from skein.functions.text import file_slug, py_strip

ARTICLE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("publish_date", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("top_image", T.StringType()),
    T.StructField("meta_description", T.StringType()),
    T.StructField("meta_keywords", T.ArrayType(T.StringType())),
    T.StructField("source_domain", T.StringType()),
    T.StructField("extraction_method", T.StringType()),
    T.StructField("extracted_at", T.TimestampType()),
])


# --- URL list ---------------------------------------------------------------

def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, stripped; blank and ``#`` lines dropped; order
    (``line_no``) and duplicates kept."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    url = py_strip("value")
    return (lines.select(F.col("_id").alias("line_no"), url.alias("url"))
            .filter((F.col("url") != "") & ~F.col("url").startswith("#")))


# --- article records --------------------------------------------------------

def write_articles(articles: DataFrame, path: str, fmt: str = "json",
                   mode: str = "append", partition_by: str | None = None) -> None:
    """Persist article records (one JSON object per line, or Parquet)."""
    w = articles.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    getattr(w, fmt)(path)


def read_articles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return spark.read.schema(ARTICLE_SCHEMA).json(path)
    return spark.read.parquet(path)


def article_file_index(articles: DataFrame) -> DataFrame:
    """filename, url, title, extracted_at, source_domain per saved article."""
    return articles.select(file_slug("title", "extracted_at").alias("filename"),
                           "url", "title", "extracted_at", "source_domain")


def read_file_index(spark: SparkSession, path: str) -> DataFrame:
    """The saved index, or an empty table when it is missing or unreadable."""
    schema = "filename string, url string, title string, extracted_at timestamp, source_domain string"
    try:
        # corrupt files are found when they are read: skip them there
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:   # a missing index reads as empty
        return spark.createDataFrame([], schema)


# --- article catalog (keyed, last write wins) --------------------------------

def catalog_upsert(old: DataFrame | None, new: DataFrame, key: str = "article_id",
                   order_col: str = "ingested_at") -> DataFrame:
    """Union old and new entries and keep, per key, the latest one.

    ``max_by`` over a struct is a plain grouped aggregate with map-side
    partial aggregation, so a key written many times is reduced in pieces
    rather than gathered into one task.
    """
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    others = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


# --- vector table -----------------------------------------------------------

def check_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Fail the job if a vector's length differs from ``dim``."""
    return vectors.filter(F.assert_true(F.size(vector) == dim,
                                        f"embedding dimension must be {dim}").isNull())


def append_vectors(vectors: DataFrame, path: str, dim: int,
                   vector: str = "embedding") -> None:
    """Append (vector, metadata) rows to ONE table, so vectors and metadata
    cannot drift apart; an empty input writes nothing."""
    check_vectors(vectors, dim, vector).write.mode("append").parquet(path)


VECTOR_SCHEMA = "vec_id long, embedding array<float>"


def read_vectors(spark: SparkSession, path: str, expected_count: int | None = None,
                 schema=VECTOR_SCHEMA):
    """(DataFrame, ok).  Missing/corrupt table -> (empty frame of ``schema``, False),
    count mismatch -> (empty frame of its own columns, False)."""
    try:
        df = spark.read.parquet(path)
        if expected_count is not None and df.count() != expected_count:
            return df.limit(0), False
        return df, True
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], schema), False


COMMIT_SCHEMA = "version string, vectors long, dimension int, saved_at timestamp"


def save_vectors(vectors: DataFrame, path: str, dim: int, vector: str = "embedding") -> dict:
    """Save the whole vector table under ``path``: a fresh version folder first, then a
    commit row that states its version, count and dimension.  A save that fails half-way
    leaves the table as it was; two saves at once leave the one whose row is newer."""
    spark = vectors.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/versions/{version}"
    check_vectors(vectors, dim, vector).write.parquet(folder)
    count = spark.read.parquet(folder).count()
    spark.range(1).select(F.lit(version).alias("version"), F.lit(count).cast("long").alias("vectors"),
                          F.lit(dim).alias("dimension"), F.current_timestamp().alias("saved_at")
                          ).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/commits")
    return {"version": version, "vectors": count, "dimension": dim}


def load_vectors(spark: SparkSession, path: str, schema=VECTOR_SCHEMA):
    """(DataFrame, ok) of the newest committed version; (empty frame, False) if nothing
    is committed or the files do not hold the committed number of vectors."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).json(f"{path.rstrip('/')}/commits")
        newest = commits.where("version is not null").agg(
            F.max_by(F.struct("version", "vectors"), F.struct("saved_at", "version")).alias("m")).first()["m"]
    except Exception:  # noqa: BLE001
        newest = None
    if newest is None:
        return spark.createDataFrame([], schema), False
    return read_vectors(spark, f"{path.rstrip('/')}/versions/{newest['version']}", newest["vectors"], schema)


def truncate(df: DataFrame, path: str) -> None:
    """Write an empty table with the same schema (the next snapshot)."""
    df.limit(0).write.mode("overwrite").parquet(path)


# --- embedding cache table --------------------------------------------------

CACHE_SCHEMA = ("model string, text_hash string, dimensions int, created_at timestamp, "
                "embedding array<float>")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The persisted cache, or an empty one when missing/unreadable."""
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], CACHE_SCHEMA)


def append_cache(new_rows: DataFrame | None, path: str) -> None:
    """Append only the newly computed (model, text_hash) rows."""
    if new_rows is not None:
        new_rows.write.mode("append").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Empty the cache table (the next reads see no rows)."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("overwrite").parquet(path)
