"""Named snapshots of the store: vectors + article catalog + metadata.

Layout (any Hadoop-compatible path)::

    <root>/<name>/<version>/vectors/   Parquet (vector and metadata in one row)
    <root>/<name>/<version>/catalog/   Parquet (article_id, url, title, chunks, ...)
    <root>/<name>/metadata/            JSON, one row a save: name, description, created_at,
                                       total_articles, total_chunks, version

Every save writes a fresh version folder and appends its metadata last: the
newest metadata row is the commit marker.  A save that fails leaves the earlier
snapshot as it was.  A snapshot without metadata, or whose vector count differs
from ``total_chunks``, does not load.  Earlier versions stay until
``drop_old_versions`` removes them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = ("name string, description string, created_at timestamp, "
               "total_articles long, total_chunks long, version string")


def _p(root: str, name: str, part: str) -> str:
    return f"{root.rstrip('/')}/{name}/{part}"


def save_snapshot(spark: SparkSession, root: str, name: str, vectors: DataFrame,
                  catalog: DataFrame, description: str = "", overwrite: bool = True,
                  key: str = "article_id") -> dict:
    """Write a snapshot; with ``overwrite=False`` an existing one is kept and
    a failure is reported."""
    if not overwrite:
        try:
            spark.read.schema(META_SCHEMA).json(_p(root, name, "metadata")).limit(1).collect()
            return {"success": False, "state_name": name,
                    "error": "State already exists. Use overwrite=True to replace."}
        except AnalysisException:
            pass
    from skein.operators.reports import system_stats
    version = uuid.uuid4().hex
    parts = {part: _p(root, name, f"{version}/{part}") for part in ("vectors", "catalog")}
    vectors.write.parquet(parts["vectors"])
    catalog.write.parquet(parts["catalog"])
    stats = system_stats(spark.read.parquet(parts["catalog"]), spark.read.parquet(parts["vectors"]), key)
    meta = stats.select(F.lit(name).alias("name"), F.lit(description).alias("description"),
                        F.current_timestamp().alias("created_at"),
                        "total_articles", "total_chunks", F.lit(version).alias("version"))
    meta.coalesce(1).write.mode("append").json(_p(root, name, "metadata"))
    return {"success": True, "state_name": name, "path": f"{root.rstrip('/')}/{name}"}


def _newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest metadata row of each snapshot under ``path``."""
    meta = spark.read.schema(META_SCHEMA).json(path).filter(
        F.col("name").isNotNull() & F.col("version").isNotNull())
    row = F.struct(*meta.columns)
    return meta.groupBy(F.col("name").alias("_n")).agg(F.max_by(row, "created_at").alias("m")).select("m.*")


def drop_old_versions(spark: SparkSession, root: str, name: str) -> int:
    """Delete the data of all but the newest version; their number.  For use
    when nothing reads them any more."""
    path = _p(root, name, "metadata")
    kept = _newest(spark, path).first()["version"]
    meta = spark.read.schema(META_SCHEMA).json(path)
    gone = 0
    for row in meta.select("version").where(F.col("version") != kept).distinct().toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(_p(root, name, row["version"]))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        gone += bool(files.delete(folder, True))
    return gone


def load_snapshot(spark: SparkSession, root: str, name: str) -> dict:
    """``{success, vectors, catalog, metadata}``; missing or inconsistent
    snapshots give ``success=False`` and an error message."""
    try:
        meta = _newest(spark, _p(root, name, "metadata")).first()
        if meta is None:
            raise AnalysisException("empty metadata")
        vectors = spark.read.parquet(_p(root, name, meta["version"] + "/vectors"))
        catalog = spark.read.parquet(_p(root, name, meta["version"] + "/catalog"))
        if vectors.count() != meta["total_chunks"]:
            return {"success": False, "state_name": name,
                    "error": "vector count does not match the snapshot metadata"}
        return {"success": True, "state_name": name, "vectors": vectors,
                "catalog": catalog, "metadata": meta.asDict()}
    except Exception as e:  # noqa: BLE001 - any unreadable part fails the load
        return {"success": False, "state_name": name, "error": f"State not found or unreadable: {e}"[:300]}


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Every readable snapshot's metadata plus ``size_bytes`` (sum of its
    data files), newest first."""
    try:
        meta = _newest(spark, f"{root.rstrip('/')}/*/metadata")
    except AnalysisException:
        return spark.createDataFrame([], META_SCHEMA + ", size_bytes long")
    files = None
    for part in ("vectors", "catalog"):
        try:    # listed as files, so that one unreadable file does not matter
            f = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
                 .load(f"{root.rstrip('/')}/*/*/{part}")
                 .select("path", F.col("length").alias("size")))
            files = f if files is None else files.unionByName(f)
        except AnalysisException:
            continue
    if files is None:
        return meta.withColumn("size_bytes", F.lit(0).cast("long")).orderBy(F.desc("created_at"))
    place = r"/([^/]+)/([^/]+)/(vectors|catalog)/[^/]+$"
    sizes = files.groupBy(F.regexp_extract("path", place, 1).alias("name"),
                          F.regexp_extract("path", place, 2).alias("version")) \
        .agg(F.sum("size").alias("size_bytes"))
    return (meta.join(sizes, ["name", "version"], "left")
            .select(*meta.columns, F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"))
            .orderBy(F.desc("created_at")))
