"""Statistics that accumulate over calls: a store of one small row a batch.

Each batch of response times is summed up exactly (count, sum, least, largest) with a
mergeable quantile sketch, by groups if wanted, in one map-side combined aggregate.
Reading merges the rows: counts, means and extremes are exact over all batches, and
quantiles come from the merged sketches with a rank error of about 1.33 / k ** 0.9
(k = 400: 0.6 % of the rows).  ``latency_stats`` keeps the exact quantiles of one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 400
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def summaries(values: DataFrame, value: str = "response_time", batch: str = "batch_id",
              by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """One row for each batch (and group): ``count, total, min, max, sketch``.
    Null values are not counted."""
    v = F.col(value).cast("double")
    return (values.where(v.isNotNull()).groupBy(batch, *(by or []))
            .agg(F.count(v).alias("count"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"),
                 F.kll_sketch_agg_double(v, k).alias("sketch")))


def track(values: DataFrame, path: str, batch_id, value: str = "response_time",
          by: list[str] | None = None, k: int = SKETCH_K) -> None:
    """Add a batch to the store under ``path``.  A batch that is written again replaces
    itself, so a retried call counts once."""
    rows = summaries(values.withColumn("batch_id", F.lit(str(batch_id))), value, "batch_id", by, k)
    rows.drop("batch_id").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def merged(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., count, mean, median, min, max, p50, p90, p99`` over all batches; without
    groups one row, with ``count = 0`` and nulls if there is no batch."""
    out = rows.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.sum("total").alias("total"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    some = F.col("count") > 0
    q = {n: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for n, p in QUANTILES.items()}
    return out.select(*(by or []), "count", F.try_divide("total", "count").alias("mean"), q["p50"].alias("median"),
                      "min", "max", *[c.alias(n) for n, c in q.items()])


def tracked_stats(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """``merged`` over the store under ``path``."""
    return merged(spark.read.option("basePath", path).parquet(path), by)
