"""Partitioning helpers.

``spread`` deals rows to ``partitions`` tasks where a caller asks for it, for
CPU-heavy row-wise stages (regex cleaning, HTML parsing, embedding) over a
table stored as a few large row groups.  Without a number it does nothing: on
a large table the scan's own splits are enough and no shuffle is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    return df if partitions is None else df.repartition(partitions)
