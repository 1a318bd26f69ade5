"""Registry of the named queries over the test tables.

Each plan is a function ``(spark, sf_dir) -> DataFrame`` that reads the given
Parquet tables in full.  Plans with a relational equivalent also register a
DuckDB SQL string over the same tables (views named after the tables); the
two are compared on row count, schema and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_path

PlanFn = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, PlanFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a plan and (optionally) its oracle SQL."""
    def wrap(fn: PlanFn) -> PlanFn:
        if name in _PLANS:
            raise ValueError(f"duplicate plan {name}")
        _PLANS[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return wrap


def load(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """Read one test table; ``spread=True`` for CPU-heavy row-wise plans, whose
    rows are dealt to ``spark.skein.inputPartitions`` tasks if that setting is given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    if spread:
        from skein.operators.partitioning import spread as _spread
        n = spark.conf.get("spark.skein.inputPartitions", None)
        df = _spread(df, int(n) if n else None)
    return df


def pair_key(owner, position) -> Column:
    """``owner:position`` as one string id, unique for any number of positions."""
    return F.concat(F.col(owner).cast("string"), F.lit(":"),
                    (F.col(position) if isinstance(position, str) else position).cast("string"))


_STORED: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: PlanFn) -> DataFrame:
    """``build(spark, sf_dir)`` written once as Parquet in the shared folder.

    Later queries of the session read the stored table, pruned to their
    columns, as long as the files of ``tables`` (names, lengths, times of
    change) are the same; otherwise it is built anew.
    """
    root = sf_dir.rstrip("/")
    files = spark.read.format("binaryFile").load([f"{root}/{t}.parquet" for t in tables])
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"),
                      F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    key = (spark.sparkContext.applicationId, name, root, tuple(state))
    if key not in _STORED:
        path = shared_path(spark, name)
        made = build(spark, root)
        made.write.parquet(path)
        _STORED[key] = (path, made.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def plans() -> dict[str, PlanFn]:
    _import_all()
    return dict(_PLANS)


def oracle() -> dict[str, str]:
    _import_all()
    return dict(_SQL)


def _import_all() -> None:
    # importing the modules runs their @register decorators
    from skein.plans import (retrieval, text, chunks, evaluation,  # noqa: F401
                             embedding, conversation, reports, search_evaluation)
