"""Memory of Python workers, which live on from stage to stage.

``small_batches`` bounds the rows that go to a worker at once: texts of a whole input
split in one batch would be held by the JVM and by the worker several times over.
``kept`` holds what a worker needs again in the next partition of the same work; other work
drops it.  ``trimmed`` gives back what a partition has left in the allocators' pools.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: rows of one Arrow batch, unless the session asks for fewer
ROWS = 500
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to ``ROWS`` if it is larger or unbounded."""
    now = int(spark.conf.get(_SETTING, "10000"))
    if now <= 0 or now > ROWS:
        spark.conf.set(_SETTING, str(ROWS))


#: by the work that uses it
_KEPT: dict[str, dict] = {}


def kept(work: str) -> dict:
    """A dict of this worker that lives on until other work than ``work`` begins here."""
    return _KEPT.setdefault(work, {})


def drop_others(work: str | None) -> None:
    """Empty what was kept for other work."""
    others = [held for name, held in _KEPT.items() if name != work and held]
    for held in others:
        held.clear()
    if others:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # other C libraries have no such call
        pass


def trimmed(fn: Callable, work: str | None = None) -> Callable:
    """``fn`` (for ``mapInArrow``), before which a worker drops what it kept for other work
    than ``work``, and after which freed memory goes back to the system."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(work)
        yield from fn(batches)
        give_back()
    return run
