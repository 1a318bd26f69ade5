"""skein — Spark-native article retrieval and RAG evaluation.

Every operation is a ``DataFrame -> DataFrame`` transformation on the public
PySpark API.  Sub-packages:

* ``skein.functions``  Column -> Column expressions (text, URL, HTML, hashing).
* ``skein.operators``  table operators (chunking, embedding, kNN, RAG, metrics).
* ``skein.sources``    readers/writers (pages, URL lists, articles, vector
                       tables, embedding cache, snapshots, sessions).
* ``skein.plans``      the registered queries over the test tables and their
                       DuckDB oracle SQL.
* ``skein.streaming``  incremental forms on Structured Streaming.
"""

from skein.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
