"""Recursive chunks on whole documents: order, size and cover."""

from pyspark.sql import functions as F

from skein.operators import chunk as C
from skein.session import ship_package


def _check(text, chunks, size, overlap):
    at, covered = 0, 0
    for c in chunks:
        assert c and len(c) <= size
        # chunks stand in the text in order; two neighbours share at most the
        # overlap, and only white space may lie between them
        at = text.find(c, max(at, covered - overlap - 1))
        assert at >= 0, c[:40]
        assert at <= covered or text[covered:at].strip() == ""
        covered = max(covered, at + len(c))
        at += 1
    assert text[covered:].strip() == ""


def test_documents_are_covered_in_order(spark):
    ship_package(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size, overlap = C.DEFAULT_CHUNK_SIZE, C.DEFAULT_CHUNK_OVERLAP
    got = C.chunk_recursive(docs).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("c"))
    rows = docs.join(got, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        chunks = r["c"] or []
        assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
        _check(r["text"] or "", [c["chunk"] for c in chunks], size, overlap)


def test_spans_of_awkward_texts():
    """By offsets, since a chunk of a repetitive text stands in many places."""
    size, overlap = 200, 50
    for text in ("", " ", "\n\n", "a" * 5000, "word " * 2000, "one.\n\n" * 900, "é" * 1001 + " x"):
        covered = 0
        for start, end, _ in C.recursive_spans(text, size, overlap, C.RECURSIVE_SEPARATORS):
            assert end - start <= size and covered - overlap <= start <= covered < end
            covered = end
        assert covered == len(text)
        assert all(c for c in C.split_recursive(text, size, overlap))
