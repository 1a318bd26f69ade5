"""Semantic search, context retrieval and passage relevance.

Search = embed the question table -> exact (or approximate) kNN against the
chunk-vector table -> attach chunk metadata by an equi-join on the chunk id.
Questions that are blank produce no hits, as an empty query returns nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import py_strip, words
from skein.operators.embed import BatchFn, embed_texts
from skein.operators.knn import knn_exact

SHORT_GRAM = 3                  # characters per anchor of a passage under three words
METADATA_DEFAULTS = {"title": "Unknown", "url": "", "publish_date": "Unknown"}


def search(questions: DataFrame, chunk_vectors: DataFrame, k: int = 5, *,
           question_id: str = "query_id", question: str = "text",
           chunk_id: str = "chunk_id", vector: str = "embedding",
           fn: BatchFn | None = None, tie_digits: int | None = 9,
           **knn_kw) -> DataFrame:
    """``query_id, rank, chunk_id, distance, similarity`` for every question."""
    q = questions.filter(~(F.col(question).isNull() | (py_strip(F.col(question)) == "")))
    qv = embed_texts(q.select(F.col(question_id).alias("query_id"),
                              F.col(question).alias("_q")), "_q", fn, "qv")
    hits = knn_exact(qv, chunk_vectors.select(F.col(chunk_id).alias("vec_id"), vector),
                     k=k, query_vector="qv", vector=vector, tie_digits=tie_digits, **knn_kw)
    return hits.select("query_id", "rank", F.col("vec_id").alias(chunk_id), "distance",
                       (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("similarity"))


def with_chunks(hits: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Hits with the columns of their chunks.  Chunks that no hit names are
    dropped first (semi-join on the ids alone), so the texts of the whole
    corpus are never dealt out: only those of hits take part in the join.
    ``hits`` is read twice: store it first."""
    used = chunks.join(hits.select(chunk_id).distinct(), chunk_id, "left_semi")
    return hits.join(used, chunk_id)


def _meta(col: str, chunks: DataFrame) -> F.Column:
    if col in chunks.columns:
        c = F.col(col)
        if col in METADATA_DEFAULTS:
            c = F.coalesce(c.cast("string"), F.lit(METADATA_DEFAULTS[col]))
        return c
    if col == "authors":
        return F.array().cast("array<string>")
    return F.lit(METADATA_DEFAULTS.get(col, ""))


def semantic_search(hits: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Hits with ``chunk`` and a ``metadata`` struct (title, url, authors,
    publish_date), defaults 'Unknown' / '' / [] / 'Unknown'."""
    j = with_chunks(hits, chunks, chunk_id)
    meta = F.struct(_meta("title", chunks).alias("title"), _meta("url", chunks).alias("url"),
                    _meta("authors", chunks).alias("authors"),
                    _meta("publish_date", chunks).alias("publish_date"))
    return j.select("query_id", "rank", chunk_id, F.coalesce("chunk", F.lit("")).alias("chunk"),
                    meta.alias("metadata"), "distance", "similarity")


def semantic_search_flat(hits: DataFrame, chunks: DataFrame,
                         chunk_id: str = "chunk_id") -> DataFrame:
    """Same hits, flat columns: distance, similarity, chunk, title, url,
    authors, publish_date."""
    j = with_chunks(hits, chunks, chunk_id)
    return j.select("query_id", "rank", chunk_id, "distance", "similarity",
                    F.coalesce("chunk", F.lit("")).alias("chunk"),
                    _meta("title", chunks).alias("title"), _meta("url", chunks).alias("url"),
                    _meta("authors", chunks).alias("authors"),
                    _meta("publish_date", chunks).alias("publish_date"))


def retrieve_context(hits: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Context rows: chunk, title, url, article_id, distance (rank order)."""
    j = with_chunks(hits, chunks, chunk_id)
    return j.select("query_id", "rank", chunk_id, F.coalesce("chunk", F.lit("")).alias("chunk"),
                    _meta("title", chunks).alias("title"), _meta("url", chunks).alias("url"),
                    F.coalesce(F.col("article_id").cast("string"), F.lit("")).alias("article_id"),
                    "distance")


# ---------------------------------------------------------------------------
# passage relevance: which documents contain a passage (no cross join)
# ---------------------------------------------------------------------------

def passage_matches(docs: DataFrame, passages: DataFrame, *, doc_id: str = "doc_id",
                    doc_text: str = "text", passage_id: str = "item_id",
                    passage_text: str = "text") -> DataFrame:
    """``(passage_id, doc_id)`` for every document whose text contains the
    passage, without comparing every document with every passage.

    An interior word of a passage (not its first or last, which may be glued
    to neighbouring text) is a whole whitespace token of any document that
    contains the passage.  So each passage is anchored on its *rarest*
    interior word (document frequencies come from a partially aggregated
    word count), candidates are the documents holding that word (an
    equi-join, i.e. an inverted-index lookup), and ``contains`` confirms
    them.  Passages of fewer than three words have no interior word; they
    are anchored on their rarest run of three characters (or on their whole
    text if shorter) in the same way.  Empty passages match nothing.
    """
    p = passages.select(F.col(passage_id).alias("_pid"), F.col(passage_text).alias("_pt"))
    d = docs.select(F.col(doc_id).alias("_did"), F.col(doc_text).alias("_dt"))
    pw = words(F.col("_pt"))
    interior = p.select("_pid", "_pt", F.explode(F.array_distinct(
        F.slice(pw, 2, F.greatest(F.size(pw) - 2, F.lit(0))))).alias("_w"))
    doc_words = d.select("_did", F.explode(F.array_distinct(words(F.col("_dt")))).alias("_w"))
    out = _confirmed(interior, doc_words, d)
    short = p.filter((F.size(pw) < 3) & (F.length("_pt") > 0))
    if not short.isEmpty():
        size = F.least(F.length("_pt"), F.lit(SHORT_GRAM))
        anchors = short.select("_pid", "_pt", F.explode(_grams(F.col("_pt"), size)).alias("_w"))
        sizes = F.explode(F.sequence(F.lit(1), F.lit(SHORT_GRAM)))
        doc_grams = (d.select("_did", "_dt", sizes.alias("_n"))
                     .select("_did", F.explode(_grams(F.col("_dt"), F.col("_n"))).alias("_w")))
        out = out.unionByName(_confirmed(anchors, doc_grams, d))
    return out.select(F.col("_pid").alias(passage_id), F.col("_did").alias(doc_id))


def _grams(text, size) -> F.Column:
    """Distinct runs of ``size`` characters (none if the text is shorter)."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_distinct(F.transform(
        chars, lambda _, i: F.array_join(F.slice(chars, i + 1, size), "")))


def _confirmed(anchors: DataFrame, doc_keys: DataFrame, d: DataFrame) -> DataFrame:
    """``_pid, _did``: candidates share the passage's rarest key, ``contains``
    decides.  ``anchors``: _pid, _pt, _w; ``doc_keys``: _did, _w."""
    # only keys that occur inside some passage can be anchors: keep those
    # document keys (semi-join) before counting and joining
    doc_keys = doc_keys.join(anchors.select("_w").distinct(), "_w", "left_semi")
    df = doc_keys.groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (anchors.join(df, "_w")
              .groupBy("_pid", "_pt").agg(F.min_by("_w", F.struct("_df", "_w")).alias("_w")))
    cand = rarest.join(doc_keys, "_w").select("_pid", "_pt", "_did")
    return (cand.join(d, "_did").filter(F.col("_dt").contains(F.col("_pt")))
            .select("_pid", "_did"))
