"""Retrieval plans over ``embeddings`` (64-d unit vectors with a label).

Every vector is a query against all the others (itself excluded); a hit is
relevant when it has the query's label.  This is the flagship slice: scan,
blocked similarity kernel, per-query top-k, running windows, aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import evaluate as ev
from skein.operators.graph_index import CELL_SIZE, graph_index, knn_bounded, search_graph
from skein.operators.knn import knn_approx, knn_exact, with_similarity
from skein.plans.registry import load, register, stored
from skein.session import write_shared

K = 5
N_CELLS = 16
SMALL_CELLS = 64            # vectors a cell where bounds are to prune

# DuckDB brute force: every ordered pair, ranked per query.
_HITS_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         q.label AS q_label, v.label AS v_label,
         pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM pairs QUALIFY rank <= 5
), n_rel AS (
  SELECT label, count(*) - 1 AS n_relevant FROM embeddings GROUP BY label
)
"""


def _queries(emb: DataFrame) -> DataFrame:
    return emb.select(F.col("vec_id").alias("query_id"), "embedding")


def embedding_hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Top-k hits for every vector with the query's and the hit's labels."""
    emb = load(spark, sf_dir, "embeddings")
    hits = knn_exact(_queries(emb), emb, k=k, exclude_self=True)
    labels = emb.select("vec_id", "label")
    return (hits
            .join(labels.withColumnRenamed("vec_id", "query_id")
                  .withColumnRenamed("label", "q_label"), "query_id")
            .join(labels.withColumnRenamed("label", "v_label"), "vec_id")
            .withColumn("relevant", F.col("q_label") == F.col("v_label")))


def _n_relevant(emb: DataFrame) -> DataFrame:
    per_label = emb.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return (emb.select(F.col("vec_id").alias("query_id"), "label")
            .join(per_label, "label").select("query_id", "n_relevant"))


@register("knn_exact", sql=_HITS_SQL + """
SELECT query_id, vec_id, rank, round(distance, 6) AS distance,
       round(1.0 / (1.0 + distance), 6) AS similarity
FROM hits""")
def q_knn_exact(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    hits = with_similarity(knn_exact(_queries(emb), emb, k=K, exclude_self=True))
    return hits.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"),
                       F.round("distance", 6).alias("distance"),
                       F.round("similarity", 6).alias("similarity"))


@register("hit_metadata", sql=_HITS_SQL + """
SELECT query_id, rank, vec_id, v_label AS label FROM hits""")
def q_hit_metadata(spark, sf_dir):
    h = embedding_hits(spark, sf_dir)
    return h.select("query_id", F.col("rank").cast("bigint").alias("rank"),
                    "vec_id", F.col("v_label").alias("label"))


@register("mrr", sql=_HITS_SQL + """
, rr AS (
  SELECT e.vec_id AS query_id,
         coalesce(1.0 / min(h.rank) FILTER (WHERE h.q_label = h.v_label), 0.0) AS r
  FROM embeddings e LEFT JOIN hits h ON h.query_id = e.vec_id GROUP BY e.vec_id)
SELECT round(coalesce(avg(r), 0.0), 9) AS mrr FROM rr""")
def q_mrr(spark, sf_dir):
    h = embedding_hits(spark, sf_dir)
    emb = load(spark, sf_dir, "embeddings")
    out = ev.mrr(h, _queries(emb).select("query_id"))
    return out.select(F.round("mrr", 9).alias("mrr"))


@register("map", sql=_HITS_SQL + """
, run AS (
  SELECT *, sum(CASE WHEN q_label = v_label THEN 1 ELSE 0 END)
            OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far
  FROM hits),
ap AS (
  SELECT e.vec_id AS query_id,
         CASE WHEN count(*) FILTER (WHERE r.q_label = r.v_label) > 0
              THEN sum(r.so_far / r.rank) FILTER (WHERE r.q_label = r.v_label)
                   / count(*) FILTER (WHERE r.q_label = r.v_label)
              ELSE 0.0 END AS a
  FROM embeddings e LEFT JOIN run r ON r.query_id = e.vec_id GROUP BY e.vec_id)
SELECT round(coalesce(avg(a), 0.0), 9) AS map FROM ap""")
def q_map(spark, sf_dir):
    h = embedding_hits(spark, sf_dir)
    emb = load(spark, sf_dir, "embeddings")
    out = ev.mean_average_precision(h, _queries(emb).select("query_id"))
    return out.select(F.round("map", 9).alias("map"))


_CTX_SQL = _HITS_SQL + """
, per_q AS (
  SELECT e.vec_id AS query_id, n.n_relevant,
         count(h.vec_id) AS n_ret,
         count(h.vec_id) FILTER (WHERE h.q_label = h.v_label) AS n_hit
  FROM embeddings e JOIN n_rel n ON n.label = e.label
  LEFT JOIN hits h ON h.query_id = e.vec_id
  GROUP BY e.vec_id, n.n_relevant),
scores AS (
  SELECT query_id,
         CASE WHEN n_ret = 0 OR n_relevant = 0 THEN 0.0 ELSE n_hit / n_ret END AS p,
         CASE WHEN n_ret = 0 OR n_relevant = 0 THEN 0.0 ELSE n_hit / n_relevant END AS r
  FROM per_q)
"""


def _ctx_scores(spark, sf_dir) -> DataFrame:
    h = embedding_hits(spark, sf_dir)
    emb = load(spark, sf_dir, "embeddings")
    return ev.context_scores_flagged(h, _n_relevant(emb))


@register("context_precision", sql=_CTX_SQL + """
SELECT query_id, round(p, 9) AS context_precision FROM scores""")
def q_context_precision(spark, sf_dir):
    s = _ctx_scores(spark, sf_dir)
    return s.select("query_id", F.round("context_precision", 9).alias("context_precision"))


@register("context_recall", sql=_CTX_SQL + """
SELECT query_id, round(r, 9) AS context_recall FROM scores""")
def q_context_recall(spark, sf_dir):
    s = _ctx_scores(spark, sf_dir)
    return s.select("query_id", F.round("context_recall", 9).alias("context_recall"))


@register("context_f1", sql=_CTX_SQL + """
SELECT query_id,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1_score
FROM scores""")
def q_context_f1(spark, sf_dir):
    s = _ctx_scores(spark, sf_dir)
    return s.select("query_id", F.round("f1_score", 9).alias("f1_score"))


def ir_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per-query RR, AP, precision, recall and F1 of exact top-5."""
    # written once: the aggregates below read the stored hits
    h = write_shared(embedding_hits(spark, sf_dir), "hits")
    out = ev.hit_scores(h, _n_relevant(load(spark, sf_dir, "embeddings")))
    return out.select("query_id",
                      *[F.round(c, 9).alias(c) for c in
                        ["reciprocal_rank", "average_precision", "context_precision",
                         "context_recall", "f1_score"]])


register("ir_eval", sql=_CTX_SQL + """
, run AS (
  SELECT *, sum(CASE WHEN q_label = v_label THEN 1 ELSE 0 END)
            OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far
  FROM hits),
rr_ap AS (
  SELECT e.vec_id AS query_id,
         coalesce(1.0 / min(r.rank) FILTER (WHERE r.q_label = r.v_label), 0.0) AS rr,
         CASE WHEN count(*) FILTER (WHERE r.q_label = r.v_label) > 0
              THEN sum(r.so_far / r.rank) FILTER (WHERE r.q_label = r.v_label)
                   / count(*) FILTER (WHERE r.q_label = r.v_label)
              ELSE 0.0 END AS ap
  FROM embeddings e LEFT JOIN run r ON r.query_id = e.vec_id GROUP BY e.vec_id)
SELECT s.query_id, round(rr, 9) AS reciprocal_rank, round(ap, 9) AS average_precision,
       round(p, 9) AS context_precision, round(r, 9) AS context_recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1_score
FROM scores s JOIN rr_ap USING (query_id)""")(ir_eval)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"),
                       F.round("distance", 6).alias("distance"))


def embedding_graph(spark: SparkSession, sf_dir: str, cell_size: int = CELL_SIZE) -> DataFrame:
    """The stored neighbour graphs of ``embeddings``."""
    return stored(spark, sf_dir, f"embedding-graph-{cell_size}", ["embeddings"],
                  lambda s, d: graph_index(load(s, d, "embeddings"), cell_size=cell_size))


@register("knn_approx")
def q_knn_approx(spark, sf_dir):
    """Graph search for every vector over the stored index; rows-only check, a recall
    of at least 0.95 against knn_exact is asserted in the tests."""
    hits = search_graph(_queries(load(spark, sf_dir, "embeddings")), embedding_graph(spark, sf_dir), K,
                        exclude_self=True)
    return _rounded(hits)


@register("knn_bounded", sql=_HITS_SQL + """
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM hits""")
def q_knn_bounded(spark, sf_dir):
    """Exact search past cells and members that the triangle inequality rules out."""
    hits, _ = knn_bounded(_queries(load(spark, sf_dir, "embeddings")), embedding_graph(spark, sf_dir, SMALL_CELLS), K,
                          exclude_self=True)
    return _rounded(hits)


@register("knn_approx_all_cells", sql=_HITS_SQL + """
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM hits""")
def q_knn_approx_all_cells(spark, sf_dir):
    """An IVF index with every cell probed: equal to brute force."""
    emb = load(spark, sf_dir, "embeddings")
    return _rounded(knn_approx(_queries(emb), emb, k=K, n_cells=N_CELLS, nprobe=N_CELLS, exclude_self=True))
