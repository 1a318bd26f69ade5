"""Whole evaluation records: each ``benchmark`` passage is a question, its
answer the best chunk found, its context the chunks found, its relevant
documents those that contain it, and its response time the ``value`` of the
event with its number.  Passages without a relevant document or an event lack
those inputs, as records may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as TX
from skein.operators import evaluate as ev
from skein.operators import retrieval as R
from skein.plans import sqltext as S
from skein.plans.embedding import _SEARCH_SQL, chunk_vectors, search_hits
from skein.plans.evaluation import _CTX_JOIN
from skein.plans.registry import load, register
from skein.session import write_shared

SCORES = ["response_time", *ev.EVAL_METRICS]


def records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, retrieved, relevant)``; contexts are bounded by k chunks."""
    b = load(spark, sf, "benchmark")
    index = chunk_vectors(spark, sf)
    hits = write_shared(R.with_chunks(search_hits(spark, sf, index=index),
                                      index.select("chunk_id", "doc_id", "chunk")), "hits")
    relevant = R.passage_matches(load(spark, sf, "documents", spread=True), b).select(
        F.col("item_id").alias("query_id"), F.col("doc_id").alias("article_id"))
    found = hits.groupBy("query_id").agg(
        F.min_by("chunk", "rank").alias("answer"),
        F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("_c"))
    times = load(spark, sf, "events").select(F.col("event_id").alias("query_id"),
                                             F.col("value").alias("response_time"))
    rows = (b.select(F.col("item_id").alias("query_id"), F.col("text").alias("expected_answer"))
            .join(found, "query_id", "left").join(times, "query_id", "left"))
    rows = rows.withColumn("context", F.transform("_c", lambda c: c["chunk"])).drop("_c")
    retrieved = hits.select("query_id", F.col("doc_id").alias("article_id"))
    return rows, retrieved, write_shared(relevant, "relevance")


_SCORES_SQL = _SEARCH_SQL + """
, rl AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b
         JOIN documents d ON contains(d.text, b.text)),
top AS (SELECT h.query_id, arg_min(ch.chunk, h.rank) AS answer, list(ch.chunk ORDER BY h.rank) AS context
        FROM hits h JOIN ch USING (chunk_id) GROUP BY h.query_id),
rp AS (SELECT b.item_id AS query_id, b.text AS question, top.answer, top.context, e.value AS response_time
       FROM benchmark b LEFT JOIN top ON top.query_id = b.item_id
       LEFT JOIN events e ON e.event_id = b.item_id),
{h1},
{h2},
nr AS (SELECT query_id, count(*) AS n_rel FROM rl GROUP BY query_id),
pr AS (SELECT nr.query_id,
              CASE WHEN count(h.rank) = 0 THEN 0.0
                   ELSE count(*) FILTER (WHERE rl.doc_id IS NOT NULL) / count(h.rank) END AS p,
              CASE WHEN count(h.rank) = 0 THEN 0.0
                   ELSE count(DISTINCT rl.doc_id) / any_value(nr.n_rel) END AS r
       FROM nr LEFT JOIN hits h ON h.query_id = nr.query_id LEFT JOIN ch ON ch.chunk_id = h.chunk_id
       LEFT JOIN rl ON rl.query_id = nr.query_id AND rl.doc_id = ch.doc_id
       GROUP BY nr.query_id),
per_q AS (SELECT rp.query_id, rp.response_time, rel.answer_relevancy, pr.p AS context_precision,
                 pr.r AS context_recall,
                 CASE WHEN pr.p + pr.r = 0 THEN 0.0 ELSE 2 * pr.p * pr.r / (pr.p + pr.r) END AS f1_score,
                 fai.faithfulness
          FROM rp LEFT JOIN rel USING (query_id) LEFT JOIN fai USING (query_id)
          LEFT JOIN pr USING (query_id))
""".format(
    h1=S.hybrid_sql("(SELECT * FROM rp WHERE answer IS NOT NULL)", ["query_id"],
                    S.rewrite("answer", TX.RELEVANCY_REWRITES), S.rewrite("question", TX.RELEVANCY_REWRITES),
                    f"({S.blank('answer')} OR {S.blank('question')})", 0.2, 0.8,
                    "answer_relevancy", "rel"),
    h2=S.hybrid_sql("(SELECT * FROM rp WHERE answer IS NOT NULL AND context IS NOT NULL)", ["query_id"],
                    S.rewrite("answer", TX.FAITHFULNESS_REWRITES), f"coalesce({_CTX_JOIN}, '')",
                    f"(context IS NULL OR len(context) = 0 OR {S.blank('answer')})", 0.1, 0.9,
                    "faithfulness", "fai"))


@register("evaluate_records", sql=_SCORES_SQL + "SELECT query_id, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in SCORES) + " FROM per_q")
def q_evaluate_records(spark, sf):
    rows, retrieved, relevant = records(spark, sf)
    out = ev.evaluate_queries(rows, retrieved=retrieved, relevant=relevant)
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in SCORES])


@register("aggregate_records", sql=_SCORES_SQL + """
SELECT count(*) AS total_queries, {means}, count(response_time) AS response_time_count,
       round(avg(response_time), 9) AS response_time_mean,
       round(quantile_cont(response_time, 0.5), 9) AS response_time_median,
       round(min(response_time), 9) AS response_time_min, round(max(response_time), 9) AS response_time_max,
       round(quantile_cont(response_time, 0.5), 9) AS response_time_p50,
       round(quantile_cont(response_time, 0.9), 9) AS response_time_p90,
       round(quantile_cont(response_time, 0.99), 9) AS response_time_p99
FROM per_q""".format(means=", ".join(f"round(avg({m}), 9) AS mean_{m}" for m in ev.EVAL_METRICS)))
def q_aggregate_records(spark, sf):
    rows, retrieved, relevant = records(spark, sf)
    # the means and the latency block both read the scores
    per_q = write_shared(ev.evaluate_queries(rows, retrieved=retrieved, relevant=relevant), "scores")
    out = ev.aggregate_eval(per_q)
    return out.select(*[F.col(c) if c in ("total_queries", "response_time_count")
                        else F.round(c, 9).alias(c) for c in out.columns])
