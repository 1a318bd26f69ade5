"""Answer-evaluation plans over ``conversations`` and latency over ``events``.

Question/answer pairs are a user row and the assistant row of the next turn,
found by an equi-join on (conversation, turn + 1) rather than a window over
the conversation, so one very long conversation does not become one task.
The context of an answer is the two messages before it (bounded fan-out:
each message is sent to the next two turns, then gathered per turn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as TX
from skein.operators import evaluate as ev
from skein.operators import trackers
from skein.plans import sqltext as S
from skein.plans.registry import load, pair_key, register
from skein.session import write_shared

CONTEXT_TURNS = 2
KEYS = ["conv_id", "turn"]


def qa_pairs(conv: DataFrame) -> DataFrame:
    """conv_id, turn (of the answer), question, answer."""
    users = conv.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer"))
    return users.join(answers, KEYS)


def answer_contexts(conv: DataFrame, n: int = CONTEXT_TURNS) -> DataFrame:
    """conv_id, turn, context: texts of the ``n`` messages before ``turn``."""
    fan = conv.select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_d"),
                      "turn", "text")
    fan = fan.select("conv_id", (F.col("turn") + F.col("_d")).alias("target"),
                     F.struct("turn", "text").alias("m"))
    ctx = fan.groupBy("conv_id", "target").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return ctx.select("conv_id", F.col("target").alias("turn"),
                      F.transform("ms", lambda m: m["text"]).alias("context"))


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    conv = load(spark, sf, "conversations", spread=True)
    pairs = qa_pairs(conv).join(answer_contexts(conv), KEYS, "left")
    return pairs.select(pair_key("conv_id", "turn").alias("query_id"),
                        F.col("question"), F.col("answer"),
                        F.col("question").alias("expected_answer"), "context")


_PAIRS_SQL = """
WITH pairs AS (
  SELECT u.conv_id, u.turn + 1 AS turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
ctx AS (
  SELECT p.conv_id, p.turn,
         list(c.text ORDER BY c.turn) FILTER (WHERE c.turn IS NOT NULL) AS context
  FROM pairs p LEFT JOIN conversations c
    ON c.conv_id = p.conv_id AND c.turn >= p.turn - 2 AND c.turn < p.turn
  GROUP BY p.conv_id, p.turn)
"""


@register("token_jaccard", sql=_PAIRS_SQL + """
SELECT conv_id, turn, round({j}, 9) AS jaccard FROM pairs""".format(
    j=S.jaccard("question", "answer")))
def q_token_jaccard(spark, sf):
    p = qa_pairs(load(spark, sf, "conversations", spread=True))
    return p.select(*KEYS, F.round(TX.token_jaccard("question", "answer"), 9).alias("jaccard"))


@register("chargram_tfidf_cosine", sql=_PAIRS_SQL + """
, lp AS (SELECT conv_id, turn, lower(question) AS a, lower(answer) AS b FROM pairs),
{c}
SELECT p.conv_id, p.turn, round(coalesce(c.cosine, 0.0), 9) AS cosine
FROM pairs p LEFT JOIN cs c ON c.conv_id = p.conv_id AND c.turn = p.turn""".format(
    c=S.cosine_ctes("lp", KEYS, "a", "b", "cs")))
def q_chargram_tfidf_cosine(spark, sf):
    p = qa_pairs(load(spark, sf, "conversations", spread=True))
    lp = p.select(*KEYS, F.lower("question").alias("a"), F.lower("answer").alias("b"))
    cos = ev.chargram_cosine(lp, KEYS, "a", "b")
    return (p.select(*KEYS).join(cos, KEYS, "left")
            .select(*KEYS, F.round(F.coalesce("cosine", F.lit(0.0)), 9).alias("cosine")))


@register("answer_relevancy", sql=_PAIRS_SQL + """
, {h}
SELECT conv_id, turn, round(answer_relevancy, 9) AS answer_relevancy FROM rel""".format(
    h=S.hybrid_sql("pairs", KEYS, S.rewrite("answer", TX.RELEVANCY_REWRITES),
                   S.rewrite("question", TX.RELEVANCY_REWRITES),
                   f"({S.blank('answer')} OR {S.blank('question')})",
                   0.2, 0.8, "answer_relevancy", "rel")))
def q_answer_relevancy(spark, sf):
    p = qa_pairs(load(spark, sf, "conversations", spread=True))
    r = ev.answer_relevancy(p, KEYS, "answer", "question")
    return r.select(*KEYS, F.round("answer_relevancy", 9).alias("answer_relevancy"))


_CTX_JOIN = "array_to_string(list_transform(context, lambda c: {r}), ' ')".format(
    r=S.rewrite("c", TX.FAITHFULNESS_REWRITES))


@register("faithfulness", sql=_PAIRS_SQL + """
, fp AS (SELECT p.conv_id, p.turn, p.answer, c.context FROM pairs p
         LEFT JOIN ctx c ON c.conv_id = p.conv_id AND c.turn = p.turn),
{h}
SELECT conv_id, turn, round(faithfulness, 9) AS faithfulness FROM fai""".format(
    h=S.hybrid_sql("fp", KEYS, S.rewrite("answer", TX.FAITHFULNESS_REWRITES),
                   f"coalesce({_CTX_JOIN}, '')",
                   f"(context IS NULL OR len(context) = 0 OR {S.blank('answer')})",
                   0.1, 0.9, "faithfulness", "fai")))
def q_faithfulness(spark, sf):
    conv = load(spark, sf, "conversations", spread=True)
    p = qa_pairs(conv).join(answer_contexts(conv), KEYS, "left")
    f = ev.faithfulness(p, KEYS, "answer", "context")
    return f.select(*KEYS, F.round("faithfulness", 9).alias("faithfulness"))


@register("latency_stats", sql="""
SELECT event_type, count(value) AS count, round(avg(value), 9) AS mean,
       round(quantile_cont(value, 0.5), 9) AS median, min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90,
       round(quantile_cont(value, 0.99), 9) AS p99
FROM events GROUP BY event_type""")
def q_latency_stats(spark, sf):
    e = load(spark, sf, "events")
    out = ev.latency_stats(e, "value", by=["event_type"])
    return out.select("event_type", "count", *[F.round(c, 9).alias(c) if c not in ("min", "max")
                                              else F.col(c) for c in ev.LATENCY_COLUMNS[1:]])


RANK_ERROR = 0.02


@register("latency_tracked", sql="""
SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
       true AS p50_near, true AS p90_near, true AS p99_near
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def q_latency_tracked(spark, sf):
    """Every day of events is a batch; the batches' summaries are stored, merged and held
    against the ranks that the quantiles have in the whole table."""
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts")).where("value IS NOT NULL")
    store = write_shared(trackers.summaries(e, "value", "day", ["event_type"]), "tracked")
    got = write_shared(trackers.merged(store, ["event_type"]), "merged")
    ranks = [F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_low") for p in trackers.QUANTILES] + [
        F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_high") for p in trackers.QUANTILES]
    seen = (e.select("event_type", "value").join(F.broadcast(got.select(
        F.col("event_type").alias("_t"), *trackers.QUANTILES)), F.col("event_type").eqNullSafe(F.col("_t")))
            .groupBy("event_type").agg(*ranks))
    near = [((F.col(f"{p}_low") <= q + RANK_ERROR) & (F.col(f"{p}_high") >= q - RANK_ERROR)).alias(f"{p}_near")
            for p, q in trackers.QUANTILES.items()]
    return (got.join(seen.withColumnRenamed("event_type", "_t"), F.col("event_type").eqNullSafe(F.col("_t")))
            .select("event_type", "count", F.round("mean", 6).alias("mean"), "min", "max", *near))


@register("evaluate_queries", sql=_PAIRS_SQL + """
, rp AS (SELECT p.conv_id || ':' || p.turn AS query_id, p.question, p.answer, c.context
         FROM pairs p LEFT JOIN ctx c ON c.conv_id = p.conv_id AND c.turn = p.turn),
{h1},
{h2}
SELECT r.query_id, round(r.answer_relevancy, 9) AS answer_relevancy,
       round(f.faithfulness, 9) AS faithfulness
FROM rel r JOIN fai f USING (query_id)""".format(
    h1=S.hybrid_sql("rp", ["query_id"], S.rewrite("answer", TX.RELEVANCY_REWRITES),
                    S.rewrite("question", TX.RELEVANCY_REWRITES),
                    f"({S.blank('answer')} OR {S.blank('question')})",
                    0.2, 0.8, "answer_relevancy", "rel"),
    h2=S.hybrid_sql("(SELECT * FROM rp WHERE context IS NOT NULL)", ["query_id"],
                    S.rewrite("answer", TX.FAITHFULNESS_REWRITES),
                    f"coalesce({_CTX_JOIN}, '')",
                    f"(context IS NULL OR len(context) = 0 OR {S.blank('answer')})",
                    0.1, 0.9, "faithfulness", "fai")))
def q_evaluate_queries(spark, sf):
    per_q = ev.evaluate_queries(eval_records(spark, sf))
    return per_q.select("query_id", F.round("answer_relevancy", 9).alias("answer_relevancy"),
                        F.round("faithfulness", 9).alias("faithfulness"))


def q_aggregate_eval(spark, sf):
    per_q = ev.evaluate_queries(eval_records(spark, sf))
    out = ev.aggregate_eval(per_q)
    return out.select("total_queries", *[F.round(f"mean_{m}", 9).alias(f"mean_{m}")
                                         for m in ev.EVAL_METRICS])


def _aggregate_sql() -> str:
    from skein.plans.registry import _SQL
    per_q = _SQL["evaluate_queries"]
    return ("WITH per_q AS (" + per_q + """)
SELECT count(*) AS total_queries, round(avg(answer_relevancy), 9) AS mean_answer_relevancy,
       NULL::DOUBLE AS mean_context_precision, NULL::DOUBLE AS mean_context_recall,
       NULL::DOUBLE AS mean_f1_score, round(avg(faithfulness), 9) AS mean_faithfulness
FROM per_q""")


register("aggregate_eval", sql=_aggregate_sql())(q_aggregate_eval)
