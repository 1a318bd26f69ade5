"""Retrieval and answer evaluation as table operators.

Inputs are long tables keyed by ``query_id``; outputs are one row per query
plus one-row aggregates.  Every metric is a grouped aggregate with partial
(map-side) aggregation, so a query with an enormous list is combined in
pieces instead of being gathered into one task.

Definitions (kept equal to the reference's):

* context precision  = retrieved chunks whose article is relevant / retrieved
  chunks; 0 when either list is empty.
* context recall     = distinct relevant articles retrieved / length of the
  relevant list (duplicates in that list count); 0 when either is empty.
* F1                 = harmonic mean, 0 when precision + recall = 0.
* MRR                = mean of 1 / rank of the first relevant hit (0 if none).
* MAP                = mean over queries of (sum over relevant hits of
  relevant-so-far / rank) / number of relevant hits *retrieved*.
* latency statistics = count, mean, median, min, max, p50, p90, p99 with
  linear interpolation between order statistics.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# context precision / recall / F1
# ---------------------------------------------------------------------------

def _f1(p, r):
    return (F.when((p + r) == 0, F.lit(0.0))
            .otherwise(F.lit(2.0) * p * r / (p + r)))


def context_scores(retrieved: DataFrame, relevant: DataFrame,
                   queries: DataFrame | None = None,
                   query_id: str = "query_id",
                   article_id: str = "article_id") -> DataFrame:
    """Precision, recall and F1 from explicit lists.

    ``retrieved``: one row per retrieved chunk ``(query_id, article_id)``.
    ``relevant``:  one row per entry of the relevant list ``(query_id,
    article_id)``; duplicates count in the recall denominator, as in the
    reference.  ``queries`` (optional) lists every query so that queries
    without rows still get 0 scores.
    """
    rel_set = relevant.select(query_id, article_id).dropDuplicates()
    rel_len = relevant.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n_rel"))
    flagged = (retrieved.select(query_id, article_id)
               .join(rel_set.withColumn("_hit", F.lit(True)),
                     [query_id, article_id], "left"))
    per_q = flagged.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("_n_ret"),
        F.count(F.col("_hit")).alias("_n_hit"),
        F.count_distinct(F.when(F.col("_hit"), F.col(article_id))).alias("_n_hit_art"))
    keys = queries.select(query_id) if queries is not None else \
        retrieved.select(query_id).union(relevant.select(query_id)).distinct()
    out = keys.join(per_q, query_id, "left").join(rel_len, query_id, "left")
    n_ret = F.coalesce(F.col("_n_ret"), F.lit(0))
    n_rel = F.coalesce(F.col("_n_rel"), F.lit(0))
    p = F.when((n_ret == 0) | (n_rel == 0), F.lit(0.0)) \
        .otherwise(F.col("_n_hit") / n_ret)
    r = F.when((n_ret == 0) | (n_rel == 0), F.lit(0.0)) \
        .otherwise(F.col("_n_hit_art") / n_rel)
    return (out.select(query_id, p.alias("context_precision"),
                       r.alias("context_recall"))
            .withColumn("f1_score", _f1(F.col("context_precision"),
                                        F.col("context_recall"))))


def context_scores_flagged(hits: DataFrame, n_relevant: DataFrame,
                           query_id: str = "query_id", item: str = "vec_id",
                           relevant: str = "relevant",
                           n_rel_col: str = "n_relevant") -> DataFrame:
    """Precision, recall and F1 when relevance is a predicate.

    ``hits`` carries a boolean ``relevant`` per retrieved row and
    ``n_relevant`` gives the size of each query's relevant set, so a relevant
    set is never materialised pair by pair (e.g. "same label" relevance).
    """
    per_q = hits.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("_n_ret"),
        F.count_if(F.col(relevant)).alias("_n_hit"),
        F.count_distinct(F.when(F.col(relevant), F.col(item))).alias("_n_hit_art"))
    out = n_relevant.select(query_id, n_rel_col).join(per_q, query_id, "left")
    n_ret = F.coalesce(F.col("_n_ret"), F.lit(0))
    n_rel = F.coalesce(F.col(n_rel_col), F.lit(0))
    empty = (n_ret == 0) | (n_rel == 0)
    p = F.when(empty, F.lit(0.0)).otherwise(F.col("_n_hit") / n_ret)
    r = F.when(empty, F.lit(0.0)).otherwise(F.col("_n_hit_art") / n_rel)
    return (out.select(query_id, p.alias("context_precision"),
                       r.alias("context_recall"))
            .withColumn("f1_score", _f1(F.col("context_precision"),
                                        F.col("context_recall"))))


# ---------------------------------------------------------------------------
# ranked-list metrics
# ---------------------------------------------------------------------------

def reciprocal_ranks(ranked: DataFrame, queries: DataFrame | None = None,
                     query_id: str = "query_id", rank: str = "rank",
                     relevant: str = "relevant") -> DataFrame:
    """Per query ``1 / rank`` of the first relevant row, 0 when none."""
    first = ranked.groupBy(query_id).agg(
        F.min(F.when(F.col(relevant), F.col(rank))).alias("_first"))
    if queries is not None:
        first = queries.select(query_id).join(first, query_id, "left")
    return first.select(query_id, F.coalesce(F.lit(1.0) / F.col("_first"),
                                              F.lit(0.0)).alias("reciprocal_rank"))


def average_precisions(ranked: DataFrame, queries: DataFrame | None = None,
                       query_id: str = "query_id", rank: str = "rank",
                       relevant: str = "relevant") -> DataFrame:
    """Per query AP (divided by the relevant hits retrieved, 0 when none).
    Only relevant rows need their running count: the others are dropped
    before anything is shuffled or sorted."""
    w = Window.partitionBy(query_id).orderBy(rank)
    running = ranked.filter(F.col(relevant)).select(query_id, rank, F.row_number().over(w).alias("_so_far"))
    per_q = running.groupBy(query_id).agg(
        F.sum(F.col("_so_far") / F.col(rank)).alias("_ps"),
        F.count(F.lit(1)).alias("_nr"))
    if queries is not None:
        per_q = queries.select(query_id).join(per_q, query_id, "left")
    ap = F.when(F.coalesce(F.col("_nr"), F.lit(0)) > 0,
                F.col("_ps") / F.col("_nr")).otherwise(F.lit(0.0))
    return per_q.select(query_id, ap.alias("average_precision"))


def hit_scores(hits: DataFrame, n_relevant: DataFrame, query_id: str = "query_id",
               item: str = "vec_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """RR, AP, precision, recall and F1 of flagged hits, one row for each query
    of ``n_relevant`` (``query_id, n_relevant``).  One grouped aggregate and one
    running count of the relevant rows, both partitioned by the query."""
    per_q = hits.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("_n_ret"),
        F.count_if(F.col(relevant)).alias("_n_hit"),
        F.min(F.when(F.col(relevant), F.col(rank))).alias("_first"),
        F.count_distinct(F.when(F.col(relevant), F.col(item))).alias("_n_hit_art"))
    out = (n_relevant.select(query_id, F.coalesce("n_relevant", F.lit(0)).alias("_n_rel"))
           .join(per_q, query_id, "left")
           .join(average_precisions(hits, None, query_id, rank, relevant), query_id, "left"))
    empty = (F.coalesce("_n_ret", F.lit(0)) == 0) | (F.col("_n_rel") == 0)
    p = F.when(empty, F.lit(0.0)).otherwise(F.col("_n_hit") / F.col("_n_ret"))
    r = F.when(empty, F.lit(0.0)).otherwise(F.col("_n_hit_art") / F.col("_n_rel"))
    return (out.select(query_id,
                       F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
                       F.coalesce("average_precision", F.lit(0.0)).alias("average_precision"),
                       p.alias("context_precision"), r.alias("context_recall"))
            .withColumn("f1_score", _f1(F.col("context_precision"), F.col("context_recall"))))


def mrr(ranked: DataFrame, queries: DataFrame | None = None, **kw) -> DataFrame:
    """Mean reciprocal rank; 0 for an empty query list."""
    rr = reciprocal_ranks(ranked, queries, **kw)
    return rr.agg(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))


def mean_average_precision(ranked: DataFrame, queries: DataFrame | None = None,
                           **kw) -> DataFrame:
    """Mean average precision; 0 for an empty query list."""
    ap = average_precisions(ranked, queries, **kw)
    return ap.agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


# ---------------------------------------------------------------------------
# latency statistics
# ---------------------------------------------------------------------------

# value buckets per group for the exact percentile plan
PERCENTILE_BUCKETS, MAX_BUCKETS, PER_BUCKET = 64, 1024, 100_000


def _join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group keys where a null group meets itself."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _buckets(n: int) -> int:
    """Value buckets for ``n`` distinct values, about ``PER_BUCKET`` in each."""
    return max(PERCENTILE_BUCKETS, min(MAX_BUCKETS, -(-n // PER_BUCKET)))


def exact_percentiles(df: DataFrame, value: str, probs: list[float],
                      by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy's default), as a
    relational plan: ``by..., p, value``.

    1. Distinct values are counted (partial aggregation: a value held by a
       third of the rows is one row).
    2. Each group's values are cut into ``buckets`` ranges at approximate
       quantiles (a bounded sketch per group), so a hot group is spread over
       many tasks; bucket totals (groups x buckets rows) give each bucket's
       rank offset.  Unset, ``buckets`` follows the number of distinct values
       (counted first).  Without groups the cut points, at most ``MAX_BUCKETS``
       numbers, are read first and become literals, so no join is needed.
    3. A running count per (group, bucket) gives every distinct value its
       exact rank range [end - count, end); a value then reports itself for
       each target rank floor/ceil((n - 1) p) it holds.
    The cut points only decide where work is split; the ranks are exact.
    """
    keys = list(by or [])
    v = F.col(value).cast("double")
    src = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    vc = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if buckets is None:
        buckets = _buckets(src.agg(F.approx_count_distinct(F.struct(*keys, "_v"))).first()[0])
    cuts = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10000).alias("_cuts")
    if keys:
        tagged = _join_groups(vc, vc.groupBy(*keys).agg(cuts), keys)
    else:
        found = vc.agg(cuts).first()["_cuts"] or []
        tagged = vc.withColumn("_cuts", F.array(*[F.lit(float(c)) for c in found]).cast("array<double>"))
    tagged = tagged.select(*keys, "_v", "_c",
                           F.size(F.filter("_cuts", lambda b: b < F.col("_v"))).alias("_b"))
    totals = tagged.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bt"))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
    offsets = totals.select(
        *keys, "_b",
        (F.sum("_bt").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding,
                                                      Window.currentRow)) - F.col("_bt"))
        .alias("_off"),
        F.sum("_bt").over(wk.rowsBetween(Window.unboundedPreceding,
                                         Window.unboundedFollowing)).alias("_n"))
    wb = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding,
                                                                  Window.currentRow)
    cum = (_join_groups(tagged.withColumn("_lend", F.sum("_c").over(wb)), offsets, keys + ["_b"])
           .select(*keys, "_v", "_c", (F.col("_off") + F.col("_lend")).alias("_end"), "_n"))
    targets = F.array(*[F.struct(F.lit(p).alias("p"),
                                 ((F.col("_n") - 1) * F.lit(p)).alias("h")) for p in probs])
    x = cum.select(*keys, "_v", (F.col("_end") - F.col("_c")).alias("_start"), "_end",
                   F.explode(targets).alias("_t"))
    lo, hi = F.floor("_t.h"), F.ceil("_t.h")
    holds_lo = (F.col("_start") <= lo) & (lo < F.col("_end"))
    holds_hi = (F.col("_start") <= hi) & (hi < F.col("_end"))
    x = x.filter(holds_lo | holds_hi)
    res = x.groupBy(*keys, F.col("_t.p").alias("p"), F.col("_t.h").alias("h")).agg(
        F.max(F.when(holds_lo, F.col("_v"))).alias("_xlo"),
        F.max(F.when(holds_hi, F.col("_v"))).alias("_xhi"))
    val = F.col("_xlo") + (F.col("h") - F.floor("h")) * (F.col("_xhi") - F.col("_xlo"))
    return res.select(*keys, "p", val.alias(value))


LATENCY_COLUMNS = ["count", "mean", "median", "min", "max", "p50", "p90", "p99"]


def latency_stats(df: DataFrame, value: str = "response_time",
                  by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, median, min, max, p50, p90, p99 (linear interpolation).

    ``exact=True`` computes the percentiles with ``exact_percentiles`` (no
    per-group in-memory value map); ``exact=False`` uses the mergeable
    ``percentile_approx`` sketch.  An empty input gives ``count = 0`` and
    NULL statistics (one row when ungrouped).
    """
    keys = list(by or [])
    v = F.col(value).cast("double")
    aggs = [F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.min(v).alias("min"), F.max(v).alias("max")]
    base = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if not exact:
        pct = df.groupBy(*keys).agg(F.percentile_approx(v, [0.5, 0.9, 0.99], 100000).alias("_p")) \
            if keys else df.agg(F.percentile_approx(v, [0.5, 0.9, 0.99], 100000).alias("_p"))
        pct = pct.select(*keys, F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p90"),
                         F.col("_p")[2].alias("p99"))
    else:
        long = exact_percentiles(df, value, [0.5, 0.9, 0.99], keys)
        pct = long.groupBy(*keys).agg(
            *[F.max(F.when(F.col("p") == p, F.col(value))).alias(name)
              for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])
    j = _join_groups(base, pct, keys, "left") if keys else _one_row_join(base, pct)
    return j.select(*keys, "count", "mean", F.col("p50").alias("median"), "min", "max",
                    "p50", "p90", "p99")


def _one_row_join(base: DataFrame, pct: DataFrame) -> DataFrame:
    """Attach the (0 or 1 row) percentile row to the one-row aggregate."""
    both = base.unionByName(pct, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# ---------------------------------------------------------------------------
# answer relevancy and faithfulness (hybrid char-gram TF-IDF + Jaccard)
# ---------------------------------------------------------------------------

# --- fixed values -----------------------------------------------------------
GRAM_SIZES = (2, 3, 4)           # character n-grams inside space-padded words
RELEVANCY_WEIGHTS = (0.2, 0.8)   # (tf-idf cosine, token jaccard)
FAITHFULNESS_WEIGHTS = (0.1, 0.9)
# --- end of fixed values ----------------------------------------------------


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def pair_similarity(pairs: DataFrame, key, a: str = "a", b: str = "b") -> DataFrame:
    """Per pair: char-gram TF-IDF ``cosine`` and token ``jaccard``.

    TF-IDF is fitted on each pair (two documents): tf = 1 + ln(count),
    idf = ln(3 / (1 + df)) + 1, L2-normalised.  Jaccard is |A ∩ B| / |A ∪ B|
    of the whitespace-token sets (0 when either is empty).  The texts are
    hash-partitioned by pair and sorted by it once; a task then reads one pair
    after the other and holds the words and grams of one, so neither word nor
    gram rows are shuffled, grouped or spilled.  Rows of one key count as one
    pair.  Pairs without words get no row (both scores are 0 for them).
    """
    from pyspark.sql import types as T

    from skein.functions.text import words
    ks = _keys(key)
    rows = (pairs.select(*ks, F.col(a).alias("_ta"), F.col(b).alias("_tb")).repartition(*ks)
            .sortWithinPartitions(*ks).select(*ks, words(F.col("_ta")).alias("_wa"), words(F.col("_tb")).alias("_wb")))
    schema = T.StructType([rows.schema[k] for k in ks] + [
        T.StructField(c, T.DoubleType()) for c in ("cosine", "jaccard")])

    def run(batches):
        import pyarrow as pa
        now, sides, done = None, (Counter(), Counter()), []

        def finished():
            return [(*now, *_similarity(*sides))] if sides[0] or sides[1] else []
        types = None
        for batch in batches:
            types = [batch.column(k).type for k in ks] + [pa.float64()] * 2
            for at in range(0, batch.num_rows, 64):
                part = [c.to_pylist() for c in batch.slice(at, 64).columns]
                for *own, wa, wb in zip(*part):
                    if own != now:
                        done += finished()
                        now, sides = own, (Counter(), Counter())
                    sides[0].update(wa or ())
                    sides[1].update(wb or ())
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], schema.names)
                    done = []
        done += finished()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], schema.names)
    return rows.mapInArrow(run, schema)


def _gram_counts(words: Counter) -> Counter:
    """Character n-grams of a pair's counted words, each padded with one space."""
    out: Counter = Counter()
    for word, c in words.items():
        padded = f" {word} "
        for n in GRAM_SIZES:
            for i in range(len(padded) - n + 1):
                out[padded[i:i + n]] += c
    return out


def _similarity(a: Counter, b: Counter) -> tuple[float, float]:
    """TF-IDF cosine and Jaccard of two counted word lists."""
    both, alone = math.log(1.0) + 1.0, math.log(1.5) + 1.0      # idf of a gram of two and of one text
    ga, gb = _gram_counts(a), _gram_counts(b)
    wa, wb = ({g: (1.0 + math.log(c)) * (both if g in other else alone) for g, c in own.items()}
              for own, other in ((ga, gb), (gb, ga)))
    na, nb = (math.fsum(w * w for w in x.values()) for x in (wa, wb))
    dot = math.fsum(w * wb[g] for g, w in wa.items() if g in wb)
    return dot / math.sqrt(na * nb) if na > 0 and nb > 0 else 0.0, len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def chargram_cosine(pairs: DataFrame, key, a: str = "a", b: str = "b") -> DataFrame:
    """Char-gram TF-IDF cosine per pair (see ``pair_similarity``)."""
    return pair_similarity(pairs, key, a, b).select(*_keys(key), "cosine")


def _hybrid(prepared: DataFrame, ks, weights, out: str) -> DataFrame:
    """prepared: keys, _a, _b (preprocessed), _blank -> keys, out."""
    sims = pair_similarity(prepared.filter(~F.col("_blank")), ks, "_a", "_b")
    j = prepared.select(*ks, "_blank").join(sims, ks, "left")
    w_cos, w_jac = weights
    score = (F.lit(w_cos) * F.coalesce(F.col("cosine"), F.lit(0.0)) +
             F.lit(w_jac) * F.coalesce(F.col("jaccard"), F.lit(0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return j.select(*ks, F.when(F.col("_blank"), F.lit(0.0)).otherwise(score).alias(out))


def _blank(c) -> "F.Column":
    from skein.functions.text import py_strip
    return c.isNull() | (py_strip(c) == "")


def answer_relevancy(df: DataFrame, key, answer: str = "answer",
                     expected: str = "expected_answer") -> DataFrame:
    """Relevancy of each answer to its expected answer, in [0, 1]:
    ``0.2 * tfidf_cosine + 0.8 * jaccard`` of the rewritten texts, 0 when
    either text is blank."""
    from skein.functions.text import synonyms_relevancy
    ks = _keys(key)
    a, e = F.col(answer), F.col(expected)
    prepared = df.select(*ks, synonyms_relevancy(a).alias("_a"),
                         synonyms_relevancy(e).alias("_b"),
                         (_blank(a) | _blank(e)).alias("_blank"))
    return _hybrid(prepared, ks, RELEVANCY_WEIGHTS, "answer_relevancy")


def faithfulness(df: DataFrame, key, answer: str = "answer",
                 context: str = "context") -> DataFrame:
    """Faithfulness of each answer to its context list, in [0, 1]:
    ``0.1 * tfidf_cosine + 0.9 * jaccard`` of the rewritten answer and the
    rewritten contexts joined with a space; 0 when the context list is
    missing/empty or the answer is blank."""
    from skein.functions.text import synonyms_faithfulness
    ks = _keys(key)
    a, ctx = F.col(answer), F.col(context)
    joined = F.array_join(F.transform(ctx, synonyms_faithfulness), " ")
    no_ctx = ctx.isNull() | (F.size(ctx) == 0)
    prepared = df.select(*ks, synonyms_faithfulness(a).alias("_a"),
                         F.coalesce(joined, F.lit("")).alias("_b"),
                         (no_ctx | _blank(a)).alias("_blank"))
    return _hybrid(prepared, ks, FAITHFULNESS_WEIGHTS, "faithfulness")


# ---------------------------------------------------------------------------
# per-query evaluation and aggregation
# ---------------------------------------------------------------------------

EVAL_METRICS = ["answer_relevancy", "context_precision", "context_recall",
                "f1_score", "faithfulness"]


def evaluate_queries(records: DataFrame, query_id: str = "query_id",
                     retrieved: DataFrame | None = None,
                     relevant: DataFrame | None = None) -> DataFrame:
    """Per query, each metric whose inputs are present (else NULL).

    ``records``: query_id, answer, expected_answer, retrieved_chunks
    (array<struct<article_id,...>>), relevant_article_ids (array<string>),
    context (array<string>), response_time; all but query_id nullable.
    Instead of the two id lists, ``retrieved`` and ``relevant`` may be given as
    tables of ``query_id, article_id``, so that no long list is gathered; a
    query without a relevant row then has no precision, recall or F1.
    """
    cols = set(records.columns)
    out = records.select(query_id, *([F.col("response_time")] if "response_time" in cols else []))
    if {"answer", "expected_answer"} <= cols:
        has = records.filter(F.col("answer").isNotNull() & F.col("expected_answer").isNotNull())
        out = out.join(answer_relevancy(has, query_id), query_id, "left")
    if retrieved is not None and relevant is not None:
        known = relevant.select(query_id).distinct()
        scores = context_scores(retrieved.join(known, query_id, "left_semi"), relevant, known, query_id)
        out = out.join(scores, query_id, "left")
    elif {"retrieved_chunks", "relevant_article_ids"} <= cols:
        has = records.filter(F.col("retrieved_chunks").isNotNull() &
                             F.col("relevant_article_ids").isNotNull())
        retrieved = has.select(query_id, F.explode("retrieved_chunks").alias("_c")) \
            .select(query_id, F.col("_c.article_id").alias("article_id"))
        relevant = has.select(query_id, F.explode("relevant_article_ids").alias("article_id"))
        scores = context_scores(retrieved, relevant, has.select(query_id))
        out = out.join(scores, query_id, "left")
    if {"answer", "context"} <= cols:
        has = records.filter(F.col("answer").isNotNull() & F.col("context").isNotNull())
        out = out.join(faithfulness(has, query_id), query_id, "left")
    for m in EVAL_METRICS:
        if m not in out.columns:
            out = out.withColumn(m, F.lit(None).cast("double"))
    return out


def aggregate_eval(per_query: DataFrame, value: str = "response_time") -> DataFrame:
    """One row: total_queries, mean_<metric> over the queries that have it
    (``avg`` skips NULL), and the latency statistics of ``response_time``
    (prefixed ``response_time_``)."""
    aggs = [F.count(F.lit(1)).alias("total_queries")] + \
        [F.avg(m).alias(f"mean_{m}") for m in EVAL_METRICS]
    base = per_query.agg(*aggs)
    if value not in per_query.columns:
        return base
    lat = latency_stats(per_query, value).select(
        *[F.col(c).alias(f"{value}_{c}") for c in LATENCY_COLUMNS])
    # two one-row tables stacked and folded into one row, without a cross join
    both = base.unionByName(lat, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
