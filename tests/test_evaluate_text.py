"""Answer relevancy / faithfulness kernels against literal cases.

Expected scores are derived from the metric definitions (TF-IDF on the
pair, sublinear tf, smooth idf, L2 norm; Jaccard on token sets).
"""

import pytest
from pyspark.sql import functions as F

from skein.operators import evaluate as ev

REL_CASES = [
    (1, "Artificial intelligence is transforming healthcare through predictive analytics.",
     "Artificial intelligence is transforming healthcare through predictive analytics.", 1.0),
    (2, "AI is revolutionizing medicine via predictive models.",
     "Artificial intelligence is transforming healthcare through predictive analytics.", 0.7878),
    (3, "The weather is sunny today.", "Artificial intelligence is transforming healthcare.", 0.1055),
    (4, "Machine learning detects diseases", "ML helps in disease detection", 0.8176),
    (5, "Weather is sunny", "AI in medicine", 0.0065),
    (6, "", "Some expected answer", 0.0),
    (7, "   ", "Some expected answer", 0.0),
]


def test_relevancy_cases(spark):
    df = spark.createDataFrame([(i, a, e) for i, a, e, _ in REL_CASES],
                               "query_id int, answer string, expected_answer string")
    got = {r.query_id: r.answer_relevancy for r in ev.answer_relevancy(df, "query_id").collect()}
    for i, _, _, want in REL_CASES:
        assert got[i] == pytest.approx(want, abs=1e-4), (i, got[i], want)


def test_faithfulness_cases(spark):
    rows = [
        (1, "AI is used in healthcare for diagnosis. Machine learning helps detect diseases.",
         ["Artificial intelligence is widely used in healthcare for diagnostic purposes.",
          "Machine learning algorithms can detect diseases with high accuracy."], 0.5015),
        (2, "AI can cure cancer completely. It has 100% success rate.",
         ["AI assists in cancer detection and treatment planning.",
          "Machine learning shows promising results in oncology."], 0.1549),
        (3, "Some answer", [], 0.0),
        (4, "Some answer", None, 0.0),
    ]
    df = spark.createDataFrame(rows, "query_id int, answer string, context array<string>, w double")
    got = {r.query_id: r.faithfulness for r in ev.faithfulness(df, "query_id").collect()}
    for i, _, _, want in rows:
        assert got[i] == pytest.approx(want, abs=1e-4), (i, got[i], want)


def test_ir_metrics_literal(spark):
    ranked = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, True), (3, 1, False),
         (3, 2, False), (3, 3, True)], "query_id int, rank int, relevant boolean")
    assert ev.mrr(ranked).first().mrr == pytest.approx((1 + 0.5 + 1 / 3) / 3)
    one = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)],
                                "query_id int, rank int, relevant boolean")
    assert ev.mean_average_precision(one).first().map == pytest.approx((1 + 2 / 3) / 2)
    empty = spark.createDataFrame([], "query_id int, rank int, relevant boolean")
    assert ev.mrr(empty).first().mrr == 0.0


def test_context_scores_literal(spark):
    ret = spark.createDataFrame([(1, "art1"), (1, "art2"), (1, "art3"), (2, "art1"), (2, "art2")],
                                "query_id int, article_id string")
    rel = spark.createDataFrame([(1, "art1"), (1, "art3"), (2, "art1"), (2, "art2"), (2, "art3")],
                                "query_id int, article_id string")
    got = {r.query_id: r for r in ev.context_scores(ret, rel).collect()}
    assert got[1].context_precision == pytest.approx(2 / 3)
    assert got[2].context_recall == pytest.approx(2 / 3)
    ret3 = spark.createDataFrame([(3, "art1"), (3, "art2"), (3, "art3")], "query_id int, article_id string")
    rel3 = spark.createDataFrame([(3, "art1"), (3, "art2"), (3, "art4")], "query_id int, article_id string")
    r = ev.context_scores(ret3, rel3).first()
    assert r.f1_score == pytest.approx(2 / 3)


def test_latency_stats(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(1, 11)], "response_time double")
    r = ev.latency_stats(df).first()
    assert r["count"] == 10 and r["mean"] == pytest.approx(0.55) and r["median"] == pytest.approx(0.55)
    assert r["min"] == pytest.approx(0.1) and r["max"] == pytest.approx(1.0)
    df2 = spark.createDataFrame([(i / 100,) for i in range(1, 101)], "response_time double")
    r2 = ev.latency_stats(df2).first()
    assert (r2.p50, r2.p90, r2.p99) == pytest.approx((0.505, 0.901, 0.9901))
    e = ev.latency_stats(spark.createDataFrame([], "response_time double")).first()
    assert e["count"] == 0 and e["mean"] is None and e["p99"] is None


def test_evaluate_and_aggregate(spark):
    schema = ("query_id int, answer string, expected_answer string, "
              "retrieved_chunks array<struct<chunk:string,article_id:string>>, "
              "relevant_article_ids array<string>, context array<string>, response_time double")
    rows = [
        (1, "AI transforms healthcare", "AI transforms healthcare",
         [("c", "art1"), ("c", "art2")], ["art1", "art2"], ["AI transforms healthcare"], 0.5),
        (2, None, None, [("c", "art3")], ["art1"], None, 1.5),
    ]
    df = spark.createDataFrame(rows, schema)
    per_q = {r.query_id: r for r in ev.evaluate_queries(df).collect()}
    assert per_q[1].answer_relevancy == pytest.approx(1.0)
    assert per_q[1].context_precision == 1.0 and per_q[2].context_precision == 0.0
    assert per_q[2].answer_relevancy is None and per_q[2].faithfulness is None
    agg = ev.aggregate_eval(ev.evaluate_queries(df)).first()
    assert agg.total_queries == 2
    assert agg.mean_answer_relevancy == pytest.approx(1.0)      # only query 1 has it
    assert agg.mean_context_precision == pytest.approx(0.5)
    assert agg.response_time_mean == pytest.approx(1.0)
    assert agg.response_time_median == pytest.approx(1.0)


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.round(rng.exponential(2.0, 3000), 2), np.full(1500, 0.25)])
    grp = rng.integers(0, 3, len(vals))
    rows = [(int(g), float(v)) for g, v in zip(grp, vals)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {(r.g, r.p): r.v for r in ev.exact_percentiles(df, "v", probs, ["g"], buckets=8).collect()}
    for g in range(3):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.percentile(vals[grp == g], 100 * p), abs=1e-12)
    whole = {r.p: r.v for r in ev.exact_percentiles(df, "v", probs, None, buckets=8).collect()}
    for p in probs:
        assert whole[p] == pytest.approx(np.percentile(vals, 100 * p), abs=1e-12)


def test_pair_similarity_groups_no_words_or_grams(spark):
    """One shuffle of the texts; nothing of words or grams is grouped or shuffled.  Rows
    of one key (null too) count as one pair, pairs without words get no row."""
    rows = [(1, "x", "ab cab", "cab d"), (1, "x", "zz", "cab"), (1, None, "ab", "ab"), (1, None, "q", None),
            (2, "x", "one", None), (3, "x", " ", ""), (4, "x", "same text here", "same text here")]
    pairs = spark.createDataFrame(rows, "i int, k string, a string, b string")
    out = ev.pair_similarity(pairs, ["i", "k"], "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan and "Generate" not in plan
    got = {(r.i, r.k): (r.cosine, r.jaccard) for r in out.collect()}
    one = spark.createDataFrame([(1, "ab cab zz", "cab d cab"), (2, "ab q", "ab")], "i int, a string, b string")
    want = {r.i: (r.cosine, r.jaccard) for r in ev.pair_similarity(one, "i", "a", "b").collect()}
    assert set(got) == {(1, "x"), (1, None), (2, "x"), (4, "x")}
    assert got[1, "x"] == pytest.approx(want[1]) and got[1, None] == pytest.approx(want[2])
    assert got[2, "x"] == (0.0, 0.0) and got[4, "x"] == pytest.approx((1.0, 1.0))
