"""Native operators against plain Python on awkward and on given texts."""

import brute
import pytest
from pyspark.sql import functions as F

from skein.llm import licenses, pii, quality, queries, secrets
from skein.session import shared_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["awkward", "given", "empty"])
def docs(request, spark):
    if request.param == "given":
        return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = brute.rows() if request.param == "awkward" else []
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def key(row):
    return tuple((x is None, x) for x in row)


def check(result, docs, fn, columns):
    got = sorted(((r["doc_id"], *[r[c] for c in columns]) for r in result.collect()), key=key)
    want = sorted(((r["doc_id"], *fn(r["text"])) for r in docs.collect()), key=key)
    assert got == want


def test_secrets(spark, docs):
    found = secrets.digest(secrets.scan(docs, shared_path(spark, "ledger")))
    base = found.withColumn("base", F.array_join(F.filter(
        F.split("spans", ","), lambda s: s.rlike("^(assign|access|hex):")), ","))
    check(base, docs, brute.secrets, ["n_assign", "n_access", "n_hex", "base_sha256", "base"])


def test_ledger_scans_only_unseen_pairs(spark):
    one = [secrets.RULES[2]]
    v1 = spark.createDataFrame([("a", "f" * 40), ("b", "plain")], "path string, text string")
    v2 = spark.createDataFrame([("a", "f" * 40), ("c", "0" * 32 + " x"), ("d", None)],
                               "path string, text string")
    ledger = shared_path(spark, "ledger")
    secrets.update_ledger(v1, ledger, one)
    new = secrets.unseen(v2, secrets.read_ledger(spark, ledger), one)
    assert {r["text"] for r in new.collect()} == {"0" * 32 + " x", ""}
    more = one + [secrets.Rule("hex", 2, "[0-9]{32,}+", lambda t: F.lit(True), lambda m: F.lit(True))]
    again = secrets.unseen(v1, secrets.read_ledger(spark, ledger), more).collect()
    assert {tuple(r["todo"]) for r in again} == {("hex@2",)}
    got = secrets.scan(v2, ledger, one).collect()
    assert sorted((r["path"], len(r["secrets"])) for r in got) == [("a", 1), ("c", 1), ("d", 0)]
    assert secrets.unseen(v2, secrets.read_ledger(spark, ledger), one).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "x", "y", "z")],
                               "doc_id long, text string, blob_id string, spans string, _found string")
    got = secrets.scan(df, shared_path(spark, "ledger")).collect()[0]
    assert (got["blob_id"], got["spans"], got["_found"], len(got["secrets"])) == ("x", "y", "z", 1)
    stats = quality.with_stats(df.withColumnRenamed("spans", "n_words")).collect()[0]
    assert stats["n_words"] == "y" and stats["stats"]["n_words"] == 1
    assert licenses.scan(df.withColumn("words", F.lit(1))).collect()[0]["n_words"] == 2


def test_license_base(docs):
    check(licenses.scan(docs), docs, brute.license_base,
          ["n_words", "n_base", "first_word", "last_word", "base_labels"])


def test_license_method_labels(spark):
    notice = brute.AWKWARD[15]
    df = spark.createDataFrame([(1, notice), (2, "licensed under CC-BY NC"), (3, "free software")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and 0.6 <= got[1]["score"] <= 1
    assert got[2]["labels"] == "cc-by-nc" and got[3]["labels"] == "" and got[3]["score"] == 0.0


def test_quality_stats(docs):
    out = quality.with_stats(docs)
    flat = out.select("doc_id", "stats.*", quality.base_failed(F.col("stats")).alias("base_failed"))
    check(flat, docs, brute.quality,
          ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])


def test_decision_list_learns_and_keeps(spark):
    got = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    good = [got[r["doc_id"]]["kept"] for r in labels
            if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    bad = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_decision_list_without_labels():
    assert quality.learn([]) == []


def test_pii_base(docs):
    found = pii.digest(pii.find(docs, pii.fit(docs)))
    base = found.withColumn("base", F.array_join(F.filter(
        F.split("spans", ","), lambda s: s.rlike("^(email|ip|card|phone):")), ","))
    check(base, docs, brute.private, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"])


def test_pii_votes_and_mask(spark):
    docs = spark.createDataFrame([
        (i, f"please call tel (555) 234-56{i:02d} or mail me{i}@web.org ok") for i in range(40)],
        "doc_id long, text string")
    weights = pii.fit(docs)
    row = pii.find(docs, weights).where("doc_id = 7").select(
        "pii", pii.masked(F.col("text"), F.col("pii")).alias("masked")).collect()[0]
    assert {s["kind"] for s in row["pii"]} == {"email", "tel"}
    assert row["masked"] == "please call tel <TEL> or mail <EMAIL> ok"
    cells = pii.vote_cells(docs)
    posterior, table = pii.expectation_maximisation(cells)
    assert all(p > 0.5 for p in posterior)
    assert abs(sum(table[0, v, 1] for v in (-1, 0, 1)) - 1) < 1e-9


def test_mask_merges_overlaps(spark):
    df = spark.createDataFrame([("abcdefghij", [(0, 2, 5, "email", 1.0), (1, 4, 7, "ip", 1.0),
                                                (2, 9, 10, "card", 1.0)])],
                               "text string, s array<struct<ord:int,start:int,end:int,kind:string,p:double>>")
    assert df.select(pii.masked(F.col("text"), F.col("s"))).first()[0] == "ab<EMAIL>hi<CARD>"
