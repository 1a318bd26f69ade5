"""One registered query per corpus operator, over its whole table.

Each query applies the operator of its module and derives the digest columns
of its result from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import (decontaminate, html_content, jaccard, langid, licenses, mixing, oracle_sql, packing,
                       pii, quality, secrets, variants, warc, whitening)
from skein.llm.memory import small_batches
from skein.session import shared_path, write_shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of ``documents`` by way of a blob ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, shared_path(spark, "ledger"), columns=["doc_id"])
    return secrets.digest(found)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where ``documents`` hold an item of ``benchmark``, small edits included."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of ``documents`` by diagonal voting."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of ``documents`` by a learned decision list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = write_shared(quality.with_stats(docs).select("doc_id", "stats"), "quality")
    rules = quality.learn(quality.labelled_sample(measured, table(spark, sf_dir, "labels")))
    stats = F.col("stats")
    kept, rule = quality.verdict(stats, rules)
    return measured.select(
        "doc_id", *[stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words")],
        quality.base_failed(stats).alias("base_failed"), kept.alias("kept"), rule.alias("rule"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of ``pages``, written to an archive and read back."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of ``documents``; a quarter of them is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model, columns=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages`` by message passing over their trees."""
    pages = table(spark, sf_dir, "pages")
    return html_content.extract(pages, html_content.train(pages), columns=["page_id", "url"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in sequences of at most 4096 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), packing.default_tokenizer(), with_ids=False)
    return packing.pack(write_shared(cut, "pieces"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents`` by weak-supervision aggregation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), columns=["doc_id"])
    return pii.digest(found)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of ``documents`` by the prefix-tree join."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with the words one edit apart and their roots."""
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of ``embeddings``."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each of ``documents`` a mix of sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def plans() -> dict:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_benchmark_leaks, op3_license_scan, op4_quality_rules, op5_warc_archive,
        op6_language_id, op7_main_text, op8_packing, op9_pii_spans, op10_jaccard_join,
        op11_spelling_variants, op12_embedding_whitening, op13_source_mix)}


def oracle() -> dict[str, str]:
    return {"op1_secret_scan": oracle_sql.secret_scan(),
            "op3_license_scan": oracle_sql.license_scan(),
            "op5_warc_archive": oracle_sql.warc_archive(),
            "op10_jaccard_join": oracle_sql.jaccard_join(),
            "op11_spelling_variants": oracle_sql.spelling_variants()}
