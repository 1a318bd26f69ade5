"""The corpus pipeline: language ID, near-copy removal, benchmark
decontamination, masking of personal data and packing, in this order.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and works on
all that its predecessor kept.  All but the last return the columns of
``documents``.  Stage results are written as Parquet in the shared folder and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import decontaminate, jaccard, langid, packing, pii
from skein.llm.memory import small_batches
from skein.session import ship_package, write_shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept (no ``und``, no rejection)."""
    small_batches(spark)
    model = langid.train(docs)
    out = langid.identify(docs, model, out=("\x01lang", "\x01score", "\x01rejected"))
    return out.where(~F.col("`\x01rejected`")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return jaccard.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    small_batches(spark)
    found = pii.find(docs, pii.fit(docs), out="\x01pii")
    spans = F.col("`\x01pii`")
    return (found.withColumn("text", F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), spans)))
            .withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long"))
                        .otherwise(F.col("n_chars")))
            .select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    small_batches(spark)
    cut = packing.pieces(docs, packing.default_tokenizer(), with_ids=False)
    return packing.pack(write_shared(cut, "pieces"))


STAGES = [
    ("language_id", language),
    ("near_copies", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: learned models, edit distances and tokenizers are beyond SQL; the stages are
#: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, name)
    return docs
