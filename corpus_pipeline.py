"""A corpus pipeline of five operators: language ID, near-duplicates, decontamination, personal data, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Stages are written as Parquet to the folder that
the cluster shares and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, language_id, minhash, pii, runtime

WORD_VOCABULARY = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known: not null texts, nor texts without a letter. Whatever has a letter gets a language and stays, as any script may be clean text."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    known = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return runtime.restored(known, docs.columns, language_id.MADE)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest key. A repeated key keeps each of its texts that stands for a class; rows without a key stand for the classes that no row with a key is in."""
    return minhash.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark within its error budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(pii.find(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return runtime.restored(out, docs.columns, pii.MADE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, with digests of the ids and of the decoded text."""
    vocabulary = runtime.read_small_file(public_tokenizers.path(WORD_VOCABULARY))
    return bpe.encode(docs, vocabulary, keep=["doc_id", "lang", "source"], with_text=False)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]

#: SQL can express none of language ID, DartMinHash, edit matching and BPE; tests/llm/test_pipeline.py has the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each on all that the one before kept."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), STAGES[-1][0]
    with runtime.scope(spark):
        for name, stage in STAGES:
            docs = runtime.written(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=name == last)
    return docs
