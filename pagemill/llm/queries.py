"""The queries of this folder, registered by the driver's contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, chat, decontaminate, language_id, licenses, minhash, pii, runtime, token_counts, topk, warc

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model, keep=["doc_id", language_id.held_out().alias("held_out")])


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    return topk.top_k(vectors.select("vec_id", topk.quantise(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0, k=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = runtime.read_small_file(public_tokenizers.path(BYTE_VOCABULARY))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known(spark)).select("doc_id", "license_digest", "license_id")


def op4_sql() -> str:
    known = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in (*licenses.TEXTS, *licenses.NOTICES))
    return f"""
    WITH known AS (
      SELECT sha256({licenses.canonical_sql("text")}) AS d, string_agg(DISTINCT license_id, ' OR ' ORDER BY license_id) AS license_id
      FROM (VALUES {known}) AS k(license_id, text) GROUP BY 1
    ), own AS (SELECT doc_id, {licenses.canonical_sql("text")} AS c FROM documents)
    SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS license_digest, license_id
    FROM own LEFT JOIN known ON c <> '' AND sha256(c) = d
    """


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = runtime.read_small_file(public_tokenizers.path(WORD_VOCABULARY))
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=[F.col("doc_id")], with_ids=False, with_text=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = pii.listed(F.col("base_spans")), pii.listed(F.col("pii_spans"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), unnamed=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), unnamed=True).select("doc_id", "class_id")


ODD_TEXT = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = runtime.read_small_file(public_tokenizers.path(BYTE_VOCABULARY))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.unionByName(odd), vocabulary))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_topk": op2_topk,
    "op3_token_counts": op3_token_counts,
    "op4_licenses": op4_licenses,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_minhash": op9_minhash,
    "op10_chat": op10_chat,
}
ORACLES: dict[str, str] = {"op4_licenses": op4_sql()}
