"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, decontam, idstore, langid, licenses, linededup, ngramjoin, quality, secrets, tokalign,
               tokencount, vectorcodes)
from .common import read_documents, sha256_utf8, shared_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    model = langid.train(docs.filter(~F.coalesce(held_out, F.lit(False))).select("text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return langid.identify(rows, model, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.deduplicate_units(read_documents(spark, sf_dir))
    return cleaned.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"), s["keeper_doc"].cast("string"))), ",").alias("removed"),
        sha256_utf8(F.coalesce("text", F.lit(""))).alias("clean_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(list(secrets.BASE)))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE),
                        sha256_utf8(secrets.span_text(base)).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file tree: source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return licenses.scan(read_documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")).select(
        "doc_id", "path", "license", "origin", "from_dir", F.round("score", 4).alias("score"), "n_notices")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.match(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(read_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.conversations(read_documents(spark, sf_dir, "conversations")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                      outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "id-store")
    idstore.write_store(read_documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"))
    return idstore.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.align(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                          tokenizer_path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(read_documents(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(vectorcodes.codebook_digest(books)).alias("codebooks_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def llm_queries() -> dict:
    return {f.__name__: f for f in (
        op1_language_id, op2_unit_dedup, op3_secret_scans, op4_license_scans, op5_decontamination, op6_ngram_join,
        op7_chat_formatting, op8_quality_rules, op9_bpe, op10_id_store, op11_token_alignment,
        op12_vector_codes, op13_token_counts)}
