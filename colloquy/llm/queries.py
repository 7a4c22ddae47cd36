"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    chat_format,
    decontamination,
    hard_negatives,
    language_id,
    license_rules,
    private_values,
    quality_rules,
    quality_votes,
    sentence_pieces,
    simhash,
    source_divergence,
    token_files,
    web_archive,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    done = sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.array_max("ends").cast("long").alias("n_bytes"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_read(spark, sf_dir, "documents")).drop("n_lines", "n_failed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(quality_votes.remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    done = language_id.predicted(docs, model)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.adversarial(_read(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.formatted(turns))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def quality_model(spark: SparkSession, sf_dir: str) -> quality_votes.Model:
    """The model of op6 and of the pipeline's first stage."""
    labels = _read(spark, sf_dir, "labels").where(quality_votes.remainder("doc_id", 4) != 2)
    return quality_votes.fit(_read(spark, sf_dir, "documents"), labels, label="quality")


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_votes.scored(_read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held_out = F.coalesce(quality_votes.remainder("doc_id", 4) == 2, F.lit(False))
    predicted = (F.col("score") >= quality_votes.THRESHOLD).cast("int")
    return done.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.recognised(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_own_key = secrets.token_hex(32)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key of pseudonyms, the setting ``colloquy.pseudonym.secret``.

    Logs hide settings of such a name. Without it, local masters, as in trials, use a fixed key;
    elsewhere every application makes one of its own, which nobody knows, so its pseudonyms
    are linked with each other only.
    """
    local = spark.sparkContext.master.startswith("local")
    return spark.conf.get("colloquy.pseudonym.secret", "change this key" if local else _own_key)


def op9_private_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return private_values.pseudonymised(docs, pseudonym_key(spark))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audited(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archived(_read(spark, sf_dir, "pages"))


QUERIES: dict = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op4_chat_format": op4_chat_format,
    "op3_language_id": op3_language_id,
    "op6_quality_votes": op6_quality_votes,
    "op5_token_files": op5_token_files,
    "op7_license_rules": op7_license_rules,
    "op8_decontamination": op8_decontamination,
    "op9_private_values": op9_private_values,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_web_archive": op13_web_archive,
}
ORACLES: dict = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op7_license_rules": license_rules.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_web_archive": web_archive.ORACLE,
}
