"""From raw documents to encoded training text, in stages that each write a table.

Every stage works on all that its predecessor kept: documents of low quality go,
one document of each group of near-duplicates stays, documents with benchmark items
go, private values get pseudonyms, and texts become token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, private_values, quality_votes, sentence_pieces, simhash
from colloquy.llm.queries import pseudonym_key, quality_model
from colloquy.llm.shared import unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is predicted as 1.

    Null and empty texts are scored like any other; rows that are repeated stay or go together.
    """
    (score,) = unused(docs.columns, "quality")
    done = quality_votes.scored(docs, quality_model(spark, sf_dir), keep=tuple(docs.columns), name=score)
    return done.where(F.col(score) >= quality_votes.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of linked fingerprints.

    Null and empty texts are one component; of rows that are repeated one stays.
    """
    return simhash.firsts(docs, simhash.near_duplicates(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item of five words or more.

    A row is known by its id and its text, so other texts of a contaminated one's id, or of no id, stay,
    as null and empty texts do.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # One or two common words are no evidence: items under the least length of a match are left to the operator's own report.
    found = decontamination.contaminated(docs, benchmark, text_key=True, least_item_words=decontamination.LEAST_WORDS)
    bad_id, bad_key = unused(docs.columns, "bad_id", "bad_key")
    bad = written(found.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key)), "left_anti")


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values in their texts replaced; n_chars counts the new text, null for a null one."""
    hidden, (own,) = "n_private", unused(docs.columns, "own_n_private")
    kept = docs.withColumnRenamed(hidden, own)  # a column of the operator's name is put aside
    done = private_values.pseudonymised(kept, pseudonym_key(spark)).drop(hidden).withColumnRenamed(own, hidden)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``n_tokens``, ``ids`` and whether they decode to the text again; null counts as empty.

    Columns of the input with one of these names, or a name of the encoder's outputs, give way.
    """
    made = ("n_tokens", "ids", "decodes_to_text", *sentence_pieces.OUTPUTS.names)
    keep = tuple(c for c in docs.columns if c not in made)
    done = sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return done.select(*(F.col(f"`{c}`") for c in keep), F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes_to_text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("private_values", pseudonymised),
    ("sentence_pieces", encoded),
]

#: SQL can't express the votes, fingerprints, alignments and pieces; a test has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
