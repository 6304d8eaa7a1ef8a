"""A training-data pipeline of five stages over ``documents``.

Each stage works on all its predecessor kept; ``run`` writes a stage's rows to
the shared folder and rereads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfern.llm import bpe, decontam, lang_id, line_dedup, near_dup, queries
from wayfern.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior share below which a prediction rejects a document; clean short texts are kept.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no language claims."""
    model = lang_id.train(docs.where(~queries.held_out()), public_tokenizers.path(queries.PIECES))
    found = lang_id.predict(docs, model, keep=COLUMNS[:1] + COLUMNS[2:] + ["text"])
    return found.where((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated blocks from later documents; one that has no word left goes."""
    found = line_dedup.dedup_lines(docs)
    left = F.col("gone").isNull() | F.col("text").rlike(r"\S")
    n_chars = F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return found.where(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group."""
    lost = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(lost.distinct(), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontam.find_classes(docs, table(spark, sf_dir, "benchmark"), every=True).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs, public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Language models, alignment and merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
