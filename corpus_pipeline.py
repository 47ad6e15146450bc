"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept. All but the last return the
columns of documents; n_chars follows the text where a stage shortens it. A stage's rows are stored before the next one
begins, so the next one deletes the tables that the stage before left in the shared folder, and no others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, pieces, quality, suffixes
from tidemark.llm.common import deleted, mark, table_path, taken
from tidemark.operators.sinks import removed
from tidemark.sources.tables import read_table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Tables of the stage before, whose rows are stored once the next stage begins.
_left: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(made: Stage) -> Stage:
    """The stage, which first deletes what the one before left."""

    @functools.wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(spark, _left)
        _left.clear()
        since = mark()
        out = made(spark, docs, sf_dir)
        _left.extend(taken(since))
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_filter(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five words, similarity 0.8 or more."""
    return near_dedup.one_of_each(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every 100-byte string that also starts earlier; documents with nothing left go."""
    short = suffixes.without_repeats(docs)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return short.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select(*docs.columns)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


@_stage
def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded (the text as the ids give it back)."""
    made = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL)
    return made.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: Expectation-maximisation and BPE merging are beyond SQL; tests/llm/test_llm.py holds the operators against brute force, no test yet the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        path = table_path(spark, f"stage{number}")
        made.write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
