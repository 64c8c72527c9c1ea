"""From raw documents to packed sequences: five stages, each a DataFrame program over all that the stage before it kept.

Odd rows, stage by stage: null and empty texts get the classifier's score for no text; where that keeps them, the language
stage drops them (they have no language), as it drops texts without a letter. Null ids are scored, identified, linked, cut and
packed like others and never learned from. Rows that repeat are copies: one of them stays. Texts of any length are treated
whole. Extra columns, whatever their names, stay until packing. An empty table gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from arbora.llm import langid, packing, quality, simhash, substring
from arbora.plans import drop, load, shared_dir, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold; the classifier learns from the labels of ``sf_dir``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that repeat anywhere in them."""
    return substring.drop_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two of tokens, with their ids."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", repeat_stage),
    ("packing", packing_stage),
]

#: SQL has no zstandard dictionaries, trained models, XXH64 or tokenizers; tests hold each stage against brute force.
ORACLE_SQL = None


def _finished(spark: SparkSession, marker: str) -> bool:
    try:
        return not spark.read.parquet(marker).isEmpty()
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to shared storage and read again for the next. What a stage
    leaves there besides, and its rows once the next stage has used them, are deleted.

    A run with a ``name`` marks the stages that are done. If its driver is lost, another run of that name goes on after the last
    of them; the caller sees to it that the input is the same.
    """
    folder = f"{shared_dir(spark)}/arbora/{name or uuid.uuid4().hex}"
    rows, done = ([f"{folder}-{k}-{what}/{what}" for k in range(len(STAGES))] for what in ("rows", "done"))
    last = max((k for k in range(len(STAGES)) if name and _finished(spark, done[k])), default=-1)
    docs = spark.read.parquet(rows[last] if last >= 0 else f"{sf_dir}/documents.parquet")
    for k in range(last + 1, len(STAGES)):
        with temporary(spark):
            out = STAGES[k][1](spark, docs, sf_dir)
            out.write.mode("overwrite").parquet(rows[k])
        docs = load(spark, out.schema, rows[k])
        if name:
            spark.range(1).write.mode("overwrite").parquet(done[k])
        if k:
            drop(spark, rows[k - 1], *[done[k - 1]] * bool(name))
    return docs
