"""A pipeline over ``documents``: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes the documents that the stage before it kept and returns documents with the same columns; the
last adds token ids. ``run`` writes each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specaudit.llm import decontam, line_dedup, ngram_join, quality, sp_codec
from specaudit.llm.common import materialise
from specaudit.llm.queries import tokenizer


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars of the present text."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return _with_length(quality.keep_clean(docs), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of passages; those of which too few words are left go."""
    return _with_length(line_dedup.keep_rest(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    A near copy that has lost a passage no longer looks like its source, so documents whose text the stages before
    have changed are compared by their first text as well.
    """
    return ngram_join.keep_one(docs, also=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; decoding them gives the text back."""
    return sp_codec.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Passage removal and piece encoding can't be said in SQL; tests/llm/test_corpus_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
