"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and hands what it reads back to
the next stage.

All stages take what may be in ``documents``: null and empty texts, null ids,
repeated rows, very long texts, an empty table, further columns. Each states
below what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.common import drop_staged, drop_table, stage_table, staged_tables
from packloom.llm.decontamination import without_leaks
from packloom.llm.jaccard_join import one_of_each
from packloom.llm.packing import best_fit_packing
from packloom.llm.pii import masked
from packloom.llm.quality import good_quality
from packloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts
    are judged alike, by the score of their (all zero) statistics; equal texts
    share their fate; rows without an id are judged but never learnt from."""
    return good_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles,
    similarity 0.8 or more): the one with the smallest id; of rows with one id
    and text any one. Documents without words and rows without an id stay."""
    return one_of_each(docs, words=5, threshold=(8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go. Null and
    empty texts hold none; repeated rows share their fate."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; lengths follow. No row goes; a null text stays
    null and so does its length."""
    return masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null or empty
    text is one piece, its end token; repeated rows are packed as often."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        mark = staged_tables()
        docs = stage_table(stage(spark, docs, sf_dir), name)
        drop_staged(mark, keep=docs)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
