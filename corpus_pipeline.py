"""A corpus pipeline of the operators in tracewell.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs.
All but the last return the columns of documents. A stage begins by deleting the scratch tables of those before, so its
docs must be written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, language_id, packing, stages
from tracewell.llm.common import drop, scratch_path, scratch_tables, tokenizer_path
from tracewell.llm.queries import ROOT


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[DataFrame] = []


def tidy(stage: Stage) -> Stage:
    """Deletes the scratch tables of the stage before, whose result has been written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(*_left)
        before = len(scratch_tables())
        out = stage(spark, docs, sf_dir)
        _left[:] = scratch_tables()[before:]
        return out

    return run


@tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified, with it in lang; texts without letters and undecided ones go."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return language_id.keep_identified(docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share 80 % of their five-word shingles."""
    return stages.one_of_each(docs, shingle=5, percent=80)


@tidy
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur more than once."""
    return stages.without_repeats(docs, length=200)


@tidy
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated with benchmark passages."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
