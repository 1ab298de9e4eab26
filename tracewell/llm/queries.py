"""The queries op<N>_<name> and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import collocations, decontaminate, embedding_dedup, language_id, neardup, ngram_lm, packing, quality, suffix_dedup, token_files, toxicity, url_filter, vector_codes
from tracewell.llm.common import tokenizer_path


#: The folder that holds the package: Python workers must find it as the driver does.
ROOT = str(Path(__file__).resolve().parents[2])


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=200, kept=None).drop("removed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.RULES))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(_read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learned_split(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13, percent=5)
    return found.drop("items", "hit_spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learned_split(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_by_label(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op6_minhash": neardup.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
