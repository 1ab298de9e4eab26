"""Operators as filters and rewrites of a documents table: rows in, rows out, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import neardup, suffix_dedup
from tracewell.llm.common import boxed, stash, unboxed, with_squeezed


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (of equals, the first read); all columns.

    Rows without words have no duplicates and stay. A null doc_id sorts last.
    """
    held = stash(boxed(docs), "docs")
    found = neardup.near_duplicates(held.select(F.col("row").alias("doc_id"), F.col("rest.text").alias("text")), shingle, percent)
    groups = found.join(held.select(F.col("row").alias("doc_id"), F.col("rest.doc_id").alias("own_id")), "doc_id")
    stay = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("n"), "own_id", F.col("doc_id").alias("r"))).alias("first"))
    return held.join(stay.select(F.col("first.r").alias("row")), "row", "left_semi").select(*map(unboxed, docs.columns))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with every repeated string of `length` bytes removed from the text; n_chars follows the text.

    Characters of which a cut leaves only some bytes go, too. All rows stay, also those of which nothing but white space is
    left; a row that had no repeats stays as it is, also with a null or empty text.
    """
    held = stash(with_squeezed(boxed(docs, "text")), "docs")
    kept = suffix_dedup.without_repeats(held.select("row", F.col("rest.doc_id").alias("doc_id"), "z"), length, "string")
    joined = held.select("row", "rest", F.col("z").isNull().alias("none")).join(kept.select("row", "n_removed", "kept"), "row")
    new = {"text": F.when(~F.col("none"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(unboxed("n_chars"))
    return joined.select(*[new[c].alias(c) if c in new else unboxed(c) for c in docs.columns])
