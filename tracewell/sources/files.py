"""Which files lie below some roots, each once by its resolved path."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


@F.pandas_udf(StructType([StructField("real", StringType()), StructField("linked", BooleanType())]))
def resolved(paths: pd.Series) -> pd.DataFrame:
    """Paths with links followed, and whether there were any; only mounted file systems can have them."""
    plain = paths.map(lambda p: unquote(urlsplit(p).path) if p.startswith("file:") else p)
    real = plain.map(lambda p: os.path.realpath(p) if p.startswith("/") else p)
    return pd.DataFrame({"real": real, "linked": real != plain})


def discovered(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(path) of files below roots whose names fit: of paths that lead to one file its own, if it is among them, else the
    first. Names alone are read."""
    listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(roots).select(F.col("_metadata.file_path").alias("path")).distinct()
    known = listed.withColumn("r", resolved("path"))
    return known.groupBy("r.real").agg(F.min_by("path", F.struct("r.linked", "path")).alias("path")).select("path")


def read_whole(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(path, text) of files below roots, each file once; texts are read of those files only that stay."""
    raw = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    texts = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.join(discovered(spark, roots, pattern), "path", "left_semi").dropDuplicates(["path"])
