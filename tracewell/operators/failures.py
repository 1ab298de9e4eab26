"""Scan runs and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of the failures' sources.
SOURCES = ("kettle", "java", "metadata")


def latest_run(runs: DataFrame) -> DataFrame:
    """The last of runs (run_id, created_at) by time and id."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def run_states(runs: DataFrame) -> DataFrame:
    """Of each run in runs (run_id, status, ..., finished_at) the last state: the finished one, if it has been written."""
    return runs.groupBy("run_id").agg(F.max(F.struct(F.col("finished_at").isNotNull().alias("done"), F.struct(*[F.col(c) for c in runs.columns if c not in ("run_id", "inputs")]).alias("state"))).alias("last"), F.first("inputs").alias("inputs")).select("run_id", "last.state.*", "inputs")


def latest_time(finished: Column, started: Column, created: Column) -> Column:
    return F.coalesce(finished, started, created)


def failure_summary(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_type, n, files) of the latest run; the three fixed sources have a row even without failures."""
    own = failures.join(F.broadcast(latest_run(runs).select("run_id")), "run_id", "left_semi")
    counts = own.groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    fixed = failures.sparkSession.createDataFrame([(s,) for s in SOURCES], "source_type string")
    return fixed.join(counts, "source_type", "full").select("source_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"))


def failure_files(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_rank, source_type, file_path, n): files of the latest run with failures; only fixed sources are grouped."""
    own = failures.join(F.broadcast(latest_run(runs).select("run_id")), "run_id", "left_semi").where(F.col("source_type").isin(*SOURCES))
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_type"))
    return own.groupBy("source_type", "file_path").agg(F.count("*").alias("n")).select(rank.alias("source_rank"), "source_type", "file_path", "n").orderBy("source_rank", "file_path")


def status_label(status: Column) -> Column:
    return F.when(status == "completed", "Completed").when(status == "failed", "Failed").when(status == "running", "Running").otherwise("Pending")
