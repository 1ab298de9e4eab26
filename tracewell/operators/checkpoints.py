"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task is dealt where memory has to stay the same for larger tables.
TASK_ROWS = 250_000
#: Shuffle files of a query go when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tracewell-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all cores, whatever files it comes from: for small rows that take long, such as texts to be parsed."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def tasks_for(rows: int, spark: SparkSession) -> int:
    """Into how many tasks so many rows are dealt, that what one task holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def keep(df: DataFrame) -> DataFrame:
    """df written as a table of the checkpoint folder and read from it, until forget() deletes it: for rounds of loops."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of keep() that no later step reads."""
    for df in tables:
        if path := getattr(df, "_kept", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Seen:
    """What the rounds of a loop have found, in a few tables: of like sizes two are merged, so a row is written log(rounds) times.

    The table added last stays as it is, since the next round starts from it.
    """

    def __init__(self, first: DataFrame):
        self.tables: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, found: DataFrame) -> None:
        self.tables.append((0, found))
        while len(self.tables) > 2 and self.tables[-3][0] == self.tables[-2][0]:
            (level, a), (_, b) = self.tables[-3:-1]
            self.tables[-3:-1] = [(level + 1, keep(a.unionByName(b)))]
            forget(a, b)

    def all(self) -> DataFrame:
        return _union([t for _, t in self.tables])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
