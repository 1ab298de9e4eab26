"""Substring search over keys and names by posting lists of three-letter grams.

A gram's list names the nodes that have it. What a pattern asks for beside its wildcards is cut into grams, the nodes on all
their lists are candidates, and the pattern itself is then tried on those. Each posting carries its node, so a search reads
lists and nothing else; the list of the empty gram has all nodes, for patterns without three letters in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.lineage import SEARCHED_TYPES

GRAM = 3
_OWN = ("gram", "in_key", "in_name")


def grams(text: Column) -> Column:
    """The different runs of three letters of a text in lower case; none of a null or shorter one."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda k: F.substring(low, k, GRAM))
    return F.when(F.length(low) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, in_key, in_name) with the columns of nodes, for those that searches look at."""
    own = nodes.where(F.col("type").isin(*SEARCHED_TYPES))
    side = lambda c: F.transform(grams(F.col(c)), lambda g: F.struct(g.alias("gram"), F.lit(c == "key").alias("in_key"), F.lit(c == "name").alias("in_name")))
    whole = F.array(F.struct(F.lit("").alias("gram"), F.lit(True).alias("in_key"), F.lit(True).alias("in_name")))
    return own.select(F.inline(F.concat(whole, side("key"), side("name"))), *nodes.columns)


def save_postings(nodes: DataFrame, folder: str) -> None:
    """Postings in the order of grams and keys: a search's filter skips all files and row groups but those of its grams.

    Ranges are of grams and keys, so a gram that all nodes have is dealt to many tasks.
    """
    postings(nodes).repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(folder)


def wanted_grams(spark: SparkSession, pattern: str) -> list[str]:
    """The grams that every match of an ILIKE pattern has; what stands behind a backslash counts as a wildcard."""
    pieces = F.split(F.lower(F.lit(pattern)), r"\\.|[%_]")
    return sorted(spark.range(1).select(F.array_distinct(F.flatten(F.transform(pieces, grams)))).first()[0])


def search(index: DataFrame, query: str) -> DataFrame:
    """The nodes of postings whose key or name has `query` in it, whatever the case; % and _ are wildcards.

    The rows and their order are those of lineage.search.
    """
    pattern = f"%{query}%"
    wanted = wanted_grams(index.sparkSession, pattern) or [""]
    node = [c for c in index.columns if c not in _OWN]
    lists = index.where(F.col("gram").isin(*wanted)).groupBy(*node).agg(F.count_if("in_key").alias("k"), F.count_if("in_name").alias("n"))
    fits = ((F.col("k") == len(wanted)) & F.col("key").ilike(pattern)) | ((F.col("n") == len(wanted)) & F.col("name").ilike(pattern))
    return lists.where(fits).select(*node).orderBy("name", "key")
