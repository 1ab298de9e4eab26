"""Catalogue metadata: rows of information_schema, by JDBC or as any DataFrame."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.sqltext import extract_tables, object_key


class MetadataConfigurationError(ValueError):
    """The request can't be made."""


class MetadataConnectionError(ValueError):
    """The catalogue can't be reached."""


def metadata_request(dsn: str | None, databases: list[str] | None) -> tuple[str, list[str]] | None:
    """(dsn, sorted databases), or None without a dsn. Without databases, the dsn's own; else an error."""
    if not dsn or not dsn.strip():
        return None
    names = sorted({d.strip() for d in databases or [] if d and d.strip()})
    names = names or [x for x in (urlsplit(dsn.strip().removeprefix("jdbc:")).path.strip("/"),) if x]
    if not names:
        raise MetadataConfigurationError("name a database in the dsn or in the list of databases")
    return dsn.strip(), names


#: Settings of a url whose values are secret.
_SECRET = re.compile(r"(?i)([?&;,(]\s*[\w.-]*(?:password|passwd|pwd|passphrase|secret|token|credential)[\w.-]*\s*=)[^&;,)\s]*")


def redacted(dsn: str) -> str:
    """dsn without its password, whether it stands before the host or among the settings."""
    head, sep, rest = dsn.partition("://")
    host, slash, tail = rest.partition("/")
    user, at, place = host.rpartition("@")
    if at and ":" in user:
        rest = f"{user.split(':', 1)[0]}:***@{place}{slash}{tail}"
    return _SECRET.sub(r"\1***", head + sep + rest)


def without_secrets(message: str, dsn: str) -> str:
    """A message that may repeat dsn or parts of it, without what redacted() takes out."""
    out = message.replace(dsn, redacted(dsn))
    user, at, _ = dsn.partition("://")[2].partition("/")[0].rpartition("@")
    secrets = [user.split(":", 1)[1]] if at and ":" in user else []
    secrets += [m.group(0)[len(m.group(1)) :].strip() for m in _SECRET.finditer(dsn)]
    for secret in filter(None, secrets):
        out = out.replace(secret, "***")
    return _SECRET.sub(r"\1***", out)


def catalogue_rows(columns: DataFrame, tables: DataFrame, views: DataFrame, databases: list[str]) -> DataFrame:
    """Columns with their tables and, where there is one, view definition, of the named schemas."""
    on = ["table_schema", "table_name"]
    joined = columns.where(F.col("table_schema").isin(*databases)).join(tables.select(*on, "table_type", "table_comment"), on).join(views.select(*on, "view_definition"), on, "left")
    kind = F.when(F.upper("table_type") == "VIEW", "view").otherwise("table")
    return joined.select(F.col("table_schema").alias("database_name"), F.col("table_name").alias("object_name"), kind.alias("object_kind"), F.col("table_comment").alias("comment"), "view_definition", "column_name", "data_type", F.col("ordinal_position").cast("int").alias("ordinal_position"), "is_nullable", "column_comment")


def read_catalogue(spark: SparkSession, jdbc_url: str, databases: list[str], **options: str) -> DataFrame:
    """catalogue_rows over JDBC. Each schema is a partition of its own, read over its own connection with its filter."""
    try:
        of = [f"table_schema = '{d.replace(chr(39), chr(39) * 2)}'" for d in databases]
        table = lambda name: spark.read.options(**options).jdbc(jdbc_url, f"information_schema.{name}", predicates=of)
        return catalogue_rows(*(t.toDF(*[c.lower() for c in t.columns]) for t in map(table, ("columns", "tables", "views"))), databases)
    except Exception as e:
        said = str(e)
        if "UnknownHost" in said or "Communications link" in said:
            raise MetadataConnectionError("the host is unknown or can't be reached") from e
        if "No suitable driver" in said or "ClassNotFound" in said:
            raise MetadataConnectionError("the JDBC driver is missing") from e
        raise MetadataConnectionError(without_secrets(said.splitlines()[0], jdbc_url)) from e


def metadata_objects(rows: DataFrame) -> DataFrame:
    """One row for each object: key, database, object, kind, comment, view_definition, columns in order."""
    column = F.struct("ordinal_position", "column_name", "data_type", (F.upper("is_nullable") == "YES").alias("is_nullable"), "column_comment")
    grouped = rows.groupBy("database_name", "object_name", "object_kind", "comment", "view_definition").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    name = F.lower(F.concat_ws(".", "database_name", "object_name"))
    key = object_key(F.when(F.col("object_kind") == "view", "table_view").otherwise("data_table"), name)
    return grouped.select(key.alias("key"), F.col("database_name").alias("database"), F.col("object_name").alias("object"), F.col("object_kind").alias("kind"), "comment", "view_definition", "columns")


def view_lineage(objects: DataFrame) -> DataFrame:
    """(key, status, reads, error) of views with a definition; without a table to read, the status is failed."""
    found = objects.where("kind = 'view' and coalesce(trim(view_definition), '') <> ''").withColumn("t", extract_tables("view_definition"))
    ok = F.size("t.reads") > 0
    return found.select("key", F.when(ok, "parsed").otherwise("failed").alias("status"), "t.reads", F.when(~ok, F.coalesce("t.error", F.lit("No table in the view's definition"))).alias("error"))


def view_facts(objects: DataFrame) -> DataFrame:
    """(edge_type, actor, object): a view reads its tables and writes itself."""
    lineage = view_lineage(objects).where("status = 'parsed'")
    reads = lineage.select(F.lit("READS").alias("edge_type"), F.col("key").alias("actor"), F.explode("reads").alias("name")).select("edge_type", "actor", F.concat(F.lit("table:"), F.lower("name")).alias("object"))
    return reads.unionByName(lineage.select(F.lit("WRITES").alias("edge_type"), F.col("key").alias("actor"), F.col("key").alias("object")))
