"""Kettle repository exports: jobs, transformations and steps as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.sqltext import compose_table_name, extract_tables, normalize_name, scoped_key, source_file_name, split_statements, truncate_target
from tracewell.sources.files import read_whole

_STEP = "struct<name:string,type:string,sql:string,schema:string,table:string,table_name:string,file:struct<name:string,filemask:string>,lookup:struct<schema:string,table:string>>"
_ENTRY = "struct<name:string,type:string,transname:string,connection:string,sql:string>"
REPOSITORY = (
    f"jobs struct<job:array<struct<name:string,transformation:array<string>,entries:struct<entry:array<{_ENTRY}>>>>>, "
    f"transformations struct<transformation:array<struct<name:string,info:struct<name:string>,steps:struct<step:array<{_STEP}>>,step:array<{_STEP}>>>>, _bad string"
)


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of whole files; folders are searched for .repo and .xml files. Each file comes once, whatever links
    lead to it."""
    return read_whole(spark, paths, "*.{repo,xml}")


def parse_exports(files: DataFrame) -> DataFrame:
    """files with a struct `repo`; a malformed file has a null one, which `file_failures` lists."""
    return files.withColumn("repo", F.from_xml("text", REPOSITORY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "rowTag": "repository"}))


def file_failures(parsed: DataFrame) -> DataFrame:
    bad = parsed.where("repo is null or repo._bad is not null")
    return bad.select(F.lit("kettle").alias("source_type"), F.col("path").alias("file_path"), F.lit("ParseError").alias("failure_type"), F.lit("The file isn't well-formed XML").alias("message"), F.lit(None).cast("string").alias("object_key"), F.substring("text", 1, 200).alias("sql_snippet"))


def _text(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def jobs(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("repo.jobs.job").alias("j")).select("path", F.trim(F.coalesce("j.name", F.lit("unknown_job"))).alias("job"), F.col("j.transformation").alias("direct"), F.col("j.entries.entry").alias("entries"))


def calls(parsed: DataFrame) -> DataFrame:
    """(job, transformation) of both kinds of references."""
    j = jobs(parsed)
    direct = j.select("job", F.explode("direct").alias("transformation"))
    entry = j.select("job", F.explode("entries").alias("e")).where("trim(e.type) = 'TRANS'").select("job", F.col("e.transname").alias("transformation"))
    return direct.unionByName(entry).select("job", F.trim("transformation").alias("transformation")).where("transformation <> ''")


def steps(parsed: DataFrame) -> DataFrame:
    """Steps of named transformations in either layout: (path, actor, step)."""
    t = parsed.select("path", F.explode("repo.transformations.transformation").alias("t"))
    t = t.select("path", F.trim(F.coalesce("t.name", "t.info.name")).alias("transformation"), F.coalesce(F.when(F.size("t.steps.step") > 0, F.col("t.steps.step")), F.col("t.step")).alias("steps"))
    return t.where("transformation <> ''").select("path", "transformation", F.explode("steps").alias("step")).select("path", "transformation", scoped_key("transformation", F.trim(F.coalesce("step.name", F.lit("")))).alias("actor"), "step")


def sql_steps(parsed: DataFrame) -> DataFrame:
    """steps() with their SQL, kind, and tables t of the SQL."""
    return steps(parsed).withColumn("sql", _text("step.sql")).withColumn("kind", _text("step.type")).withColumn("t", F.when(F.col("sql") != "", extract_tables("sql")))


def step_facts(s: DataFrame) -> DataFrame:
    """(edge_type, actor, name, object_type) of sql_steps()."""
    none = F.array().cast("array<string>")
    own = F.coalesce("t.reads", none)
    field = F.when((F.col("kind") == "TableInput") & (F.size(own) == 0), compose_table_name("step.schema", "step.table"))
    access = F.when((F.col("kind") == "AccessInput") & (F.size(own) == 0), F.nullif(normalize_name(F.coalesce("step.table_name", F.lit(""))), F.lit("")))
    file = F.when(F.col("kind").isin("ExcelInput", "TextFileInput"), source_file_name("step.file.name", "step.file.filemask"))
    kind = F.when(F.col("kind") == "AccessInput", "source_table").otherwise("data_table")
    ref = lambda name, of: F.struct(F.lower(name).alias("name"), of.alias("object_type"))
    reads = F.concat(F.transform(own, lambda x: ref(x, kind)), F.array(ref(field, F.lit("data_table")), ref(access, F.lit("source_table"))), F.array(F.struct(file.alias("name"), F.lit("source_file").alias("object_type"))))
    put = F.when(F.col("kind") == "TableOutput", compose_table_name("step.schema", "step.table")).when(F.col("kind") == "InsertUpdate", compose_table_name("step.lookup.schema", "step.lookup.table"))
    writes = F.concat(F.transform(F.coalesce("t.writes", none), lambda x: ref(x, F.lit("data_table"))), F.array(ref(put, F.lit("data_table"))))
    edge = lambda kind, refs: F.transform(refs, lambda x: F.struct(F.lit(kind).alias("edge_type"), x["name"].alias("name"), x["object_type"].alias("object_type")))
    each = s.select("actor", F.explode(F.concat(edge("READS", reads), edge("WRITES", writes))).alias("r"))
    return each.select("r.edge_type", "actor", "r.name", "r.object_type").where("name is not null").distinct()


def job_statements(parsed: DataFrame) -> DataFrame:
    """(path, actor, sql, t): statements of jobs' SQL entries, with their tables."""
    entries = jobs(parsed).select("path", "job", F.explode("entries").alias("e")).where("trim(e.type) = 'SQL'")
    return entries.select("path", scoped_key("job", F.trim(F.coalesce("e.name", F.lit("")))).alias("actor"), F.explode(split_statements(F.coalesce("e.sql", F.lit("")))).alias("sql")).withColumn("t", extract_tables("sql"))


def job_facts(s: DataFrame) -> DataFrame:
    """(edge_type, actor, name, object_type) of job_statements(); what TRUNCATE names is written, not read."""
    gone = truncate_target("sql")
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("edge_type"), F.lower(x).alias("name")))
    none = F.array().cast("array<string>")
    both = F.concat(named("READS", F.when(gone.isNull(), F.col("t.reads")).otherwise(none)), named("WRITES", F.array_compact(F.concat("t.writes", F.array(gone)))))
    return s.select("actor", F.explode(both).alias("r")).select("r.edge_type", "actor", "r.name", F.lit("data_table").alias("object_type")).distinct()


def sql_failures(steps: DataFrame, statements: DataFrame) -> DataFrame:
    """A failure for each different error of a step, of sql_steps(), and of each of a job entry's statements."""
    step = steps.where("t.error is not null").select("path", F.concat(F.lit("transformation:"), "actor").alias("object_key"), F.col("t.error").alias("message"), "sql")
    job = statements.where("t.error is not null").select("path", F.concat(F.lit("job:"), "actor").alias("object_key"), F.col("t.error").alias("message"), "sql")
    return step.unionByName(job).distinct().select(F.lit("kettle").alias("source_type"), F.col("path").alias("file_path"), F.lit("sql_parse_error").alias("failure_type"), "message", "object_key", F.col("sql").alias("sql_snippet"))
