"""Java sources and mapper XML: modules, methods, statements, calls and endpoints as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import javatext as J
from tracewell.functions.sqltext import extract_tables, mapper_sql, xml_sql
from tracewell.sources.files import read_whole


def read_texts(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(path, module, text) of files below roots; each file once, whatever links lead to it. The module is the file's name
    without its ending."""
    return with_module(read_whole(spark, roots, pattern))


def with_module(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("module"), "text")


def outlined(files: DataFrame) -> DataFrame:
    """files with a struct `o`, see javatext.outline; those that have it stay as they are, so one pass serves all tables."""
    return files if "o" in files.columns else files.withColumn("o", J.outline("text"))


def modules(files: DataFrame) -> DataFrame:
    """(module, kind, extended, implemented, table_name, mapper_entity, service_mapper); of one name the last path counts."""
    last = outlined(files).groupBy("module").agg(F.max_by("o", "path").alias("o"))
    names = F.array_distinct(F.filter(F.transform("o.implemented", J.type_name), lambda x: x != ""))
    kind = F.when(F.col("o.kind").isin("class", "interface"), F.col("o.kind"))
    return last.select("module", kind.alias("kind"), F.get("o.extended", F.lit(0)).alias("extended"), names.alias("implemented"), J.entity_table("o.annotations").alias("table_name"), J.mapper_entity("o.extended").alias("mapper_entity"), J.service_mapper("o.extended").alias("service_mapper"))


def methods(files: DataFrame) -> DataFrame:
    """(path, module, method, body, annotations, start); annotations have names and args."""
    each = outlined(files).select("path", "module", F.explode("o.methods").alias("m"))
    return each.select("path", "module", F.col("m.name").alias("method"), "m.body", "m.annotations", "m.start")


def fields(files: DataFrame) -> DataFrame:
    """(module, receiver, declared): fields of types, not what methods declare; the last of a name counts."""
    each = outlined(files).select("module", F.posexplode("o.fields").alias("at", "f"))
    return each.groupBy("module", F.col("f.receiver").alias("receiver")).agg(F.max_by("f.declared", "at").alias("declared"))


def xml_statements(mappers: DataFrame) -> DataFrame:
    """(module, folder, id, body) of the statements in mapper files, each up to its own closing tag."""
    whole = F.regexp_replace("text", r"(?s)<!--.*?-->", " ")
    tag = r"(?is)<(select|insert|update|delete)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</\1\s*>"
    pairs = F.arrays_zip(*[F.regexp_extract_all(whole, F.lit(tag), F.lit(k)).alias(n) for k, n in ((2, "attributes"), (3, "body"))])
    each = mappers.select("module", "path", F.explode(pairs).alias("s"))
    return each.select("module", "path", F.regexp_extract("s.attributes", r"\bid\s*=\s*[\"']([^\"']+)", 1).alias("id"), "s.body").where("id <> ''")


def statements(files: DataFrame, mappers: DataFrame | None = None) -> DataFrame:
    """(path, module, method, sql, tables) of literals in bodies, mapper annotations, and mapper XML.

    XML belongs to the module of the same name next to it, else to that in resources/mapper; a statement's id is its method.
    Text outside of methods isn't used.
    """
    m = methods(files)
    body = m.select("path", "module", "method", F.explode(J.sql_literals("body")).alias("sql"))
    marked = m.select("path", "module", "method", F.explode(F.filter("annotations", lambda a: a["name"].isin("Select", "Insert", "Update", "Delete"))).alias("a"))
    literals = F.filter(F.transform(J.string_literals("a.args"), J.trimmed), lambda x: x != "")
    annotated = marked.select("path", "module", "method", mapper_sql(F.array_join(literals, " ")).alias("sql"))
    found = body.unionByName(annotated.where("sql <> ''"))
    if mappers is not None:
        folder = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
        xml = xml_statements(mappers).withColumn("at", folder("path"))
        xml = xml.select("module", F.regexp_replace("at", r"/resources/mapper$", "").alias("folder"), F.when(F.col("at").endswith("/resources/mapper"), 2).otherwise(1).alias("rank"), F.col("id").alias("method"), xml_sql("body").alias("sql"))
        near = files.select("path", "module", folder("path").alias("folder")).join(xml, ["module", "folder"])
        first = near.groupBy("path").agg(F.min("rank").alias("rank"))  # the file next to it hides the other
        found = found.unionByName(near.join(first, ["path", "rank"]).where("sql <> ''").select("path", "module", "method", "sql"))
    return found.withColumn("tables", extract_tables("sql"))


def sql_failures(found: DataFrame) -> DataFrame:
    bad = found.where("tables.error is not null")
    return bad.select(F.lit("java").alias("source_type"), F.col("path").alias("file_path"), F.lit("sql_parse_error").alias("failure_type"), F.col("tables.error").alias("message"), F.concat(F.lit("java_module:"), "module", F.lit("#"), "method").alias("object_key"), F.col("sql").alias("sql_snippet"))


def method_calls(files: DataFrame) -> DataFrame:
    """(module, method, call), distinct; of methods with one name the last one's."""
    last = methods(files).groupBy("module", "method").agg(F.max_by("body", F.struct("path", "start")).alias("body"))
    return last.select("module", "method", F.explode(J.calls("body")).alias("call"))


def endpoints(files: DataFrame) -> DataFrame:
    """(endpoint, http_method, route, module, method) of controllers' mapped methods; the first mapping of a method counts."""
    o = outlined(files).select("path", "module", "o.annotations", "o.methods").where(F.exists("annotations", lambda a: a["name"].isin("RestController", "Controller")))
    base = J.route_literal(F.try_element_at(F.filter("annotations", lambda a: a["name"] == "RequestMapping"), F.lit(1))["args"])
    each = o.select("module", F.coalesce(base, F.lit("")).alias("base"), F.explode("methods").alias("m")).select("module", "base", F.col("m.name").alias("method"), F.col("m.start").alias("start"), F.posexplode("m.annotations").alias("at", "a"))
    each = each.select("*", J.http_verb("a.name", "a.args").alias("http_method"), J.join_path("base", J.route_literal("a.args")).alias("route")).where("http_method is not null")
    first = each.groupBy("module", "method", "start").agg(F.min_by(F.struct("http_method", "route"), "at").alias("e"))
    return first.select(F.concat_ws("", F.lit("api:"), "e.http_method", F.lit(" "), "e.route").alias("endpoint"), "e.http_method", "e.route", "module", "method")
