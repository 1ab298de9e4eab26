"""A scan: sources in, graph tables out."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.sqltext import object_key
from tracewell.operators import calls as C
from tracewell.operators import graph, lineage
from tracewell.operators.checkpoints import cut, spread
from tracewell.sources import java, kettle, metadata

FAILURE = "run_id string, source_type string, file_path string, failure_type string, message string, object_key string, sql_snippet string"
RUN = "run_id string, status string, inputs map<string,string>, created_at timestamp, started_at timestamp, finished_at timestamp"


@dataclass
class Scan:
    """nodes (key, type, name, object_type), edges (type, src, dst, is_derived), flows (src, dst), facts, failures, run,
    endpoints, and metadata (key, database, object, kind, comment, view_definition, columns, view_status, view_error)."""

    nodes: DataFrame
    edges: DataFrame
    flows: DataFrame
    facts: DataFrame
    failures: DataFrame
    run: DataFrame
    endpoints: DataFrame | None = None
    metadata: DataFrame | None = None

    def save(self, folder: str, merge: bool = False) -> None:
        """Puts the graph in place of the one in folder, or merges it into that; runs and failures are added.

        All tables are written first, beside the old ones; then a manifest of one line is swapped, which load() reads. So a
        scan that ends half-way leaves the old graph whole, and none leaves tables of another scan behind. The graph before
        stays until the next one is saved. Of nodes with one key the stored one keeps its name and type.
        """
        spark = self.nodes.sparkSession
        old = current_version(spark, folder)
        new = self if not merge or old is None else merged(load(spark, folder), self)
        version = uuid.uuid4().hex
        for name, schema in TABLES.items():
            table = getattr(new, name)
            (spark.createDataFrame([], schema) if table is None else table).write.parquet(f"{folder}/graphs/{version}/{name}")
        self.failures.write.mode("append").parquet(f"{folder}/failures")
        self.run.write.mode("append").parquet(f"{folder}/runs")
        _swap_manifest(spark, folder, version)
        for other in _versions(spark, folder) - {version, old}:
            path = _path(spark, f"{folder}/graphs/{other}")
            _filesystem(spark, path).delete(path, True)


COLUMN = "array<struct<ordinal_position:int,column_name:string,data_type:string,is_nullable:boolean,column_comment:string>>"
#: Tables of a stored graph.
TABLES = {
    "nodes": "key string, type string, name string, object_type string",
    "edges": "type string, src string, dst string, is_derived boolean",
    "flows": "src string, dst string",
    "facts": "edge_type string, actor string, object string",
    "metadata": f"key string, database string, object string, kind string, comment string, view_definition string, columns {COLUMN}, view_status string, view_error string",
}


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version of the graph that folder's manifest names."""
    path = _path(spark, f"{folder}/current")
    if not _filesystem(spark, path).exists(path):
        return None
    return spark.read.text(f"{folder}/current").first()[0]


def _versions(spark: SparkSession, folder: str) -> set[str]:
    path = _path(spark, f"{folder}/graphs")
    return {f.getPath().getName() for f in _filesystem(spark, path).listStatus(path)}


def _swap_manifest(spark: SparkSession, folder: str, version: str) -> None:
    jvm, draft, final = spark.sparkContext._jvm, _path(spark, f"{folder}/.current-{version}"), _path(spark, f"{folder}/current")
    stream = _filesystem(spark, draft).create(draft, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = _filesystem(spark, final)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(where.makeQualified(draft), where.makeQualified(final), options)


def load(spark: SparkSession, folder: str) -> Scan:
    """The graph stored in folder, with all its failures and runs; endpoints aren't stored."""
    at = f"{folder}/graphs/{current_version(spark, folder)}"
    tables = {name: spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in TABLES.items()}
    return Scan(**tables, failures=spark.read.parquet(f"{folder}/failures"), run=spark.read.parquet(f"{folder}/runs"))


def merged(stored: Scan, new: Scan) -> Scan:
    """Both graphs as one: stored nodes keep their names and types, known object types are the newer ones; flows of scopes
    that both have facts of are derived anew."""
    named = stored.nodes.select(F.lit(0).alias("seq"), "type", "key", "name", "object_type").unionByName(new.nodes.select(F.lit(1).alias("seq"), "type", "key", "name", "object_type"))
    nodes = cut(lineage.nodes_of(named.where("object_type is not null").unionByName(named.where("object_type is null"))))
    facts = cut(stored.facts.unionByName(new.facts).distinct())
    flows = cut(graph.table_flows(facts))
    plain = stored.edges.where("not is_derived").unionByName(new.edges.where("not is_derived"))
    edges = cut(lineage.edges_of(plain.unionByName(lineage.derived_edges(flows, nodes))))
    known = stored.metadata
    if new.metadata is not None:
        known = new.metadata.unionByName(known.join(new.metadata.select("key"), "key", "left_anti"))
    return Scan(nodes, edges, flows, facts, new.failures, new.run, new.endpoints, cut(known))


def input_values(values: list[str] | None, single: str | None) -> list[str]:
    """A list and a single value as one list, trimmed, in order, each once."""
    every = [v.strip() for v in [*(values or []), single or ""]]
    return list(dict.fromkeys(v for v in every if v))


def form_text(values: list[str] | None, single: str | None) -> str:
    """Inputs as a form shows them: the list between commas, else the single value, else nothing."""
    return ", ".join(values) if values else single or ""


def split_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def resolve_path(value: str, base: str = ".") -> str:
    """An input path: escaped blanks undone, relative ones below base, urls as they are."""
    path = value.strip().replace("\\ ", " ")
    if re.match(r"\w+:/", path):
        return path
    path = path if os.path.isabs(path) else os.path.join(base, path)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such input: {value}")
    return path


def _object_facts(refs: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """refs (edge_type, actor, name, object_type) with their objects' keys."""
    if catalogue is None:
        named = refs.withColumn("key", object_key("object_type", F.lower(F.trim("name"))))
    else:
        named = lineage.resolve(refs, catalogue.select("database", "object", "key"))
    return named.select("edge_type", "actor", F.col("key").alias("object"), F.lower(F.trim("name")).alias("name"), "object_type")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass
class Program:
    """Java sources: statements found, calls made, which resolve to what, and each method's tables (facts)."""

    found: DataFrame
    modules: DataFrame
    made: DataFrame
    has: DataFrame
    resolved: DataFrame
    facts: DataFrame
    routes: DataFrame
    endpoints: DataFrame


def program(sources: DataFrame, mappers: DataFrame | None = None) -> Program:
    """Of sources and mappers (path, text)."""
    files = cut(java.outlined(java.with_module(spread(sources))).drop("text"))
    found = cut(java.statements(files, None if mappers is None else java.with_module(mappers)))
    modules, fields, made = cut(java.modules(files)), cut(java.fields(files)), cut(java.method_calls(files))
    direct = found.select("module", "method", F.explode(F.concat(F.transform("tables.reads", lambda x: F.struct(F.lit("READS").alias("e"), x.alias("n"))), F.transform("tables.writes", lambda x: F.struct(F.lit("WRITES").alias("e"), x.alias("n"))))).alias("x")).select("module", "method", F.col("x.e").alias("edge_type"), F.col("x.n").alias("name")).distinct()
    has = java.methods(files).select("module", "method").unionByName(found.select("module", "method")).distinct()
    has = has.join(found.select("module", "method", F.lit(True).alias("s")).distinct(), ["module", "method"], "left").join(made.select("module", "method", F.lit(True).alias("c")).distinct(), ["module", "method"], "left")
    has = cut(has.select("module", "method", F.coalesce("s", F.lit(False)).alias("has_sql"), F.coalesce("c", F.lit(False)).alias("has_calls")))
    resolved = cut(C.resolve_calls(made, modules, fields, has))
    facts = C.reduce_tables(resolved, direct, modules)
    routes = cut(java.endpoints(files))
    visited = facts.join(has.select("module", "method"), ["module", "method"], "left_semi")
    diagnosed = C.endpoint_diagnostics(routes, made, resolved, C.unresolved(made, resolved, modules, fields, has), visited)
    return Program(found, modules, made, has, resolved, facts, routes, diagnosed)


def scan(spark: SparkSession, exports: DataFrame | None = None, sources: DataFrame | None = None, mappers: DataFrame | None = None, catalogue: DataFrame | None = None, inputs: dict[str, str] | None = None) -> Scan:
    """exports, sources and mappers are files (path, text); catalogue are rows for `metadata_objects`.

    A broken file or statement is a failure row and ends nothing else.
    """
    run_id, began = uuid.uuid4().hex, datetime.now(timezone.utc)
    ref = "edge_type string, actor string, name string, object_type string"
    refs, called = _empty(spark, ref), _empty(spark, "src string, dst string")
    named = _empty(spark, "seq int, type string, key string, name string, object_type string")
    failures = _empty(spark, FAILURE.split(", ", 1)[1])
    extra = _empty(spark, "edge_type string, actor string, object string")
    actor_edges = _empty(spark, "type string, src string, dst string")
    objects = endpoints = known_metadata = None
    kind = F.lit(None).cast("string")

    if catalogue is not None:
        objects = cut(metadata.metadata_objects(catalogue))
        views = metadata.view_lineage(objects)
        told = views.select("key", F.col("status").alias("view_status"), F.col("error").alias("view_error"))
        known_metadata = cut(objects.join(told, "key", "left").withColumn("view_status", F.coalesce("view_status", F.lit("not_applicable"))))
        extra = extra.unionByName(metadata.view_facts(objects))
        named = named.unionByName(objects.select(F.lit(0).alias("seq"), F.lit("data_object").alias("type"), "key", F.lower(F.concat_ws(".", "database", "object")).alias("name"), F.when(F.col("kind") == "view", "table_view").otherwise("data_table").alias("object_type")))
        failures = failures.unionByName(views.where("status = 'failed'").select(F.lit("metadata").alias("source_type"), F.lit("metadata").alias("file_path"), F.lit("view_definition_parse_error").alias("failure_type"), F.col("error").alias("message"), F.col("key").alias("object_key"), F.lit(None).cast("string").alias("sql_snippet")))

    if exports is not None:
        parsed = cut(kettle.parse_exports(spread(exports)))
        read = cut(kettle.sql_steps(parsed)), cut(kettle.job_statements(parsed))
        step, job, call = cut(kettle.step_facts(read[0])), cut(kettle.job_facts(read[1])), kettle.calls(parsed)
        refs = refs.unionByName(step).unionByName(job)
        called = called.unionByName(call.select(F.concat(F.lit("job:"), "job").alias("src"), F.concat(F.lit("transformation:"), "transformation").alias("dst")).distinct())
        names = kettle.jobs(parsed).select(F.lit("job").alias("type"), F.col("job").alias("name")).unionByName(kettle.steps(parsed).select(F.lit("transformation").alias("type"), F.col("transformation").alias("name"))).unionByName(call.select(F.lit("transformation").alias("type"), F.col("transformation").alias("name")))
        named = named.unionByName(names.distinct().select(F.lit(1).alias("seq"), "type", F.concat_ws(":", "type", "name").alias("key"), "name", kind.alias("object_type")))
        owner = lambda prefix, facts: facts.select(F.col("edge_type").alias("type"), F.concat(F.lit(prefix), F.substring_index("actor", "::", 1)).alias("src"), "name", "object_type")
        actor_refs = owner("transformation:", step).unionByName(owner("job:", job))
        failures = failures.unionByName(kettle.file_failures(parsed)).unionByName(kettle.sql_failures(*read))
    else:
        actor_refs = _empty(spark, "type string, src string, name string, object_type string")

    if sources is not None:
        code = program(sources, mappers)
        found, modules, routes, endpoints = code.found, code.modules, code.routes, code.endpoints
        visited = code.facts.join(code.has.select("module", "method"), ["module", "method"], "left_semi")
        own = visited.select("edge_type", F.concat(F.lit("java_module:"), "module", F.lit("#"), "method").alias("actor"), "name", F.lit("data_table").alias("object_type"))
        refs = refs.unionByName(own)
        actor_refs = actor_refs.unionByName(visited.select(F.col("edge_type").alias("type"), F.concat(F.lit("java_module:"), "module").alias("src"), "name", F.lit("data_table").alias("object_type")).distinct())
        actor_refs = actor_refs.unionByName(routes.join(visited, ["module", "method"]).select(F.col("edge_type").alias("type"), F.col("endpoint").alias("src"), "name", F.lit("data_table").alias("object_type")).distinct())
        names = modules.select(F.lit("java_module").alias("type"), F.concat(F.lit("java_module:"), "module").alias("key"), F.col("module").alias("name"), kind.alias("object_type")).unionByName(routes.select(F.lit("api_endpoint").alias("type"), F.col("endpoint").alias("key"), F.substring_index("endpoint", "api:", -1).alias("name"), F.lit("api_endpoint").alias("object_type")))
        named = named.unionByName(names.distinct().select(F.lit(1).alias("seq"), "type", "key", "name", "object_type"))
        failures = failures.unionByName(java.sql_failures(found))

    facts = cut(_object_facts(refs, objects))
    touched = cut(_object_facts(actor_refs.withColumnsRenamed({"type": "edge_type", "src": "actor"}), objects))
    actor_edges = touched.select(F.col("edge_type").alias("type"), F.col("actor").alias("src"), F.col("object").alias("dst"))
    known = facts.unionByName(touched).select(F.lit(2).alias("seq"), F.lit("data_object").alias("type"), F.col("object").alias("key"), "name", "object_type").distinct()
    if objects is not None:  # a view's tables become nodes, and bare names resolve
        base = extra.where("edge_type = 'READS'").select(F.lit("READS").alias("edge_type"), "actor", F.substring_index("object", ":", -1).alias("name"), F.lit("data_table").alias("object_type"))
        base = _object_facts(base, objects)
        known = known.unionByName(base.select(F.lit(3).alias("seq"), F.lit("data_object").alias("type"), F.col("object").alias("key"), "name", "object_type"))
        extra = extra.where("edge_type = 'WRITES'").unionByName(base.select("edge_type", "actor", "object"))
    nodes = cut(lineage.nodes_of(named.unionByName(known)))
    every = facts.select("edge_type", "actor", "object").unionByName(extra)
    flows = cut(graph.table_flows(every))
    plain = called.select(F.lit("CALLS").alias("type"), "src", "dst").unionByName(actor_edges)
    edges = cut(lineage.edges_of(plain.withColumn("is_derived", F.lit(False)).unionByName(lineage.derived_edges(flows, nodes))))
    run = spark.createDataFrame([(run_id, "completed", inputs or {}, began, began, datetime.now(timezone.utc))], RUN)
    return Scan(nodes, edges, flows, every, cut(failures.withColumn("run_id", F.lit(run_id))), run, endpoints, known_metadata)


def failed_scan(spark: SparkSession, error: metadata.MetadataConnectionError, dsn: str, inputs: dict[str, str] | None = None) -> Scan:
    """What is left of a scan whose catalogue can't be reached: an empty graph, the failure, and a run that has failed."""
    run_id, now = uuid.uuid4().hex, datetime.now(timezone.utc)
    failure = spark.createDataFrame([(run_id, "metadata", metadata.redacted(dsn), type(error).__name__, metadata.without_secrets(str(error), dsn), None, None)], FAILURE)
    run = spark.createDataFrame([(run_id, "failed", inputs or {}, now, now, now)], RUN)
    schemas = ("key string, type string, name string, object_type string", "type string, src string, dst string, is_derived boolean", "src string, dst string", "edge_type string, actor string, object string")
    return Scan(*(_empty(spark, x) for x in schemas), failure.select("source_type", "file_path", "failure_type", "message", "object_key", "sql_snippet", "run_id"), run)


def scan_paths(spark: SparkSession, repo_paths: list[str] | None = None, java_roots: list[str] | None = None, jdbc_url: str | None = None, databases: list[str] | None = None) -> Scan:
    """A scan of files and folders that Spark can read, and of a catalogue over JDBC.

    Without a list of databases the url's own is read; a url without either is an error. A catalogue that can't be reached
    ends the scan as a failed run.
    """
    request = metadata.metadata_request(jdbc_url, databases)
    inputs = {"repo_paths": ",".join(repo_paths or []), "java_roots": ",".join(java_roots or []), "catalogue": metadata.redacted(jdbc_url) if jdbc_url else ""}
    try:
        catalogue = metadata.read_catalogue(spark, *request) if request else None
    except metadata.MetadataConnectionError as e:
        return failed_scan(spark, e, request[0], inputs)
    exports = kettle.read_exports(spark, [resolve_path(p) for p in repo_paths]) if repo_paths else None
    roots = [resolve_path(p) for p in java_roots or []]
    sources = java.read_texts(spark, roots, "*.java").select("path", "text") if roots else None
    mappers = java.read_texts(spark, roots, "*.xml").select("path", "text") if roots else None
    return scan(spark, exports, sources, mappers, catalogue, inputs)


def scan_to(spark: SparkSession, folder: str, **inputs) -> Scan:
    """scan_paths(**inputs) saved to folder. A run is listed there as running before it begins; see failures.run_states.

    Whatever ends it otherwise, the run is then listed as failed, with a failure, and the graph in folder stays as it was.
    """
    began = datetime.now(timezone.utc)
    run_id = uuid.uuid4().hex
    spark.createDataFrame([(run_id, "running", {}, began, began, None)], RUN).write.mode("append").parquet(f"{folder}/runs")
    try:
        found = scan_paths(spark, **inputs)
        found.run = found.run.withColumns({"run_id": F.lit(run_id), "created_at": F.lit(began), "started_at": F.lit(began)})
        found.failures = found.failures.withColumn("run_id", F.lit(run_id))
        if found.run.where("status = 'failed'").isEmpty():
            found.save(folder)
        else:  # there is no graph, and the stored one stays
            found.failures.write.mode("append").parquet(f"{folder}/failures")
            found.run.write.mode("append").parquet(f"{folder}/runs")
    except Exception as e:
        said = metadata.without_secrets(f"{type(e).__name__}: {e}", inputs.get("jdbc_url") or "-")
        spark.createDataFrame([("scan", "", type(e).__name__, said.splitlines()[0][:1000], None, None, run_id)], f"{FAILURE.split(', ', 1)[1]}, run_id string").write.mode("append").parquet(f"{folder}/failures")
        spark.createDataFrame([(run_id, "failed", {}, began, began, datetime.now(timezone.utc))], RUN).write.mode("append").parquet(f"{folder}/runs")
        raise
    return found
