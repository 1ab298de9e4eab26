"""Nodes, edges and the relational queries over them.

nodes: (key, type, name, object_type); edges: (type, src, dst, is_derived), where src of READS, WRITES and CALLS is the actor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.sqltext import normalize_name, object_key
from tracewell.operators.checkpoints import keep

#: Node types that searches and flows treat as tables.
TABLE_TYPES = ("table", "data_object")
SEARCHED_TYPES = ("table", "data_object", "api_endpoint")
#: Labels of object types; others have the first's.
TYPE_LABELS = {"data_table": "Table", "table_view": "View", "source_table": "Source table", "source_file": "Source file", "api_endpoint": "API endpoint"}


def nodes_of(objects: DataFrame) -> DataFrame:
    """One node for each key of objects (seq, type, key, name, object_type): the first by seq gives name and type."""
    first = objects.groupBy("key").agg(F.min_by(F.struct("type", "name"), "seq").alias("first"), F.max_by("object_type", "seq").alias("object_type"))
    return first.select("key", "first.type", "first.name", "object_type")


def edges_of(facts: DataFrame) -> DataFrame:
    """Distinct edges of facts (type, src, dst, is_derived)."""
    return facts.select("type", "src", "dst", "is_derived").distinct()


def derived_edges(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLOWS_TO edges whose ends are both known."""
    known = nodes.select("key")
    kept = flows.join(known.withColumnRenamed("key", "src"), "src", "left_semi").join(known.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return kept.select(F.lit("FLOWS_TO").alias("type"), "src", "dst", F.lit(True).alias("is_derived"))


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Tables and endpoints whose key or name has `query` in it, whatever the case; % and _ are wildcards."""
    pattern = f"%{query}%"
    return nodes.where(F.col("type").isin(*SEARCHED_TYPES)).where(F.col("key").ilike(pattern) | F.col("name").ilike(pattern)).orderBy("name", "key")


def list_jobs(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'job'").orderBy("name", "key")


def lookup(nodes: DataFrame, focus: DataFrame, *types: str) -> DataFrame:
    """Nodes of some types (without: those that searches treat as tables) whose keys are in focus (key), a few keys."""
    return nodes.where(F.col("type").isin(*(types or SEARCHED_TYPES))).join(F.broadcast(focus), "key", "left_semi")


def endpoints_of(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(table, key, name): endpoints that read or write what is in focus (key), once for each such edge."""
    near = edges.where("type in ('READS', 'WRITES')").join(F.broadcast(focus.withColumnRenamed("key", "dst")), "dst")
    own = nodes.where("type = 'api_endpoint'").select(F.col("key").alias("src"), "name")
    return near.join(own, "src").select(F.col("dst").alias("table"), F.col("src").alias("key"), "name")


#: Related objects by the beginning of their keys.
RELATED = {"job": "jobs", "java_module": "java_modules", "api": "api_endpoints", "transformation": "transformations"}


def object_lineage(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """One row for each key in focus (key), a few keys: found, upstream, downstream, and a list for each kind of RELATED.

    Lists hold keys in the order of name and key. Downstream of a table are also endpoints that read or write it, once an
    edge. An endpoint has what it touches downstream and nothing else. A key that no table or endpoint has gets empty lists.
    """
    known = lookup(nodes, focus).select("key", (F.col("type") == "api_endpoint").alias("is_endpoint"))
    named = nodes.select("key", "name")
    ends = edges.select("type", "src", "dst")
    touches = ends.where("type in ('READS', 'WRITES')")
    table, endpoint = known.where("not is_endpoint").select("key"), known.where("is_endpoint").select("key")
    at = lambda df, key, kind, other: df.join(F.broadcast(key.withColumnRenamed("key", "focus")), F.col("focus") == F.col(kind)).select("focus", F.col(other).alias("key"))
    flows = ends.where("type = 'FLOWS_TO'")
    actors = related_actors(edges, table).select(F.col("table").alias("focus"), F.col("actor").alias("key"))
    parts = [
        at(flows, table, "dst", "src").withColumn("part", F.lit("upstream")),
        at(flows, table, "src", "dst").withColumn("part", F.lit("downstream")),
        endpoints_of(nodes, edges, table).select(F.col("table").alias("focus"), "key").withColumn("part", F.lit("downstream")),
        at(touches, endpoint, "src", "dst").withColumn("part", F.lit("downstream")),
        actors.withColumn("part", F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATED.items() for x in kv]), F.substring_index("key", ":", 1))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    listed = every.join(named, "key").groupBy("focus").pivot("part", ["upstream", "downstream", *RELATED.values()]).agg(F.array_sort(F.collect_list(F.struct("name", "key"))))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.transform(c, lambda x: x["key"]), empty).alias(c) for c in ("upstream", "downstream", *RELATED.values())]
    return focus.join(known, "key", "left").join(listed, focus["key"] == listed["focus"], "left").select("key", F.col("is_endpoint").isNotNull().alias("found"), *lists)


def list_objects(nodes: DataFrame, object_type: str, text: str) -> DataFrame:
    """Nodes of one object type (data_table where there is none) with `text` in their names, whatever the case."""
    return nodes.where(F.coalesce("object_type", F.lit("data_table")) == object_type).where(F.contains(F.lower("name"), F.lit(text.strip().lower()))).orderBy("name", "key")


def type_label(object_type: Column) -> Column:
    pairs = [x for k, v in TYPE_LABELS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), object_type), F.lit(TYPE_LABELS["data_table"]))


def overview_counts(nodes: DataFrame) -> DataFrame:
    """(object_type, n) of all nodes, and a row `total`."""
    each = nodes.groupBy(F.coalesce("object_type", F.lit("data_table")).alias("object_type")).agg(F.count("*").alias("n"))
    return each.unionByName(nodes.agg(F.count("*").alias("n")).select(F.lit("total").alias("object_type"), "n"))


def describe(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """nodes with display_name (the comment if there is one, else the name), object_type and column_count."""
    known = metadata.select("key", "comment", F.size("columns").alias("column_count"))
    return nodes.join(known, "key", "left").select("key", "type", "name", F.coalesce(F.nullif(F.col("comment"), F.lit("")), F.col("name")).alias("display_name"), F.coalesce("object_type", F.lit("data_table")).alias("object_type"), F.coalesce("column_count", F.lit(0)).cast("long").alias("column_count"))


def actor_tables(edges: DataFrame) -> DataFrame:
    """(actor, object): what an actor reads or writes itself, and what those it calls do."""
    touched = edges.where("type in ('READS', 'WRITES')").select(F.col("src").alias("actor"), F.col("dst").alias("object"))
    called = edges.where("type = 'CALLS'").select(F.col("src").alias("caller"), F.col("dst").alias("actor"))
    return touched.unionByName(called.join(touched, "actor").select(F.col("caller").alias("actor"), "object")).distinct()


def related_actors(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(table, actor, related): actors that touch a table in focus (key), a few keys, themselves or through a call, each once,
    with all the tables they touch, sorted and joined by commas. What other actors touch isn't looked at."""
    touched = edges.where("type in ('READS', 'WRITES')").select(F.col("src").alias("actor"), F.col("dst").alias("object"))
    called = edges.where("type = 'CALLS'").select(F.col("src").alias("caller"), F.col("dst").alias("actor"))
    direct = keep(touched.join(F.broadcast(focus.withColumnRenamed("key", "object")), "object").select(F.col("object").alias("table"), "actor").distinct())
    near = keep(direct.unionByName(called.join(direct, "actor").select("table", F.col("caller").alias("actor"))).distinct())
    actors = near.select("actor").distinct()
    theirs = touched.join(actors, "actor", "left_semi")
    through = called.join(actors.withColumnRenamed("actor", "caller"), "caller", "left_semi").join(touched, "actor").select(F.col("caller").alias("actor"), "object")
    return near.join(theirs.unionByName(through).distinct(), "actor").groupBy("table", "actor").agg(F.array_join(F.array_sort(F.collect_set("object")), ",").alias("related"))


def called_objects(edges: DataFrame) -> DataFrame:
    """(job, object): distinct objects of what a job calls, without those of the job itself."""
    touched = edges.where("type in ('READS', 'WRITES')").select(F.col("src").alias("callee"), F.col("dst").alias("object"))
    return edges.where("type = 'CALLS'").select(F.col("src").alias("job"), F.col("dst").alias("callee")).join(touched, "callee").select("job", "object").distinct()


def module_tables(edges: DataFrame) -> DataFrame:
    """(actor, reads, writes): an actor's sorted tables, joined by commas."""
    sets = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("dst")))), ",")
    return edges.where("type in ('READS', 'WRITES')").groupBy(F.col("src").alias("actor")).agg(sets("READS").alias("reads"), sets("WRITES").alias("writes"))


def aliases(metadata: DataFrame) -> DataFrame:
    """(alias, key) of metadata (database, object, key): the qualified name, and the bare one if only one object has it."""
    qualified = metadata.select(F.lower(F.concat_ws(".", "database", "object")).alias("alias"), "key")
    bare = metadata.groupBy(F.lower("object").alias("alias")).agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("alias", "key")
    return qualified.unionByName(bare.join(qualified.select("alias"), "alias", "left_anti"))


def resolve(references: DataFrame, metadata: DataFrame) -> DataFrame:
    """references (name, object_type) with key: by alias for data tables, else from type and name."""
    known = aliases(metadata).withColumnRenamed("key", "alias_key")
    named = references.withColumn("alias", normalize_name("name"))
    found = named.join(known, (named["alias"] == known["alias"]) & (named["object_type"] == "data_table"), "left").drop(known["alias"])
    return found.withColumn("key", F.coalesce("alias_key", object_key("object_type", "alias"))).drop("alias", "alias_key")


def reoriented(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) for drawing: an endpoint is always the target."""
    swap = F.col("src").startswith("api:") & ~F.col("dst").startswith("api:")
    return edges.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("source"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("target")).distinct()
