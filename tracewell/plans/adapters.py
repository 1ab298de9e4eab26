"""Views of plain tables as lineage facts: projections only, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.sqltext import actor_scope
from tracewell.operators.checkpoints import keep
from tracewell.operators.graph import table_flows


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as actors that read or write parts."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.when(F.col("l_linestatus") == "O", "READS").otherwise("WRITES").alias("edge_type"),
        F.concat(F.lit("job_"), "l_orderkey", F.lit("::line_"), "l_linenumber").alias("actor"),
        F.concat(F.lit("table:part_"), "l_partkey").alias("object"),
        F.col("l_suppkey").alias("supplier"),
    )


def coarse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a hundred groups of parts, so that some read what they write."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.when(F.col("l_linestatus") == "O", "READS").otherwise("WRITES").alias("edge_type"), F.concat(F.lit("job_"), "l_orderkey").alias("actor"), F.concat(F.lit("table:group_"), F.col("l_partkey") % 100).alias("object"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order flow into the next one, and back for lines of even parts: cycles are runs of lines."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    own, last = F.concat_ws("_", F.lit("line"), "l_orderkey", "l_linenumber"), F.concat_ws("_", F.lit("line"), "l_orderkey", F.col("l_linenumber") - 1)
    side = lambda kind, scope, name: F.struct(F.lit(kind).alias("edge_type"), F.concat(F.lit(scope), own).alias("actor"), name.alias("object"))
    back = F.when(F.col("l_partkey") % 2 == 0, F.array(side("READS", "back_", own), side("WRITES", "back_", last))).otherwise(F.array())
    return lines.select(F.inline(F.concat(F.array(side("READS", "go_", last), side("WRITES", "go_", own)), back)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' jobs call orders' transformations, which read and write parts."""
    f = facts(spark, sf_dir)
    touched = f.select(F.col("edge_type").alias("type"), F.concat(F.lit("transformation:"), F.substring_index("actor", "::", 1)).alias("src"), F.col("object").alias("dst"))
    orders = read(spark, sf_dir, "orders").select(F.lit("CALLS").alias("type"), F.concat(F.lit("job:customer_"), "o_custkey").alias("src"), F.concat(F.lit("transformation:job_"), "o_orderkey").alias("dst"))
    return touched.unionByName(orders).withColumn("is_derived", F.lit(False)).distinct()


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) from regions by way of nations, customers, suppliers and orders to parts: a graph without cycles."""
    pairs = (("nation", "region_", "n_regionkey", "nation_", "n_nationkey"), ("customer", "nation_", "c_nationkey", "customer_", "c_custkey"), ("supplier", "nation_", "s_nationkey", "supplier_", "s_suppkey"), ("orders", "customer_", "o_custkey", "order_", "o_orderkey"), ("lineitem", "order_", "l_orderkey", "part_", "l_partkey"), ("lineitem", "supplier_", "l_suppkey", "part_", "l_partkey"))
    out = None
    for table, a, src, b, dst in pairs:
        one = read(spark, sf_dir, table).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))
        out = one if out is None else out.unionByName(one)
    return out


def supplier_of() -> Column:
    """The endpoint that stands for a line's supplier."""
    return F.concat(F.lit("api:GET /s/"), "supplier").alias("endpoint")


def lineage_graph(spark: SparkSession, sf_dir: str, around: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customers' jobs, orders' transformations, parts, suppliers' endpoints, and flows between parts.

    With around (key), a few keys, flows are those of scopes that touch one of them, and both tables are written down. All
    flows from or to those keys are among them; nodes and other edges are the same.
    """
    own = edges(spark, sf_dir)
    f = facts(spark, sf_dir)
    api = f.select(F.col("edge_type").alias("type"), supplier_of().alias("src"), F.col("object").alias("dst")).distinct()
    near = f
    if around is not None:
        scopes = keep(f.join(F.broadcast(around.withColumnRenamed("key", "object")), "object", "left_semi").select(actor_scope("actor").alias("scope")).distinct())
        near = f.withColumn("scope", actor_scope("actor")).join(scopes, "scope", "left_semi")
    flows = table_flows(near).select(F.lit("FLOWS_TO").alias("type"), "src", "dst")
    every = own.unionByName(api.withColumn("is_derived", F.lit(False))).unionByName(flows.withColumn("is_derived", F.lit(True)))
    if around is not None:
        every = keep(every)
    keys = every.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    prefix = F.substring_index("key", ":", 1)
    kind = F.when(prefix == "table", "data_object").when(prefix == "api", "api_endpoint").otherwise(prefix)
    found = keys.select("key", kind.alias("type"), F.expr("substring(key, instr(key, ':') + 1)").alias("name"), F.lit(None).cast("string").alias("object_type"))
    return found if around is None else keep(found), every


def busiest(flows: DataFrame) -> DataFrame:
    """(key) with most flows out; of equals the first by name."""
    return flows.groupBy(F.col("src").alias("key")).count().orderBy(F.desc("count"), "key").limit(1).select("key")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of nations, regions, suppliers and customers, each with a kind of object."""
    kinds = (("nation", "n_name", "table_view"), ("region", "r_name", "source_file"), ("supplier", "s_name", "source_table"), ("customer", "c_name", None))
    out = None
    for table, name, kind in kinds:
        one = read(spark, sf_dir, table).select(F.concat(F.lit(f"{table}:"), F.lower(name)).alias("key"), F.lit("api_endpoint" if table == "region" else "data_object").alias("type"), F.col(name).alias("name"), F.lit(kind).cast("string").alias("object_type"))
        out = one if out is None else out.unionByName(one)
    return out


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as failures of the day's run."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    kind = F.when(F.col("user_id") % 3 == 0, "kettle").when(F.col("user_id") % 3 == 1, "java").otherwise("metadata")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), kind.alias("source_type"), F.concat(F.lit("user_"), "user_id").alias("file_path"), F.col("props").alias("message"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).groupBy("run_id").agg(F.count("*").alias("n_events")).withColumn("created_at", F.to_timestamp_ntz("run_id", F.lit("yyyy-MM-dd")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects of brands' databases, with three columns each."""
    columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.lit(k).alias("ordinal_position"), F.lit(y).alias("is_nullable")) for k, n, t, y in ((2, "name", "varchar", "YES"), (1, "id", "bigint", "NO"), (3, "price", "double", "YES"))])
    part = read(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.lit("_"), "p_size").alias("object_name"), "p_size").groupBy("p_brand", "object_name").agg(F.min("p_size").alias("size"))
    view = F.col("size") % 10 == 0
    rows = part.select(F.col("p_brand").alias("database_name"), "object_name", F.when(view, "view").otherwise("table").alias("object_kind"), F.lit("").alias("comment"), F.when(view, F.concat(F.lit("select * from ods.base_"), "size", F.lit(" b join dim.d_"), F.col("size") % 7, F.lit(" d on b.id = d.id"))).alias("view_definition"), F.explode(columns).alias("c"))
    return rows.select("database_name", "object_name", "object_kind", "comment", "view_definition", "c.*", F.lit("").alias("column_comment"))


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, sql): statements with comments, placeholders, common tables and broken ends, by customer."""
    c = read(spark, sf_dir, "customer")
    key, seg, nation = F.col("c_custkey"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        text("insert into dm.seg_", seg, " select * from ods.nation_", nation, " -- from x.y\nwhere 1 = 1"),
        text("with a as (select * from ods.n_", nation, "), b as (select * from a) select * from b join dim.s_", seg, " s on s.id = b.id"),
        text("update dm.seg_", seg, " set flag = 'from a.b' where id in (select id from ods.nation_", nation, ")"),
        text("delete from dm.seg_", seg, " where note = 'it''s -- fine'"),
        text("SELECT * FROM ods.nation_", nation, " t /* join\n z.z */ WHERE AND t.name like '%' || 0 || '%' and t.id in 0 )  and 1 = 1"),
        text("select * from ods.nation_", nation, " where id in ("),
    ]
    sql = F.element_at(F.array(*shapes), (key % 6 + 1).cast("int"))
    return c.select(key.alias("custkey"), sql.alias("sql"))
