import pytest
from pyspark.sql import functions as F

from tracewell.functions import javatext
from tracewell.operators import failures, lineage
from tracewell.plans import samples
from tracewell.plans.scan import form_text, input_values, load, scan, scan_paths, scan_to, split_list
from tracewell.sources import java, kettle, metadata
from tracewell.streaming import incremental


def test_kettle_facts(spark):
    p = kettle.parse_exports(samples.exports(spark))
    assert sorted(map(tuple, kettle.calls(p).collect())) == [("nightly", "load_orders"), ("nightly", "publish")]
    step = {tuple(r) for r in kettle.step_facts(kettle.sql_steps(p)).collect()}
    assert ("READS", "load_orders::in", "ods.orders", "data_table") in step
    assert ("WRITES", "load_orders::out", "dm.order_facts", "data_table") in step
    assert ("READS", "load_orders::sheet", "/data/in/orders*.xlsx", "source_file") in step
    assert ("READS", "publish::old", "legacy_orders", "source_table") in step
    assert ("WRITES", "publish::up", "app.board", "data_table") in step
    job = {tuple(r) for r in kettle.job_facts(kettle.job_statements(p)).collect()}
    assert job == {("WRITES", "nightly::clean", "dm.stage", "data_table"), ("WRITES", "nightly::clean", "dm.log", "data_table"), ("READS", "nightly::clean", "ods.audit", "data_table")}
    assert sorted(r.message for r in kettle.sql_failures(kettle.sql_steps(p), kettle.job_statements(p)).collect()) == ["Expected table name", "Unbalanced parentheses"]


def test_malformed_export_is_a_failure(spark):
    files = samples.exports(spark).unionByName(spark.createDataFrame([("/r/bad.repo", "<repository><jobs>")], "path string, text string"))
    p = kettle.parse_exports(files)
    assert [r.file_path for r in kettle.file_failures(p).collect()] == ["/r/bad.repo"]
    assert kettle.calls(p).count() == 2


def test_java_parts(spark):
    files = java.with_module(samples.sources(spark))
    m = {r.module: r for r in java.modules(files).collect()}
    assert m["OrderServiceImpl"].service_mapper == "OrderMapper" and m["OrderServiceImpl"].implemented == ["OrderService"]
    assert m["OrderMapper"].mapper_entity == "OrderEntity" and m["OrderEntity"].table_name == "t_order"
    assert ("OrderController", "orderService", "OrderService") in {tuple(r) for r in java.fields(files).collect()}
    calls = {tuple(r) for r in java.method_calls(files).collect()}
    assert ("OrderServiceImpl", "find", "baseMapper.selectById") in calls and ("OrderController", "put", "helper") in calls
    assert ("OrderController", "put", "if") not in calls
    routes = {(r.endpoint, r.method) for r in java.endpoints(files).collect()}
    assert routes == {("api:GET /api/orders/{id}", "get"), ("api:POST /api/orders/refresh", "refresh"), ("api:PUT /api/orders/put", "put")}


def test_scan(spark):
    rows = spark.createDataFrame(
        [("ods", "orders", "table", "the orders", None, "id", "bigint", 1, "NO", ""), ("dm", "v", "view", None, "select * from orders", "id", "bigint", 1, "YES", ""), ("dm", "w", "view", None, "select 1", "id", "bigint", 1, "YES", "")],
        "database_name string, object_name string, object_kind string, comment string, view_definition string, column_name string, data_type string, ordinal_position int, is_nullable string, column_comment string",
    )
    s = scan(spark, samples.exports(spark), samples.sources(spark), samples.mappers(spark), rows)
    flows = {tuple(r) for r in s.flows.collect()}
    assert ("table:ods.orders", "table:dm.order_facts") in flows and ("table:dm.order_facts", "table:app.board") in flows
    assert ("table:ods.orders", "table:dm.order_sum") in flows  # within a method, through its callee as well
    assert ("table:ods.orders", "view:dm.v") in flows  # the view's bare name resolves
    nodes = {r.key: r for r in s.nodes.collect()}
    assert nodes["source_file:/data/in/orders*.xlsx"].object_type == "source_file" and "table:orders" not in nodes
    edges = {(r.type, r.src, r.dst) for r in s.edges.collect()}
    assert ("READS", "api:GET /api/orders/{id}", "table:t_order") in edges
    assert ("WRITES", "api:POST /api/orders/refresh", "table:dm.order_sum") in edges
    assert not any(a.startswith("api:") for _, a in [(t, x) for t, x, _ in edges if t == "FLOWS_TO"])
    d = {r.endpoint: r for r in s.endpoints.collect()}
    assert (d["api:POST /api/orders/refresh"].resolved_calls, d["api:POST /api/orders/refresh"].unresolved_calls) == (1, 1)
    assert d["api:POST /api/orders/refresh"].reasons == "auditLog.note:unresolved_receiver_target"
    assert d["api:PUT /api/orders/put"].reasons == "helper:unresolved_local_method"
    kinds = {(r.source_type, r.failure_type) for r in s.failures.collect()}
    assert kinds == {("kettle", "sql_parse_error"), ("java", "sql_parse_error"), ("metadata", "view_definition_parse_error")}


def test_scan_paths_and_save(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.repo").write_text(samples.EXPORT)
    for name, text in samples.SOURCES.items():
        (tmp_path / f"in/{name}.java").write_text(text)
    s = scan_paths(spark, [str(tmp_path / "in")], [str(tmp_path / "in")])
    s.save(str(tmp_path / "out"))
    s.save(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == 2
    stored = load(spark, str(tmp_path / "out"))
    assert stored.flows.count() == s.flows.count() > 0 and sorted(map(tuple, stored.nodes.collect()), key=str) == sorted(map(tuple, s.nodes.collect()), key=str)
    assert len(list((tmp_path / "out/graphs").iterdir())) == 2  # the current one and the one before


def test_stream_of_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.repo").write_text(samples.EXPORT)
    seen = []
    stream = incremental.export_facts(incremental.arriving_texts(spark, str(tmp_path / "in"), "*.repo"))
    q = incremental.write_each(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(map(tuple, df.collect())))
    q.awaitTermination(60)
    assert set(seen) == {tuple(r) for r in kettle.step_facts(kettle.sql_steps(kettle.parse_exports(samples.exports(spark)))).collect()}


def test_inputs():
    assert input_values([" a ", "", "b"], "a") == ["a", "b"] and split_list("a, ,b ") == ["a", "b"]
    assert metadata.metadata_request(None, ["x"]) is None
    assert metadata.metadata_request("mysql://u:p@h/db", None)[1] == ["db"]
    assert metadata.redacted("mysql://u:p@h/db") == "mysql://u:***@h/db"
    assert metadata.redacted("jdbc:mysql://h/db?user=u&password=secret&useSSL=true") == "jdbc:mysql://h/db?user=u&password=***&useSSL=true"
    assert metadata.redacted("jdbc:sqlserver://h;databaseName=d;trustStorePassword=p@x;encrypt=true") == "jdbc:sqlserver://h;databaseName=d;trustStorePassword=***;encrypt=true"
    assert metadata.redacted("mysql://u:a:b@c@h/db") == "mysql://u:***@h/db" and metadata.redacted("plain") == "plain"
    assert metadata.without_secrets("no way to jdbc:mysql://h/db?password=s3cret with s3cret", "jdbc:mysql://h/db?password=s3cret") == "no way to jdbc:mysql://h/db?password=*** with ***"
    assert form_text(["a", "b"], "c") == "a, b" and form_text([], "c") == "c" and form_text(None, None) == ""


def test_alias_needs_one_owner(spark):
    meta = spark.createDataFrame([("a", "T", "table:a.t"), ("b", "t", "table:b.t"), ("a", "u", "table:a.u")], "database string, object string, key string")
    refs = spark.createDataFrame([(" U ", "data_table"), ("t", "data_table"), ("B.T", "data_table"), ("u", "source_file")], "name string, object_type string")
    assert {(r.name, r.object_type): r.key for r in lineage.resolve(refs, meta).collect()} == {(" U ", "data_table"): "table:a.u", ("t", "data_table"): "table:t", ("B.T", "data_table"): "table:b.t", ("u", "source_file"): "source_file:u"}


def test_describe(spark):
    n = spark.createDataFrame([("k", "data_object", "nm", None), ("l", "data_object", "x", "table_view")], "key string, type string, name string, object_type string")
    m = spark.createDataFrame([("k", "", [1, 2])], "key string, comment string, columns array<int>")
    assert [tuple(r) for r in lineage.describe(n, m).orderBy("key").collect()] == [("k", "data_object", "nm", "nm", "data_table", 2), ("l", "data_object", "x", "x", "table_view", 0)]
    assert lineage.reoriented(spark.createDataFrame([("api:x", "t"), ("t", "u")], "src string, dst string")).orderBy("source").collect()[0].target == "api:x"
    assert n.select(lineage.type_label(F.col("object_type"))).collect()[0][0] == "Table"


JAVA = r'''package a.b; import java.util.*;
/* class Wrong { */ // "open
@TableName("T0") @TableName("T1") public final class A<T extends B<C>> extends ServiceImpl<M, E> implements I<K, V>, J {
  @Autowired @Qualifier("a(b") private Map<String, List<Foo>> map = new HashMap<>(), other; static { init(); } int[] arr = {1,2}; char c = '{'; String s = "} // no comment";
  A(int x) { this.y = x; }
  public <T extends Q> List<T> gen(Map<String, Integer> m, int... n) throws E1, E2 { if (a) { b("}"); /* gone("x") */ } String q = "select '\u4e2d\101\t' from 表\u0031 where x = 'it\'s' \n"; return this.run(q).then(z -> z.go()); }
  // String dead = "select * from no.where";
  abstract void nothing(); private Other o;
  static class In implements Z { private Deep deep; void inner() { c.d(); @Note("x(") int k = new Thing(1).f(); call( "a.b(" ); } }
  enum Kind { X(1) { void f() {} }, Y; private final Lock lock = null; int g() { return 1; } }
}'''


def test_java_grammar(spark):
    files = java.with_module(spark.createDataFrame([("/s/A.java", JAVA), ("/s/Open.java", "class Open { void f( { int x = "), ("/s/None.java", None), ("/s/Empty.java", "")], "path string, text string"))
    m = {r.module: r for r in java.modules(files).collect()}
    assert tuple(m["A"])[1:] == ("class", "ServiceImpl<M,E>", ["I", "J"], "T1", None, "M") and m["Empty"].kind is None and m["Open"].kind == "class"
    assert [r.method for r in java.methods(files).where("module = 'A'").orderBy("start").collect()] == ["A", "gen", "nothing", "inner", "g"]
    got = {(r.receiver, r.declared) for r in java.fields(files).where("module = 'A'").collect()}
    assert got == {("map", "Map<String, List<Foo>>"), ("arr", "int[]"), ("c", "char"), ("s", "String"), ("o", "Other"), ("deep", "Deep"), ("lock", "Lock")}
    calls = {(r.method, r.call) for r in java.method_calls(files).collect()}
    assert calls == {("gen", "this.run"), ("gen", "then"), ("gen", "z.go"), ("gen", "b"), ("inner", "c.d"), ("inner", "Thing"), ("inner", "f"), ("inner", "call")}
    (sql,) = java.statements(files).collect()
    assert sql.sql == "select '中A\t' from 表1 where x = 'it's' \n".strip() and sql.method == "gen"


def test_java_escapes(spark):
    cases = {r"a\u0041\uuu0042": "aAB", r"\u4e2d\uD83D\uDE00": "中😀", r"\0\12\377x\8": "\0\n\xffx8", r"a\"b\\\\c": 'a"b\\c', r"\\n|\n": "\n|\n", "": "", "é": "é"}
    got = {r.t: r.d for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", javatext.decode_literal("t").alias("d")).collect()}
    assert got == cases


def test_java_locals_of_deep_blocks_are_no_fields(spark):
    body = "int a = 1;\nOther repo = make();\n"
    for k in range(7):
        body = f"if (x{k}) {{\n{body}}}\nOther repo = make();\n"
    lists = "Runnable r = () -> {\nOther repo = make();\n};\nint[] n = {1, 2};\n"
    text = f"public class Deep {{\n  private OrderRepo repo;\n  Deep(int x) {{\n{body}}}\n  public void run() throws A, B {{\n{body}{lists}}}\n  private Last last;\n}}\n"
    got = {(r.receiver, r.declared) for r in java.fields(java.with_module(spark.createDataFrame([("/s/Deep.java", text)], "path string, text string"))).collect()}
    assert got == {("repo", "OrderRepo"), ("last", "Last")}


def test_unreachable_catalogue_is_a_failed_run(spark, tmp_path):
    s = scan_to(spark, str(tmp_path / "g"), jdbc_url="jdbc:nothing://u:secret@h/db")
    runs = failures.run_states(spark.read.parquet(str(tmp_path / "g/runs"))).collect()
    assert [r.status for r in runs] == ["failed"] and s.nodes.count() == 0
    (bad,) = spark.read.parquet(str(tmp_path / "g/failures")).collect()
    assert (bad.source_type, bad.failure_type, bad.run_id) == ("metadata", "MetadataConnectionError", runs[0].run_id) and "secret" not in bad.file_path
    with pytest.raises(metadata.MetadataConfigurationError):
        scan_paths(spark, jdbc_url="jdbc:mysql://h")


def test_states_of_runs(spark):
    rows = [("a", "running", {}, 1, None), ("a", "completed", {"x": "y"}, 1, 2), ("b", "running", {}, 3, None)]
    got = failures.run_states(spark.createDataFrame(rows, "run_id string, status string, inputs map<string,string>, created_at long, finished_at long"))
    assert {(r.run_id, r.status, r.finished_at) for r in got.collect()} == {("a", "completed", 2), ("b", "running", None)}


def test_lineage_of_unknown_keys_is_empty(spark):
    nodes = spark.createDataFrame([("table:a", "data_object", "a"), ("job:j", "job", "j")], "key string, type string, name string")
    edges = spark.createDataFrame([("READS", "job:j", "table:a", False)], "type string, src string, dst string, is_derived boolean")
    got = {r.key: r for r in lineage.object_lineage(nodes, edges, spark.createDataFrame([("table:a",), ("table:x",), ("job:j",)], "key string")).collect()}
    assert got["table:a"].found and got["table:a"].jobs == ["job:j"] and got["table:a"].upstream == []
    assert not got["table:x"].found and not got["job:j"].found and list(got["table:x"])[2:] == [[]] * 6


CATALOGUE = "database_name string, object_name string, object_kind string, comment string, view_definition string, column_name string, data_type string, ordinal_position int, is_nullable string, column_comment string"


def test_a_rescan_without_a_catalogue_clears_its_metadata(spark, tmp_path):
    folder = str(tmp_path / "g")
    rows = spark.createDataFrame([("ods", "t", "table", "c", None, "id", "int", 1, "NO", "")], CATALOGUE)
    scan(spark, catalogue=rows).save(folder)
    assert [r.key for r in load(spark, folder).metadata.collect()] == ["table:ods.t"]
    scan(spark, exports=samples.exports(spark)).save(folder)
    stored = load(spark, folder)
    assert stored.metadata.count() == 0 and stored.nodes.count() > 5 and stored.run.count() == 2


def test_merging_keeps_first_names(spark, tmp_path):
    folder = str(tmp_path / "g")
    one, two = scan(spark, exports=samples.exports(spark)), scan(spark, sources=samples.sources(spark))
    one.save(folder, merge=True)
    two.save(folder, merge=True)
    stored = load(spark, folder)
    keys = {r.key for s in (one, two) for r in s.nodes.collect()}
    assert {r.key for r in stored.nodes.collect()} == keys and stored.nodes.count() == len(keys)
    assert {tuple(r) for s in (one, two) for r in s.flows.collect()} <= {tuple(r) for r in stored.flows.collect()}
    assert stored.edges.distinct().count() == stored.edges.count()


def test_a_scan_that_breaks_is_failed_and_leaves_the_graph(spark, tmp_path):
    folder = str(tmp_path / "g")
    scan(spark, exports=samples.exports(spark)).save(folder)
    before = sorted(map(tuple, load(spark, folder).nodes.collect()), key=str)
    with pytest.raises(FileNotFoundError):
        scan_to(spark, folder, repo_paths=[str(tmp_path / "missing")])
    states = failures.run_states(spark.read.parquet(f"{folder}/runs")).collect()
    assert sorted(r.status for r in states) == ["completed", "failed"]
    assert sorted(map(tuple, load(spark, folder).nodes.collect()), key=str) == before
    assert [r.failure_type for r in load(spark, folder).failures.where("source_type = 'scan'").collect()] == ["FileNotFoundError"]
    # Tables that were written without their manifest don't count.
    (tmp_path / "g/graphs/half").mkdir()
    assert sorted(map(tuple, load(spark, folder).nodes.collect()), key=str) == before


def test_files_come_once_whatever_links_lead_to_them(spark, tmp_path):
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "other").mkdir()
    own, more = tmp_path / "a b+c" / "Orders.java", tmp_path / "other" / "Parts.java"
    own.write_text("class Orders {}")
    more.write_text("class Parts {}")
    (tmp_path / "other" / "Aliased.java").symlink_to(own)
    (tmp_path / "folder").symlink_to(tmp_path / "other")
    roots = [str(tmp_path / "a b+c"), str(tmp_path / "other"), str(tmp_path), str(tmp_path / "folder")]
    got = java.read_texts(spark, roots, "*.java").collect()
    assert sorted((r.module, r.text) for r in got) == [("Orders", "class Orders {}"), ("Parts", "class Parts {}")]
    (only,) = java.read_texts(spark, [str(tmp_path / "other" / "Aliased.java")], "*.java").collect()
    assert only.module == "Aliased"
    (tmp_path / "broken.xml").write_text("<repository><jobs>")
    (tmp_path / "copy.repo").symlink_to(tmp_path / "broken.xml")
    (bad,) = kettle.file_failures(kettle.parse_exports(kettle.read_exports(spark, [str(tmp_path)]))).collect()
    assert bad.file_path.endswith("/broken.xml")


def test_texts_of_one_file_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    """A table in one row group was parsed by one task."""
    from pyspark.sql import functions as F

    from tracewell import registry
    from tracewell.operators.checkpoints import spread
    from tracewell.plans import samples, scan

    spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("A").alias("c_mktsegment"), F.lit(3).alias("c_nationkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    dealt = []
    spy = lambda df: dealt.append(spread(df).select(F.spark_partition_id()).distinct().count()) or spread(df)
    monkeypatch.setattr(registry, "spread", spy)
    assert registry.QUERIES["sql_reads_writes"](spark, str(tmp_path)).count() == 200
    assert registry.QUERIES["sql_flows"](spark, str(tmp_path)).count() == 1
    monkeypatch.setattr(scan, "spread", spy)
    suppliers = spark.range(20).select(F.col("id").alias("s_suppkey")).coalesce(1)
    scan.program(samples.sources_of(suppliers))
    assert len(dealt) == 3 and min(dealt) >= 4
