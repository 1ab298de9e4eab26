"""Small texts of the kinds that a scan reads, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = """<repository>
  <jobs>
    <job><name>nightly</name><transformation>load_orders</transformation>
      <entries>
        <entry><name>run</name><type>TRANS</type><transname>publish</transname></entry>
        <entry><name>clean</name><type>SQL</type><sql>truncate table dm.stage; insert into dm.log select * from ods.audit; select * from</sql></entry>
      </entries>
    </job>
  </jobs>
  <transformations>
    <transformation><name>load_orders</name><steps>
      <step><name>in</name><type>TableInput</type><sql>select * from ODS.Orders o join dim.users u on u.id = o.uid</sql></step>
      <step><name>out</name><type>TableOutput</type><schema>dm</schema><table>Order_Facts</table></step>
      <step><name>sheet</name><type>ExcelInput</type><file><name>/data/in/</name><filemask>orders*.xlsx</filemask></file></step>
    </steps></transformation>
    <transformation><info><name>publish</name></info>
      <step><name>old</name><type>AccessInput</type><table_name> Legacy_Orders </table_name></step>
      <step><name>up</name><type>InsertUpdate</type><lookup><schema>app</schema><table>board</table></lookup></step>
      <step><name>sql</name><type>ExecSQL</type><sql>insert into app.board select * from dm.order_facts</sql></step>
      <step><name>bad</name><type>ExecSQL</type><sql>select * from x where id in (</sql></step>
    </transformation>
  </transformations>
</repository>"""

SOURCES = {
    "OrderController": """package a;
@RestController
@RequestMapping("/api/orders")
public class OrderController {
    private OrderService orderService;
    private AuditLog auditLog;
    @GetMapping("/{id}")
    public Result get(String id) { return Result.data(orderService.find(id)); }
    @PostMapping(value = "refresh/")
    public Result refresh() { auditLog.note("x"); orderService.rebuild(); return Result.success(); }
    @RequestMapping("/any")
    public Result any() { return Result.success(); }
    @RequestMapping(value = "/put", method = RequestMethod.PUT)
    public Result put() { if (true) { helper(); } return Result.success(); }
}""",
    "OrderService": """package a;
public interface OrderService {
    Object find(String id);
    void rebuild();
}""",
    "OrderServiceImpl": """package a;
public class OrderServiceImpl extends ServiceImpl<OrderMapper, OrderEntity> implements OrderService {
    private OrderRepository orderRepository;
    // String ignored = "select * from no.where";
    public Object find(String id) { return baseMapper.selectById(id); }
    public void rebuild() {
        String sql = "insert into dm.order_sum select * from ods.orders";
        execute(sql);
        orderRepository.save();
    }
    private void execute(String sql) { }
}""",
    "OrderRepository": """package a;
public class OrderRepository {
    public void save() { String sql = "update dm.order_sum set n = 1 where id in (select id from ods.keys)"; }
    public void broken() { String sql = "select * from"; }
}""",
    "OrderMapper": """package a;
public interface OrderMapper extends BaseMapper<OrderEntity> {
    @Select("select * from ods.notes where id = #{id} " + "and kind = ${kind}")
    List<Object> notes(String id);
}""",
    "OrderEntity": """package a;
@TableName("t_order")
public class OrderEntity { private String id; }""",
}

MAPPER = """<mapper namespace="a.OrderMapper">
  <select id="wide" resultType="x">select * from ods.wide <where> <if test="a">and id = #{id} &lt; 3</if> </where></select>
  <update id="mark">update ods.wide <set>flag = 1</set> where id in <foreach collection="l" open="(" close=")">#{x}</foreach></update>
</mapper>"""


def exports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/r/one.repo", EXPORT)], "path string, text string")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"/j/{name}.java", text) for name, text in SOURCES.items()], "path string, text string")


def mappers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/j/OrderMapper.xml", MAPPER)], "path string, text string")


#: Files of a supplier whose number is {k}, with what is to be found in them further below.
EXPORT_OF = """<repository><jobs><job><name>Job_{k}</name><transformation>load_{k}</transformation><entries>
  <entry><name>run</name><type>TRANS</type><transname>publish_{k}</transname></entry>
  <entry><name>clean</name><type>SQL</type><sql>truncate table DM.Stage_{k}; insert into dm.log_{k} select * from ods.audit_{k}, ods.more_{k}; select * from</sql></entry>
</entries></job></jobs><transformations>
  <transformation><name>load_{k}</name><steps>
    <step><name>in</name><type>TableInput</type><sql>select * from ODS.Orders_{k} o join (dim.u_{k} u, dim.v_{k} v) on u.id = o.id</sql></step>
    <step><name>out</name><type>TableOutput</type><schema>dm</schema><table>Facts_{k}</table></step>
    <step><name>sheet</name><type>ExcelInput</type><file><name>/data/in/</name><filemask>orders_{k}*.xlsx</filemask></file></step>
    <step><name>plain</name><type>TableInput</type><schema>ods</schema><table>Plain_{k}</table></step>
  </steps></transformation>
  <transformation><info><name>publish_{k}</name></info>
    <step><name>old</name><type>AccessInput</type><table_name> Legacy_{k} </table_name></step>
    <step><name>up</name><type>InsertUpdate</type><lookup><schema>app</schema><table>board_{k}</table></lookup></step>
    <step><name>sql</name><type>ExecSQL</type><sql>insert into app.board_{k} select * from dm.facts_{k} where note = "from x.y"</sql></step>
    <step><name>bad</name><type>ExecSQL</type><sql>select * from x where id in (</sql></step>
  </transformation>
</transformations></repository>"""

SOURCES_OF = {
    "Controller{k}": """package a;
/* @Controller class Other { */
@RestController
@RequestMapping("/api/s{k}")
public class Controller{k} {
    private Service{k} service;
    private Port{k} port;
    private Mapper{k} mapper;
    @GetMapping("/{id}") public Result get(String id) { return Result.data(service.find(id)); }
    @PostMapping(value = "refresh/") public Result refresh() { service.rebuild(); audit.note("}"); helper(); return Result.success(); }
    @RequestMapping(value = "/put", method = RequestMethod.PUT) public Result put() { mapper.insert(x); port.open(); return Result.success(); }
    @RequestMapping("/any") public Result any() { return Result.success(); }
}""",
    "Service{k}": "package a; public interface Service{k} { Object find(String id); void rebuild(); }",
    "Service{k}Impl": """package a;
public class Service{k}Impl extends ServiceImpl<Mapper{k}, Entity{k}> implements Service{k} {
    private Repo{k} repo;
    public Object find(String id) { return baseMapper.selectById(id); }
    public void rebuild() {
        // "select * from no.where" }
        String sql = "insert into dm.sum_{k} select * from ods.orders_{k}, " + "";
        String more = "insert into dm.sum_{k} select * from (select * from ods.orders_{k}) o, ods.\\u006cines_{k}";
        repo.save();
        notes();
    }
    public Object notes() { return getBaseMapper().notes(); }
    public Object pages() { return getBaseMapper().selectPage(); }
}""",
    "Repo{k}": """package a; public class Repo{k} { public void save() { String sql = "update dm.sum_{k} set n = 1 where id in (select id from ods.keys_{k})"; } }""",
    "Mapper{k}": """package a; public interface Mapper{k} extends BaseMapper<Entity{k}> { @Select("select * from ods.notes_{k} where id = #{id}") List<Object> notes(); }""",
    "Entity{k}": """package a; @TableName("t_{k}") public class Entity{k} { private String id; }""",
    "Port{k}": "package a; public interface Port{k} { void open(); }",
    "PortA{k}": "package a; public class PortA{k} implements Port{k} { public void open() { } }",
    "PortB{k}": "package a; public class PortB{k} implements Port{k} { public void open() { } }",
}

#: (edge_type, actor, name, object_type) in EXPORT_OF.
KETTLE_FACTS = [
    ("READS", "load_{k}::in", "ods.orders_{k}", "data_table"),
    ("READS", "load_{k}::in", "dim.u_{k}", "data_table"),
    ("READS", "load_{k}::in", "dim.v_{k}", "data_table"),
    ("WRITES", "load_{k}::out", "dm.facts_{k}", "data_table"),
    ("READS", "load_{k}::sheet", "/data/in/orders_{k}*.xlsx", "source_file"),
    ("READS", "load_{k}::plain", "ods.plain_{k}", "data_table"),
    ("READS", "publish_{k}::old", "legacy_{k}", "source_table"),
    ("WRITES", "publish_{k}::up", "app.board_{k}", "data_table"),
    ("READS", "publish_{k}::sql", "dm.facts_{k}", "data_table"),
    ("WRITES", "publish_{k}::sql", "app.board_{k}", "data_table"),
    ("WRITES", "Job_{k}::clean", "dm.stage_{k}", "data_table"),
    ("WRITES", "Job_{k}::clean", "dm.log_{k}", "data_table"),
    ("READS", "Job_{k}::clean", "ods.audit_{k}", "data_table"),
    ("READS", "Job_{k}::clean", "ods.more_{k}", "data_table"),
]
#: (module, method, reads, writes, error) of statements in SOURCES_OF.
JAVA_FACTS = [
    ("Service{k}Impl", "rebuild", "", "", "Expected table name"),
    ("Service{k}Impl", "rebuild", "ods.lines_{k},ods.orders_{k}", "dm.sum_{k}", None),
    ("Repo{k}", "save", "ods.keys_{k}", "dm.sum_{k}", None),
    ("Mapper{k}", "notes", "ods.notes_{k}", "", None),
]
#: (endpoint, http_method, route, module, method).
ENDPOINTS = [
    ("api:GET /api/s{k}/{id}", "GET", "/api/s{k}/{id}", "Controller{k}", "get"),
    ("api:POST /api/s{k}/refresh", "POST", "/api/s{k}/refresh", "Controller{k}", "refresh"),
    ("api:PUT /api/s{k}/put", "PUT", "/api/s{k}/put", "Controller{k}", "put"),
]
#: (module, method, call, target, target_method).
RESOLVED = [
    ("Controller{k}", "get", "service.find", "Service{k}Impl", "find"),
    ("Controller{k}", "refresh", "service.rebuild", "Service{k}Impl", "rebuild"),
    ("Controller{k}", "put", "mapper.insert", "Mapper{k}", "insert"),
    ("Service{k}Impl", "find", "baseMapper.selectById", "Mapper{k}", "selectById"),
    ("Service{k}Impl", "rebuild", "repo.save", "Repo{k}", "save"),
    ("Service{k}Impl", "rebuild", "notes", "Mapper{k}", "notes"),
    ("Service{k}Impl", "notes", "notes", "Mapper{k}", "notes"),
    ("Service{k}Impl", "pages", "selectPage", "Mapper{k}", "selectPage"),
]
#: (module, method, reads, writes) through all calls.
METHOD_TABLES = [
    ("Controller{k}", "get", "t_{k}", ""),
    ("Controller{k}", "put", "", "t_{k}"),
    ("Controller{k}", "refresh", "ods.keys_{k},ods.lines_{k},ods.notes_{k},ods.orders_{k}", "dm.sum_{k}"),
    ("Service{k}Impl", "find", "t_{k}", ""),
    ("Service{k}Impl", "rebuild", "ods.keys_{k},ods.lines_{k},ods.notes_{k},ods.orders_{k}", "dm.sum_{k}"),
    ("Service{k}Impl", "notes", "ods.notes_{k}", ""),
    ("Service{k}Impl", "pages", "t_{k}", ""),
    ("Repo{k}", "save", "ods.keys_{k}", "dm.sum_{k}"),
    ("Mapper{k}", "notes", "ods.notes_{k}", ""),
    ("Mapper{k}", "selectById", "t_{k}", ""),
    ("Mapper{k}", "selectPage", "t_{k}", ""),
    ("Mapper{k}", "insert", "", "t_{k}"),
]
#: (endpoint, resolved_calls, unresolved_calls, reasons, reads, writes).
DIAGNOSTICS = [
    ("api:GET /api/s{k}/{id}", "1", "0", "", "t_{k}", ""),
    ("api:POST /api/s{k}/refresh", "1", "2", "audit.note:unresolved_receiver_type,helper:unresolved_local_method", "ods.keys_{k},ods.lines_{k},ods.notes_{k},ods.orders_{k}", "dm.sum_{k}"),
    ("api:PUT /api/s{k}/put", "1", "1", "port.open:multiple_impl_candidates", "", "t_{k}"),
]


#: Calls that must not be taken for a mapper's, and one that is only where a single class implements its interface. Files
#: whose name begins with `even:` or `odd:` are there for suppliers of such a number only.
BRIDGES_OF = {
    "Book{k}": """package b; @TableName("book_{k}") public class Book{k} { }""",
    "BookMapper{k}": """package b; public interface BookMapper{k} extends BaseMapper<Book{k}> { @Select("select * from ods.shelf_{k}") List<Object> shelf(); }""",
    "Naked{k}": "package b; public class Naked{k} extends ServiceImpl<BookMapper{k}, Book{k}> { public Object selectPage() { getBaseMapper(); return null; } }",
    "Local{k}": "package b; public class Local{k} extends ServiceImpl<BookMapper{k}, Book{k}> { public Object pages() { return selectPage(); } private Object selectPage() { return null; } }",
    "Plain{k}": "package b; public class Plain{k} { private BaseMapper<Book{k}> baseMapper; public Object rows() { return baseMapper.selectPage(a, b); } }",
    "Busy{k}": "package b; public class Busy{k} extends ServiceImpl<BookMapper{k}, Book{k}> { public Object shelf() { audit(); getBaseMapper(); return null; } public Object outer() { return shelf(); } private void audit() { } }",
    "IStock{k}": "package b; public interface IStock{k} { Object shelf(); }",
    "Stock{k}Impl": "package b; public class Stock{k}Impl extends ServiceImpl<BookMapper{k}, Book{k}> implements IStock{k} { public Object shelf() { return getBaseMapper().shelf(); } }",
    "even:Other{k}Impl": "package b; public class Other{k}Impl implements IStock{k} { public Object shelf() { return null; } }",
    "Desk{k}": "package b; public class Desk{k} { private IStock{k} stock; public Object look() { return stock.shelf(); } }",
}
#: (module, method, reads, writes) of all methods in BRIDGES_OF; Desk looks through the only implementation of odd suppliers.
BRIDGED = [
    ("BookMapper{k}", "shelf", "ods.shelf_{k}", ""),
    ("Naked{k}", "selectPage", "", ""),
    ("Local{k}", "pages", "", ""),
    ("Local{k}", "selectPage", "", ""),
    ("Plain{k}", "rows", "", ""),
    ("Busy{k}", "shelf", "", ""),
    ("Busy{k}", "outer", "", ""),
    ("Busy{k}", "audit", "", ""),
    ("IStock{k}", "shelf", "", ""),
    ("Stock{k}Impl", "shelf", "ods.shelf_{k}", ""),
    ("even:Other{k}Impl", "shelf", "", ""),
    ("even:Desk{k}", "look", "", ""),
    ("odd:Desk{k}", "look", "ods.shelf_{k}", ""),
]
#: Calls of mappers without the evidence that names a table; of odd suppliers the last has it.
EVIDENCE_OF = {
    "Gate{k}": """package c; @RestController @RequestMapping("/gate") public class Gate{k} {
    private Ghost{k} ghost; private Bare{k} bare; private Loose{k} loose;
    @GetMapping("/{k}") public Result look() { ghost.selectList(x); bare.selectById(x); loose.insert(x); return Result.success(); } }""",
    "Bare{k}": "package c; public interface Bare{k} { }",
    "Loose{k}": "package c; public interface Loose{k} extends BaseMapper<Thing{k}> { }",
    "even:Thing{k}": "package c; public class Thing{k} { }",
    "odd:Thing{k}": """package c; @TableName("thing_{k}") public class Thing{k} { }""",
}
_TWO_REASONS = "bare.selectById:mapper_without_basemapper_entity,ghost.selectList:crud_method_without_table_binding"
#: (endpoint, resolved_calls, unresolved_calls, reasons, reads, writes) of EVIDENCE_OF.
EVIDENCE = [
    ("even:api:GET /gate/{k}", "0", "3", _TWO_REASONS + ",loose.insert:entity_without_table_name", "", ""),
    ("odd:api:GET /gate/{k}", "1", "2", _TWO_REASONS, "", "thing_{k}"),
]
#: Mapper XML, next to its interface or, of odd suppliers, in the resources.
MAPPER_OF = """<?xml version="1.0"?><!-- <select id="no">select * from gone</select> -->
<mapper namespace="d.ShopMapper{k}">
  <select id="wide" resultType="x">select * from ods.wide_{k} <where><if test="a > 1">and id &lt; #{id}</if></where></select>
  <update id="mark">update ods.wide_{k} <set>flag = ${f}</set> where id in <foreach collection="l" item="x" open="(" close=")">#{x}</foreach></update>
  <insert id="put"><![CDATA[ insert into dm.cd_{k} select * from ods.src_{k} where a < 3 and b > 2 ]]></insert>
  <delete id='drop'>delete from ods.gone_{k} where n in <foreach collection="l" item="x">#{x}</foreach></delete>
</mapper>"""
#: (module, method, sql, reads, writes) of MAPPER_OF.
MAPPED = [
    ("ShopMapper{k}", "wide", "select * from ods.wide_{k} WHERE and id < 0", "ods.wide_{k}", ""),
    ("ShopMapper{k}", "mark", "update ods.wide_{k} SET flag = placeholder where id in ( 0 )", "", "ods.wide_{k}"),
    ("ShopMapper{k}", "put", "insert into dm.cd_{k} select * from ods.src_{k} where a < 3 and b > 2", "ods.src_{k}", "dm.cd_{k}"),
    ("ShopMapper{k}", "drop", "delete from ods.gone_{k} where n in ( 0 )", "", "ods.gone_{k}"),
]


def _of_suppliers(suppliers: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """(path, text) of files for each supplier; see BRIDGES_OF for those of some."""
    parity = {"even": 0, "odd": 1}
    made = [(p.replace("even:", "").replace("odd:", ""), t, next((n for w, n in parity.items() if f"{w}:" in p), None)) for p, t in files]
    each = suppliers.select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text"), F.lit(n).cast("int").alias("only")) for p, t, n in made])).alias("f"))
    each = each.where("f.only is null or f.only = s_suppkey % 2")
    return each.select(*[F.replace(f"f.{c}", F.lit("{k}"), F.col("k")).alias(c) for c in ("path", "text")])


def files_of(suppliers: DataFrame, files: dict[str, str]) -> DataFrame:
    """(path, text) of Java files by name."""
    return _of_suppliers(suppliers, [(f"/j/{name}.java", text) for name, text in files.items()])


def mapped_of(suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Java files, mapper files)."""
    code = _of_suppliers(suppliers, [("/d{k}/ShopMapper{k}.java", "package d; public interface ShopMapper{k} { }")])
    return code, _of_suppliers(suppliers, [("even:/d{k}/ShopMapper{k}.xml", MAPPER_OF), ("odd:/d{k}/resources/mapper/ShopMapper{k}.xml", MAPPER_OF)])


def exports_of(suppliers: DataFrame) -> DataFrame:
    return _of_suppliers(suppliers, [("/r/{k}.repo", EXPORT_OF)])


def sources_of(suppliers: DataFrame) -> DataFrame:
    return _of_suppliers(suppliers, [(f"/j/{name}.java", text) for name, text in SOURCES_OF.items()])


def expected_of(columns: str, rows: list[tuple]) -> str:
    """DuckDB SQL for rows with each supplier's number."""
    names = columns.split(", ")
    said = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    told = ", ".join(f"replace({n}, '{{k}}', s_suppkey::VARCHAR) AS {n}" for n in (f"v.{n}" for n in names)).replace("AS v.", "AS ")
    told = told.replace(f"v.{names[0]},", f"regexp_replace(v.{names[0]}, '^(even|odd):', ''),", 1)
    some = f"CASE WHEN starts_with(v.{names[0]}, 'even:') THEN s_suppkey % 2 = 0 WHEN starts_with(v.{names[0]}, 'odd:') THEN s_suppkey % 2 = 1 ELSE true END"
    return f"SELECT {told} FROM supplier CROSS JOIN (VALUES {values}) v({columns}) WHERE {some}"
