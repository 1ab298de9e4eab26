import pytest
from pyspark.sql import functions as F

from tracewell.functions import sqltext as S
from tracewell.plans.statements import STATEMENTS

CASES = [
    ("select * from ods.orders \\\nwhere id = 1", ["ods.orders"], [], None),
    ("-- one\n-- two\nSELECT A.X FROM DC_CLIENT_ORIGINAL A", ["DC_CLIENT_ORIGINAL"], [], None),
    ("select * from (select a -- x\n from RM_CLIENT_INFO -- from no.one\n) t", ["RM_CLIENT_INFO"], [], None),
    ("select * from RM_PB_CLIENT_INDEN where PBTYPE2 = 'INTBL'--tail", ["RM_PB_CLIENT_INDEN"], [], None),
    ("select * from ods.orders o join dm.dim_user u on o.uid = u.id", ["dm.dim_user", "ods.orders"], [], None),
    ("select * from RM_CALL_MARGIN_PAY_LOG t WHERE AND t.CLIENT_NAME like 'abc'", ["RM_CALL_MARGIN_PAY_LOG"], [], None),
    ("select * from WMS_INFO where INST_NAME like '%' || 0 || '%'", ["WMS_INFO"], [], None),
    ("select * from FRMS.RP_INFO where n like CONCAT('%', 0, '%')", ["FRMS.RP_INFO"], [], None),
    ("select * from RM_AGREEMENT where CLIENT_UNICODE in 0 ) order by id", ["RM_AGREEMENT"], [], None),
    ("select * from t where r in ('1','2','3') 0\"> and r.id in #{item}", [], [], "Unterminated quote"),
    ("delete from dm.cleanup_target where id = 1", [], ["dm.cleanup_target"], None),
    ("update dm.cleanup_target set status = 1 where id in (select id from ods.k)", ["ods.k"], ["dm.cleanup_target"], None),
    ("with a as (select * from ods.orders), b as (select * from a), c as (select * from b join dm.dim_user u on 1=1) select * from c", ["dm.dim_user", "ods.orders"], [], None),
    ("insert into dm.t (a, b) select a, b from ods.x, ods.y z", ["ods.x", "ods.y"], ["dm.t"], None),
    ("insert into dm.t select * from dm.t where a = 'from x.y'", [], ["dm.t"], None),
    ("create table if not exists dm.n as select extract(year from d) from ods.x", ["ods.x"], ["dm.n"], None),
    ("merge into dm.t using ods.s on 1 = 1", ["dm.t", "ods.s"], [], None),
    ("select * from", [], [], "Expected table name"),
    ("select * from ods.orders where id in (", [], [], "Unbalanced parentheses"),
    ("select `a`.x from `db`.`tab` a", ["db.tab"], [], None),
    ("this is no sql", [], [], "Unsupported statement"),
    (None, [], [], None),
]


def test_extract_tables(spark):
    names = lambda text: [x for x in text.replace("{n}", "7").split(",") if x]
    cases = [*CASES, *((sql.replace("{n}", "7"), names(reads), names(writes), error) for sql, reads, writes, error in STATEMENTS)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, sql string")
    got = {r.k: r.t for r in df.select("k", S.extract_tables("sql").alias("t")).collect()}
    for k, (sql, reads, writes, error) in enumerate(cases):
        assert (got[k].reads or [], got[k].writes or [], got[k].error) == (reads, writes, error), sql


@pytest.mark.parametrize(
    ("text", "want"),
    [("select 'a--b' -- c", "select 'a--b' "), ('select "q--r"--x\nfrom t', 'select "q--r"\nfrom t'), ("'it''s--x'", "'it''s--x'")],
)
def test_line_comments(spark, text, want):
    assert spark.createDataFrame([(text,)], "sql string").select(S.strip_line_comments("sql")).first()[0] == want


def test_names(spark):
    one = spark.range(1)
    row = one.select(
        S.compose_table_name(F.lit(" ODS "), F.lit("Orders ")).alias("a"),
        S.compose_table_name(F.lit(""), F.lit("T")).alias("b"),
        S.compose_table_name(F.lit("s"), F.lit(" ")).alias("c"),
        S.source_file_name(F.lit("/d/in/"), F.lit("*.x")).alias("d"),
        S.source_file_name(F.lit("/d/orders.xlsx"), F.lit(None).cast("string")).alias("e"),
        S.source_file_name(F.lit(""), F.lit("m*")).alias("f"),
        S.truncate_target(F.lit(" TRUNCATE table Dm.T;")).alias("g"),
        S.truncate_target(F.lit("select 1")).alias("h"),
        S.split_statements(F.lit("a; ;b ;")).alias("i"),
        S.actor_scope(F.lit("job::step::x")).alias("j"),
        S.object_key(F.lit("table_view"), F.lit("a.b")).alias("k"),
        S.object_key(F.lit("source_file"), F.lit("o.xlsx")).alias("l"),
    ).first()
    assert list(row) == ["ods.orders", "t", None, "/d/in/*.x", "orders.xlsx", "m*", "dm.t", None, ["a", "b"], "job", "view:a.b", "source_file:o.xlsx"]


def test_mapper_text(spark):
    body = '<![CDATA[ select * from a ]]> <where><if test="x">and id = #{id} &lt; 3</if></where> <foreach item="i" open="(" close=")">#{i}</foreach> ${t}'
    got = spark.createDataFrame([(body,)], "b string").select(S.xml_sql("b")).first()[0]
    odd = spark.createDataFrame([("a &#60; b &#x4e2d;&#X1F600; &amp;#39; &amp;lt; &#39; & &#; c",)], "b string").select(S.xml_sql("b")).first()[0]
    assert odd == "a < b 中😀 &#39; &lt; ' & &#; c"
    assert "WHERE and id = 0" in got and "( 0 )" in got and got.endswith("placeholder") and "]]>" not in got
