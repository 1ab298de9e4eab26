"""Statements as people write them, with the tables they read and write: (sql, reads, writes, error).

{n} stands for a number, so that each row of a query has tables of its own.
"""

#: What a scan must get right beyond plain statements.
STATEMENTS: list[tuple[str, str, str, str | None]] = [
    ('select * from (select * from a{n}) t, b{n}', 'a{n},b{n}', '', None),
    ('select * from a{n}, (select * from c{n}) t, b{n}', 'a{n},b{n},c{n}', '', None),
    ('select * from a{n} force index (i), u{n}', 'a{n},u{n}', '', None),
    ('select * from a{n} use index (i, j) join u{n} on a.x = u.x, w{n}', 'a{n},u{n},w{n}', '', None),
    ('select * from a{n} join (b{n}, c{n}) on 1=1', 'a{n},b{n},c{n}', '', None),
    ('select * from (a{n} left join b{n} on a.x = b.x), d{n}', 'a{n},b{n},d{n}', '', None),
    ('select * from a{n} left join b{n} b2 using (id), d{n}', 'a{n},b{n},d{n}', '', None),
    ('select * from 订单{n}', '订单{n}', '', None),
    ('select * from 库.订单{n} o, Kunden_ä{n} k', 'Kunden_ä{n},库.订单{n}', '', None),
    ('select * from `my-db`.`t 1`', 'my-db.t 1', '', None),
    ('select * from `a``b`, "c d"', 'a`b,c d', '', None),
    ('create table n{n} like o{n}', 'o{n}', 'n{n}', None),
    ('create table if not exists x.n{n} like x.o{n}', 'x.o{n}', 'x.n{n}', None),
    ('insert into db.t{n} select * from s{n} where note = "from z"', 's{n}', 'db.t{n}', None),
    ('select "it\'s" from a{n}', 'a{n}', '', None),
    ('select \'say "from z"\' from a{n}', 'a{n}', '', None),
    ("select 'a\\'b from z' from a{n}", 'a{n}', '', None),
    ('select * from a{n} where x in (select y from b{n} where z in (select w from c{n}, d{n})), e', 'a{n},b{n},c{n},d{n}', '', None),
    ('select f(a, b), g(c) from t1{n}, t2{n} where h(x, y) = 1', 't1{n},t2{n}', '', None),
    ("select trim(both 'x' from y), extract(year from d), substring(s from 2) from t{n}", 't{n}', '', None),
    ('select a.b, c.d from e.f{n} g, h.i{n} as j cross join k{n} natural join l{n}', 'e.f{n},h.i{n},k{n},l{n}', '', None),
    ('select * from a{n} as x join b{n} as y on x.i = y.i and x.j = y.j left outer join c{n} on 1 = 1', 'a{n},b{n},c{n}', '', None),
    ('select * from a{n} union all select * from b{n} union (select * from c{n})', 'a{n},b{n},c{n}', '', None),
    ('(select * from a{n}) union (select * from b{n}) order by 1', 'a{n},b{n}', '', None),
    ("insert into t{n} (a, b) values (1, 'from x'), (2, 'join y')", '', 't{n}', None),
    ('insert ignore into t{n} select * from s{n} on duplicate key update a = 1, b = 2', 's{n}', 't{n}', None),
    ('insert t{n} select * from s{n}', 's{n}', 't{n}', None),
    ('insert into t{n} set a = 1, b = (select max(x) from s{n})', 's{n}', 't{n}', None),
    ("insert into t{n} select insert(x, 1, 2, 'y') from s{n}", 's{n}', 't{n}', None),
    ('update a{n}, b{n} set a.x = b.x where a.i = b.i', 'b{n}', 'a{n}', None),
    ('update a{n} join b{n} on a.i = b.i set a.x = 1, a.y = (select 1 from c{n})', 'b{n},c{n}', 'a{n}', None),
    ('update low_priority ignore a{n} set x = 1', '', 'a{n}', None),
    ('delete from a{n} where exists (select 1 from b{n})', 'b{n}', 'a{n}', None),
    ('delete x from a{n} x join b{n} on x.i = b.i', 'b{n}', 'a{n}', None),
    ('select * from a{n} for update', 'a{n}', '', None),
    ('select * from a{n} where x is not distinct from y', 'a{n}', '', None),
    ('create or replace view v{n} as select * from a{n}, b{n}', 'a{n},b{n}', 'v{n}', None),
    ('create table n{n} (id int, name varchar(10)) ', '', 'n{n}', None),
    ('create temporary table n{n} as (select * from a{n} join b{n} using (id, x), c{n})', 'a{n},b{n},c{n}', 'n{n}', None),
    ("create table n{n} select * from a{n} where x like 'y'", 'a{n}', 'n{n}', None),
    ('create index i on t{n} (a, b)', 't{n}', '', None),
    ('with a as (select * from x{n}), b (c, d) as (select * from a, y{n}) select * from b, z{n}', 'x{n},y{n},z{n}', '', None),
    ('with recursive r as (select 1 from s{n} union all select * from r join t{n} on 1=1) select * from r', 's{n},t{n}', '', None),
    ('with `a b` as (select * from x{n}) select * from `a b`, w{n}', 'w{n},x{n}', '', None),
    ('select * from a{n}, lateral (select * from b{n} where b.x = a.x) l, c{n}', 'a{n},b{n},c{n}', '', None),
    ("select * from json_table(x, '$' columns (a int path '$.a')) j, b{n}", 'b{n}', '', None),
    ('select case when a then b else c end, (select max(x) from d{n}) from e{n}', 'd{n},e{n}', '', None),
    ('select * from a{n} where b between 1 and 2 group by c, d having count(*) > (select 1 from f{n}) order by g, h limit 1, 2', 'a{n},f{n}', '', None),
    ('select * from db . tab t', 'db.tab', '', None),
    ('select a from t1{n} straight_join t2{n}, t3{n}', 't1{n},t2{n},t3{n}', '', None),
    ('merge into dm.t{n} using (select * from s{n}, u{n}) x on x.i = t.i when matched then update set t.x = x.x', 'dm.t{n},s{n},u{n}', '', None),
    ('truncate table dm.x{n}', 'dm.x{n}', '', None),
    ('drop table if exists dm.x{n}', 'dm.x{n}', '', None),
    ('select * from a{n}; select * from b', 'a{n}', '', None),
    ("select ';' from a{n}", 'a{n}', '', None),
    ("select * from a{n} where x in ('(', ')') and y = '('", 'a{n}', '', None),
    ('select * from where x = 1', '', '', 'Expected table name'),
    ('select * from a join on a.x = 1', '', '', 'Expected table name'),
    ('select * from a, where x = 1', '', '', 'Expected table name'),
    ('insert into values (1)', '', '', 'Expected table name'),
    ('select * from (a join b on 1=1', '', '', 'Unbalanced parentheses'),
    ("select * from a where x = 'y", '', '', 'Unterminated quote'),
    ('select `x from a', '', '', 'Unterminated quote'),
    ('select\n*\nfrom\n\ta{n}\n,\n\tb{n}\nwhere\n1=1', 'a{n},b{n}', '', None),
    ('SELECT * FROM A{n} INNER JOIN B{n} ON A.ID = B.ID RIGHT JOIN C.D{n} E ON E.ID = A.ID', 'A{n},B{n},C.D{n}', '', None),
    ('select count(distinct x) from a{n}', 'a{n}', '', None),
    ('select distinct x from a{n}', 'a{n}', '', None),
    ("select left(x, 2), right(y, 3), replace(z, 'a', 'b') from a{n}", 'a{n}', '', None),
    ('select if(x, 1, 2), exists(select 1 from b{n}) from a{n}', 'a{n},b{n}', '', None),
    ('select 1', '', '', None),
    ('select * from a{n} # comment from b', 'a{n}', '', None),
    ("select '# from b', `c#d` from a{n} -- # join e", 'a{n}', '', None),
    ('select * from "s{n}"."t"', 's{n}.t', '', None),
    ('select * from s{n}."t u" x, "v"', 's{n}.t u,v', '', None),
    ("select * into outfile '/x' from a{n}", 'a{n}', '', None),
    ('select x into @v from a{n}', 'a{n}', '', None),
    ('select * from a{n} force index for join (i), b{n}', 'a{n},b{n}', '', None),
    ('select * from a{n} ignore key for order by (i, j) join b{n} use index () on 1 = 1, c{n}', 'a{n},b{n},c{n}', '', None),
    ('show tables from db', '', '', None),
    ('replace into r{n} select * from a{n}', 'a{n},r{n}', '', None),
    ("select * from a{n} where x like '%' || 0 || '%' and y in (select 1 from b{n})", 'a{n},b{n}', '', None),
    ("select * from a{n} where x like concat ( '%', placeholder , '%' ) and y in 0 ) and z like 'in 0 )'", 'a{n}', '', None),
]
