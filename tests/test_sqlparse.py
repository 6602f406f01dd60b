import pytest

from colonnade.functions import sqlparse as p

SCHEMA = {"t": ["id", "a", "b"], "u": ["id", "c", "t_id"]}


@pytest.mark.parametrize(
    ("sql", "tables", "joins", "score", "types"),
    [
        ("select a from t, u where t.id = u.id", ["t", "u"], [], 1, ["join"]),
        ("with c as (select id from t) select c.id from c join u on c.id = u.id", ["t", "u"], ["t.id=u.id"], 4, ["inner_join"]),
        ("select a from t -- join u on x = y\n where b = 1", ["t"], [], 0, []),
        ('select "join" from "t"', ["t"], [], 0, []),
        ("select sum(a) over w from t window w as (order by b)", ["t"], [], 5, ["window_function"]),
        ("select t.a from t x join u on x.id = u.id and x.a = u.c left join v on v.k = u.c", ["t", "u", "v"], ["t.id=u.id", "t.a=u.c", "u.c=v.k"], 2, ["inner_join", "left_join"]),
        ("select a from t where id in (select id from u) and exists (select 1 from u) and b = (select max(c) from u)", ["t", "u"], [], 9, ["max", "in_subquery", "exists", "subquery"]),
        ("select a from t union select c from u except select 1 order by 1 desc limit 2", ["t", "u"], [], 6, ["order_by_desc", "limit"]),
        ("select distinct a, round(b / 2, 1), a / b from t group by a having count(*) > 1", ["t"], [], 1, ["group_by", "having", "percentage", "division", "distinct"]),
        ("select rank() over (partition by a order by b rows between 1 preceding and current row) from `t`;", ["t"], [], 5, ["rank", "partition_by"]),
    ],
)
def test_what_is_read_off(sql, tables, joins, score, types):
    a = p.analysis(sql)
    assert a["parsed"] and a["tables"] == tables and a["complexity"] == score
    assert [f"{j['left_table']}.{j['left_column']}={j['right_table']}.{j['right_column']}" for j in a["joins"]] == joins
    assert [i["type"] for i in a["intents"]] == types


@pytest.mark.parametrize("sql", [None, "", "ERROR: no answer produced", "select", "select a from", "select a from t where (b", "select a b c from t", "drop table t", "select 'a", "(" * 5000])
def test_no_query(sql):
    assert p.analysis(sql) == {"parsed": False, "tables": [], "columns": [], "joins": [], "conditions": [], "intents": [], "complexity": 100, "qualified": None, "logic": None}


def test_columns_by_clause():
    a = p.analysis("select t.a, c from t join u on t.id = u.t_id where b > 1 group by t.a having max(c) > 2 order by t.b, x.q", SCHEMA)
    got = {(c["clause"], c["table_name"], c["column_name"]) for c in a["columns"]}
    assert got == {("select", "t", "a"), ("select", "u", "c"), ("join", "t", "id"), ("join", "u", "t_id"), ("where", "t", "b"), ("group", "t", "a"), ("having", "u", "c"), ("order", "t", "b"), ("order", "", "q")}
    assert a["conditions"] == ["b > 1", "MAX(c) > 2"]


def test_scopes():
    """Names in an inner query belong to it first, then to the query around it; through a derived table to what it reads."""
    a = p.analysis("select d.z from (select a as z from t) d where exists (select 1 from u where u.id = d.z)")
    assert {(c["table_name"], c["column_name"]) for c in a["columns"]} == {("t", "a"), ("u", "id")}
    assert p.analysis("select count(*) as n from t order by n")["columns"] == []


@pytest.mark.parametrize(
    ("sql", "qualified", "logic"),
    [
        ("select x.a from t x where b = 'q'", "SELECT t.a FROM t WHERE t.b = 'q'", "[FROM <t> AS <x>] -> [WHERE <b> = 'q'] -> [SELECT <x>.<a>]"),
        ("select x.a, y.a from t x join t y on x.id = y.id", "SELECT x.a, y.a FROM t AS x JOIN t AS y ON x.id = y.id", "[FROM <t> AS <x>] -> [JOIN <t> AS <y> ON <x>.<id> = <y>.<id>] -> [SELECT <x>.<a>, <y>.<a>]"),
        ("with c as (select id from t) select c.id from c limit 1", "WITH c AS (SELECT t.id FROM t) SELECT c.id FROM c LIMIT 1", "[WITH <c> AS ( [FROM <t>] -> [SELECT <id>] )] -> [FROM <c>] -> [SELECT <c>.<id>] -> [LIMIT 1]"),
        ("select 1 union all select 2", "SELECT 1 UNION ALL SELECT 2", "( [SELECT 1] ) -> [UNION ALL] -> ( [SELECT 2] )"),
    ],
)
def test_rewrites(sql, qualified, logic):
    a = p.analysis(sql)
    assert (a["qualified"], a["logic"]) == (qualified, logic)
    assert p.analysis(qualified)["tables"] == a["tables"]


def test_skeletons_and_masks():
    assert p.normal_form('SELECT A FROM t WHERE b = "X y"  ORDER BY a ;') == "select a from t where b = 'X y' order by a asc"
    names = {"t", "u", "a", "b", "id"}
    assert p.schema_skeleton("SELECT x.a, b FROM t AS x JOIN u ON t.id = u.id WHERE a = 3 AND b = 'q' ORDER BY a DESC", names) == "select _ from _ as x join _ where _ order by _ desc"
    assert p.mask_pair("select a from t where b = 1", "select a from t where b = 2") == ("SELECT C1 FROM T1 WHERE C2 = V1", "SELECT C1 FROM T1 WHERE C2 = V2", True)
    assert p.mask_pair("select a from t", "select b from t")[2] is False
    assert p.quote_names("select * from order join group on 1 = 1 order by a", {"order", "group", "t"}) == "select * from `order` join `group` on 1 = 1 order by a"
    assert p.named_in("select NAME from People", [("people", "name"), ("people", "age")]) == [("people", "name")]
    assert (p.closest_name("User Name", ["username", "age"]), p.closest_name("usrname", ["username", "age"]), p.closest_name("zzz", ["username"])) == ("username", "username", None)


def test_over_a_column(spark):
    df = spark.createDataFrame([(1, "select a from t"), (2, None), (3, "select a from t"), (4, "no query")], "id int, s string").selectExpr("id", "s", "'x' as tables")
    got = {r.id: (r.analysis.parsed, r.analysis.tables, r.tables) for r in p.analyse(df, "s").collect()}
    assert got == {1: (True, ["t"], "x"), 2: (False, [], "x"), 3: (True, ["t"], "x"), 4: (False, [], "x")}
    assert p.analyse(df.limit(0), "s").count() == 0
    pairs = df.selectExpr("id", "s", "replace(s, 'a', 'b') as other")
    got = {r.id: r.same for r in p.per_text(pairs, ["s", "other"], {"one": "string", "two": "string", "same": "boolean"}, p.mask_pair).collect()}
    assert got == {1: False, 2: None, 3: False, 4: None}
