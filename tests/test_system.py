import pytest
from pyspark.sql import functions as F

from colonnade.operators import catalog, match, report, store
from colonnade.system import Generator, NameLinker, RuleChecker, RuleModel, System, candidates_of, linked_union

RECORDS = "record_id bigint, session_id string, database_id string, user_query string, generated_sql string, label boolean"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def state(df):
    return {(r.kind, r.entity, r.field): (r.value, r.source) for r in store.current(df).collect()}


def test_versions_and_counts(spark):
    rows = [("column", "d.t.a", "description", v, s, n) for n, (v, s) in enumerate([("", "ddl"), ("x", "llm"), ("y", "llm")])]
    rows += [("column", "d.t.a", "null_count", "5", "ddl", 1), ("column", "d.t.a", "null_count", "7", "llm", 2), ("column", "d.t.b", "description", "m", "manual", 1), ("column", "d.t.b", "description", "l", "llm", 2)]
    s = frame(spark, rows, store.SHAPE)
    assert state(s) == {("column", "d.t.a", "description"): ("x", "llm"), ("column", "d.t.a", "null_count"): ("7", "llm"), ("column", "d.t.b", "description"): ("m", "manual")}
    assert state(s.union(store.update("column", "D.T.B", "description", "new", "manual", s)))["column", "d.t.b", "description"] == ("new", "manual")
    with pytest.raises(ValueError):
        store.update("column", "d.t.b", "colour", "red", "manual", s)
    one = frame(spark, [("d.t.b",)], "entity string")
    assert ("column", "d.t.b", "description") not in state(store.clear(s, "column", "description", one)) and ("column", "d.t.a", "description") in state(store.clear(s, "column", "description", one))
    kept = store.clear(s, "column", "description", one, versions=False)
    assert state(kept)["column", "d.t.b", "description"] == ("", "manual")
    assert state(store.delete_database(s, "D")) == {} and len(state(store.delete_database(s, "d.t"))) == 0 and len(state(store.delete_database(s, "other"))) == 3
    got = store.project(store.current(s), "column", ["description", "null_count"], one).collect()
    assert [tuple(r) for r in got] == [("d.t.b", "m", None)]


def test_tags_encodings_and_terms(spark):
    shape = "a array<struct<type:string,content:string,source:string,n:int>>, b array<struct<type:string,content:string,source:string,n:int>>"
    df = frame(spark, [([("t", "x", "s", 1)], [("t", "x", "s", 2), ("t", "y", "s", 3), ("t", "y", "s", 4)]), (None, [("t", "x", "s", 1)])], shape)
    assert [[t.n for t in r[0]] for r in df.select(store.append_tags(F.col("a"), F.col("b"))).collect()] == [[1, 3], [1]]
    maps = frame(spark, [({"A": "alpha", "B": "beta", "never": "x", "a sentence " * 20: "y"}, ["a", "b1"]), ({"A": "alpha", "Q": "q"}, ["a"])], "m map<string,string>, s array<string>")
    got = [r.m for r in store.filter_encodings(maps, "m", "s").collect()]
    assert got == [{"A": "alpha", "B": "beta"}, None]
    assert [e.key for e in maps.limit(1).select(store.lookup(F.col("m"), F.lit(" BETA"))).first()[0]] == ["B"]
    texts = frame(spark, [(1, "net pay = gross - tax; cheap refers to price < 5"), (2, None), (3, "nothing here")], "i int, e string")
    assert sorted(tuple(r) for r in store.terms(texts, "e").collect()) == [(1, "cheap", "price < 5"), (1, "net pay", "gross - tax")]
    whole, share = store.pattern_share(F.col("v"), "[0-9]{2}")
    assert tuple(frame(spark, [("12",), ("3",), (None,), ("45",)], "v string").agg(whole, share).first()) == (False, pytest.approx(2 / 3))


def test_matching(spark):
    hits = frame(spark, [(1, "t", "a", None, None, 0.9), (1, "t", "a", "v", None, 0.2), (1, "t", "b", None, "e", 0.1), (1, "t", "b", None, None, 0.8)], "query int, table_name string, column_name string, value string, encoding string, score double")
    assert sorted((r.column_name, r.score) for r in match.representatives(hits).collect()) == [("a", 0.2), ("b", 0.1)]
    lists = frame(spark, [(["x", "y"], ["y", "z"]), (None, ["q"])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(match.values_first(F.col("a"), F.col("b"), 2)).collect()] == [["x", "y"], ["q"]]
    q = frame(spark, [(1, ["s", "f"], ["r"]), (2, [], [])], "query int, shape array<string>, atoms array<string>")
    i = frame(spark, [("i", ["s", "f"], ["s"], ["r", "u"]), ("j", ["zz"], None, [])], "insight string, wrong_shape array<string>, right_shape array<string>, atoms array<string>")
    assert [tuple(r) for r in match.guidance_scores(q, i).collect()] == [(1, "i", 0.85)]


def test_reports(spark):
    df = frame(spark, [(2, "a|b", "x" * 50), (1, None, "y")], "k int, v string, w string")
    assert report.markdown(df, ["k"], columns=3, width=5).first().text == "| k | v | w |\n|---|---|---|\n| 1 | NULL | y |\n| 2 | a/b | xxxxx... |"
    tables = {"a": frame(spark, [], "b_id bigint, id bigint"), "b": frame(spark, [], "id bigint")}
    fks = catalog.foreign_keys_frame(spark, [("a", ["b_id"], "b", ["id"])])
    text = {r.table_name: r.text for r in report.schema_text(catalog.columns_frame(spark, tables), catalog.primary_keys_frame(spark, [("a", ["id"]), ("b", ["id"])]), fks).collect()}
    assert text == {"a": "Table a\n  id BIGINT PRIMARY KEY\n  b_id BIGINT\nForeign keys:\n  a.b_id -> b.id", "b": "Table b\n  id BIGINT PRIMARY KEY"}
    rows = frame(spark, [("a", "b", "overlapping", None, "high")], "column_a string, column_b string, topology string, constraint_type string, sensitivity string")
    assert report.guidance_text(rows).first().guidance == "a and b are easily confused: their values overlap. The choice changes the result."
    cols = frame(spark, [("d", "orderItem", "unit_price", None, ["1", "2"])], "doc string, table_name string, column_name string, description string, examples array<string>")
    assert sorted((r.facet, r.text) for r in report.facets(cols).collect()) == [("names", "order Item unit price"), ("values", "1, 2")]
    values = frame(spark, [("$1,200", "number"), ("O'Hara", "text"), ("abc", "number")], "v string, f string")
    assert [r[0] for r in values.select(report.sql_literal(F.col("v"), F.col("f"))).collect()] == ["1200", "'O''Hara'", "'abc'"]


def test_system(spark):
    records = frame(spark, [(1, "shop_000004", "shop", "how many orders", "select count(*) from orders", True), (2, None, "other", "names of people", "select name from people", True)], RECORDS)
    s = System(spark, records)
    with pytest.raises(ValueError):
        s.start_session()
    s.bind_database("Shop", {"orders": frame(spark, [(1, "x"), (2, None)], "order_id bigint, note string")})
    assert s.start_session() == "shop_000005"
    new = s.store_round(frame(spark, [(3, None, "SHOP", "How many orders?", "SELECT count(*)  FROM orders", False), (4, None, "shop", "all notes", "select note from orders", None)], RECORDS))
    assert [r.record_id for r in new.collect()] == [4] and s.records.count() == 3
    hits = s.retrieve_memory(frame(spark, [(9, "how many orders are there")], "query int, text string")).collect()
    assert [(r.doc, r.same) for r in hits][:1] == [(1, True)]
    a = s.identify_mapping(frame(spark, [("select note from orders",)], "q string"), "q").first().mapping
    assert [(c.table_name, c.column_name) for c in a.columns] == [("orders", "note")]
    assert s.generate_metadata().count() == 2 * 4
    s.import_metadata(frame(spark, [("Orders", "Order-ID", "the key"), ("orders", "nothing", "x")], "table_name string, column_name string, description string"))
    got = {r.entity: (r.description, r.distinct_count) for r in s.get_schema_metadata(["description", "distinct_count"]).collect()}
    assert got == {"shop.orders.order_id": (None, "2"), "shop.orders.note": (None, "1")} or got["shop.orders.note"] == (None, "1")
    s.delete_semantic_field("distinct_count")
    assert s.get_schema_metadata(["distinct_count"]).count() == 0
    todo = s.unfinished(frame(spark, [(1,), (2,), (3,)], "question_id int"), frame(spark, [(1, True), (2, False)], "question_id int, succeeded boolean"))
    assert sorted(r.question_id for r in todo.collect()) == [2, 3]
    with pytest.raises(ValueError):
        s.retrieve_sql_guidance(frame(spark, [], "query int, shape array<string>, atoms array<string>"))
    s.finalize_session()


def test_models_and_extensions(spark):
    df = frame(spark, [("a",), (None,), ("a",), ("b",)], "p string")
    assert [r.response for r in RuleModel(str.upper).map(df, "p").collect()] == ["A", None, "A", "B"]
    assert RuleChecker().check(frame(spark, [("select t.* from t",)], "q string"), "q").first().failed == "select"
    links = NameLinker([("people", "name"), ("people", "age")]).link(frame(spark, [(1, "SELECT Name FROM People")], "i int, q string"), "q")
    assert [(r.i, r.table_name, r.column_name) for r in links.collect()] == [(1, "people", "name")]
    assert linked_union(links, frame(spark, [("PEOPLE", "NAME"), ("x", "y")], "table_name string, column_name string")).count() == 2

    class Fixed(Generator):
        def generate(self, df):
            return df.select("p", F.lit("select 1").alias("sql"))

    assert candidates_of([Fixed(), Fixed()], df).count() == 8
