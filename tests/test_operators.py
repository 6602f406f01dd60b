import pytest
from pyspark.sql import functions as F

from colonnade.functions import sqltext
from colonnade.functions import text as T
from colonnade.operators import catalog, execute, graph, memory, profile, relate, retrieve, select


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(spark, value, f):
    return frame(spark, [(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "source, target, want",
    [
        ([(k,) for k in range(200)], [(k,) for k in range(200)], "1:1"), ([(k,) for k in range(200)], [(k // 2,) for k in range(400)], "1:N"),
        ([(k // 2,) for k in range(400)], [(k,) for k in range(200)], "N:1"), ([(k // 2,) for k in range(400)], [(k // 3,) for k in range(600)], "N:M"),
        ([(1,), (2,)], [(1,), (5,)], "Lookup"), ([(1,)], [(2,)], "none"), ([(None,)], [(None,)], "none"), ([], [], "none"),
    ],
)
def test_cardinality(spark, source, target, want):
    s, t = frame(spark, source, "a int"), frame(spark, target, "b int")
    assert relate.cardinality(s, ["a"], t, ["b"]).first().cardinality == want


def test_composite_cardinality(spark):
    s = frame(spark, [(1, "x"), (1, "y"), (2, None)], "a int, b string")
    assert relate.cardinality(s, ["a", "b"], s, ["a", "b"]).first().matched == 2


def test_fanout(spark):
    a, b = frame(spark, [(1,), (1,), (2,), (3,), (None,)], "k int"), frame(spark, [(1,), (1,), (1,), (2,), (None,)], "k int")
    r = relate.fanout(a, "k", b, "k").first()
    assert (r.left_values, r.matched_values, r.max_fanout, r.right_multiplicity, r.estimated_rows, r.fanout_risk, r.filter_risk) == (3, 2, 6, 3, 7, "high", "high")
    assert relate.fanout(a.limit(0), "k", b, "k").first().match_ratio == 0


def test_profile_of_small_columns(spark):
    rows = [("ABC-1x", "u", None), ("ABC-2x", "u", None), (None, "v", None), ("", "v", None)]
    cells = profile.cells({"t": frame(spark, rows, "a string, b string, c string")}, {"t": ["a", "b", "c"]})
    stats = {r.column_name: r for r in profile.column_stats(cells).collect()}
    assert (stats["a"].total_count, stats["a"].distinct_count, stats["a"].null_count) == (3, 3, 1) and stats["c"].null_count == 4
    fix = {r.column_name: (r.fixed_prefix, r.fixed_suffix) for r in profile.fixity(cells).collect()}
    assert fix == {"a": ("ABC-", None), "b": (None, None)}
    assert [r.value for r in profile.top_values(cells, 1).where("column_name = 'b'").collect()] == ["u"]
    unique = {r.column_name: (r.is_unique, r.can_be_pk) for r in profile.key_uniqueness(cells).collect()}
    assert unique == {"a": (True, False), "b": (False, False), "c": (False, False)}


@pytest.mark.parametrize(
    "family, distinct, total, want",
    [
        ("number", 20, 15, "Categorical"), ("number", 21, 100, "Numerical"), ("number", 96, 100, "Identifier"), ("number", 95, 100, "Numerical"), ("text", 100, 1000, "Categorical"),
        ("text", 101, 1000, "Free_Text"), ("text", 951, 1000, "Identifier"), ("time", 3, 5, "Datetime"), ("text", 0, 0, "Unknown"), ("bytes", 5, 5, "Unknown"),
    ],
)
def test_semantic_type(spark, family, distinct, total, want):
    df = frame(spark, [(family, distinct, total)], "f string, d int, t int")
    assert df.select(profile.semantic_type(F.col("f"), F.col("d"), F.col("t"))).first()[0] == want


@pytest.mark.parametrize("rows, want", [([(1, 1)] * 20, "A <= B"), ([(2, 1)] * 5 + [(1, 2)] * 95, None), ([(2, 1)] * 4 + [(1, 2)] * 96, "A <= B"), ([(3, 1)] * 20, "A >= B"), ([(1, 2)] * 9, None)])
def test_constraint(spark, rows, want):
    assert relate.constraint(frame(spark, rows, "a int, b int"), "a", "b").first().constraint_type == want


@pytest.mark.parametrize("a, b, want", [(range(20), range(20), "A_subset_of_B"), (range(100), range(4, 500), "A_subset_of_B"), (range(100), range(5, 500), "overlapping"), (range(5), range(10, 20), "mutually_exclusive")])
def test_topology(spark, a, b, want):
    sides = [frame(spark, [(f" V{k}",) for k in x], "value string") for x in (a, b)]
    assert relate.set_topology(*sides).first().topology == want


def test_skip_reasons(spark):
    rows = [("is_x", "id", 2, 9), ("a_type", "id", 9, 9), ("price", "user_id", 9, 9), ("price", "total", 9, 9), ("price", "price", 9, 9), ("note", "remark_text", 9, 9), ("note", "b", 9, 9), ("id", "user_id", 9, 9), ("x", "y", 5, 9)]
    df = frame(spark, rows, "a string, b string, n int, m int")
    got = [r[0] for r in df.select(relate.skip_reason(*[F.col(c) for c in "abnm"])).collect()]
    assert got == ["boolean_or_binary", "type_attribute_not_join_key", "metric_to_id_mismatch", "both_are_metrics", None, "both_are_attributes", "attribute_column_not_join_key", None, "low_cardinality_attribute"]


def test_result_equality(spark):
    a = frame(spark, [(1, "x"), (2, None), (1, "x")], "i int, s string")
    b = frame(spark, [("x", 1.0), (None, 2.0)], "s string, d double")
    assert execute.ex_set_equal(a, b) and not execute.bag_equal(a, b) and not execute.positional_equal(a, b) and not execute.positional_set_equal(a, b)
    c = a.orderBy(F.desc("i"))
    assert execute.positional_equal(a, c) and execute.bag_equal(a, c) and execute.positional_set_equal(a, c)
    key = lambda d: execute.result_key(d).first()[0]
    assert key(a) == key(c) == key(a.distinct()) != key(a.limit(0)) and key(a.limit(0)) is not None


def test_run_and_timeout(spark):
    assert execute.run(spark, "select 1 as a, 2 as a;").result_type == "success"
    assert execute.run(spark, "select cast(null as int) as a").result_type == "all_null_result"
    assert execute.run(spark, "select max(sqrt(id * 3.7)) from range(200000000)", timeout=0.05).result_type == "timeout"
    r = execute.run(spark, "select nothing")
    assert r.result_type == "execution_error" and r.error


def test_trimmed_time(spark):
    log = frame(spark, [("a", 1.0)] * 3 + [("b", None)] + [("c", 1.0)] * 20 + [("c", 500.0)], "q string, ms double")
    got = {r.q: r.mean_ms for r in execute.trimmed_time(log, ["q"], "ms").collect()}
    assert got == {"a": 1.0, "b": float("inf"), "c": 1.0}


def candidates(spark, results):
    rows = [("q", i, r is not None, n, float(10 - i), r) for i, (r, n) in enumerate(results)]
    return frame(spark, rows, "question string, candidate int, succeeded boolean, rows int, ms double, result string")


@pytest.mark.parametrize(
    "results, decision, first",
    [
        ([("x", 1)] * 3 + [("y", 1), ("z", 2)], "vote", 0), ([("y", 1)] + [("x", 1)] * 4, "select", 1), ([("e", 0), ("e", 0)], "select", 0), ([(None, 0)] * 2, "fallback", None),
        ([("e", 0), ("x", 3)], "select", 1),
    ],
)
def test_selection(spark, results, decision, first):
    rows = candidates(spark, results)
    groups = select.consensus(rows)
    assert select.shortcut(groups, rows).first().decision == decision
    best = select.ranked(groups, 1).collect()
    assert [r.representative for r in best] == ([] if first is None else [first])


def test_votes(spark):
    votes = frame(spark, [("q", 0, 1, "m", "A"), ("q", 0, 2, "m", "TIE"), ("q", 1, 2, "m", "B"), ("q", 0, 1, "n", "B")], "question string, a int, b int, voter string, outcome string")
    wins = {r.candidate: r.win for r in select.win_matrix(votes).collect()}
    assert {k: round(v, 6) for k, v in wins.items()} == {0: round(1 / 3, 6), 1: round(0.5 / 3, 6), 2: 0.5}
    with pytest.raises(Exception, match="unknown vote"):
        select.vote_scores(votes.withColumn("outcome", F.lit("C"))).collect()


def test_geometric_median(spark):
    got = select.geometric_median(frame(spark, [("g", [1.0, 2.0]), ("g", [3.0, 4.0]), ("g", [5.0, 6.0])], "g string, v array<double>"), "g", "v").first().median
    assert [round(x, 3) for x in got] == [3.0, 4.0]


def fold(spark, steps):
    rows = [("e", "f", v, s, i) for i, (v, s) in enumerate(steps)]
    r = memory.resolve_versions(frame(spark, rows, "entity string, field string, value string, source string, seq int")).first()
    return r.value


def test_version_fold(spark):
    assert fold(spark, [("", "ddl"), ("x", "llm"), ("y", "llm")]) == "x"
    assert fold(spark, [("m", "manual"), ("x", "llm")]) == "m"
    assert fold(spark, [("x", "llm"), ("m", "manual"), ("p", "profiling")]) == "p"
    assert fold(spark, [("x", "manual"), ("y", "manual")]) == "y"


def test_pairs_and_upsert(spark):
    pairs = frame(spark, [("a", "b", "m1", 0.8), ("b", "a", "m2", 0.7), ("c", "d", "m1", 0.0)], "a string, b string, method string, score double")
    got = {(r.a, r.b): (r.methods, r.score) for r in memory.merge_pairs(pairs).collect()}
    assert got == {("a", "b"): (["m1", "m2"], 0.8), ("c", "d"): (["m1"], None)}
    assert {r.score for r in memory.merge_pairs(pairs, zero_is_null=False).collect()} == {0.8, 0.0}
    old, new = frame(spark, [(1, "x", "y"), (2, "z", None)], "k int, a string, b string"), frame(spark, [(1, None, "w"), (3, "n", None)], "k int, a string, b string")
    assert sorted(tuple(r) for r in memory.upsert(old, new, ["k"]).collect()) == [(1, "x", "w"), (2, "z", None), (3, "n", None)]


def test_record_dedup(spark):
    rows = frame(spark, [(1, "How many?!"), (2, " how   MANY"), (3, "other"), (4, "known")], "id int, q string")
    old = frame(spark, [(0, "Known?")], "id int, q string")
    assert sorted(r.id for r in memory.dedup_records(old, rows, [T.normalise_question(F.col("q"))], "id").collect()) == [1, 3]


def test_fusion(spark):
    hits = [("q", "m1", 1, 0.9, False), ("q", "m1", 2, 0.9, False), ("q", "m2", 1, 0.2, True), ("q", "m3", 1, 5.0, False)]
    got = {r.doc: r.score for r in retrieve.rrf(frame(spark, hits, "query string, method string, doc int, score double, matched boolean")).collect()}
    assert got == {1: round(1.5 * 3 / 61, 8), 2: round(1 / 62, 8)}
    limited = retrieve.value_aware_limit(frame(spark, [("q", d, float(d), d < 3) for d in range(20)], "query string, doc int, score double, matched boolean"), 6).collect()
    assert sorted(r.doc for r in limited) == [0, 1, 2, 17, 18, 19]


@pytest.mark.parametrize("value, phrase, hit", [("abcdefghij", "abcd", True), ("abcdefghijk", "abcd", False), ("abc", "xabcx", True), ("ab", "abc", False), ("abc", "abc", False), ("zabcz", "abc", True)])
def test_partial_match(spark, value, phrase, hit):
    index = retrieve.value_index(frame(spark, [("t", "c", value)], "table_name string, column_name string, value string"))
    assert retrieve.partial_matches(index, frame(spark, [(1, phrase)], "query int, phrase string")).count() == hit


def test_partial_match_limit(spark):
    index = retrieve.value_index(frame(spark, [("t", "c", f"abcd{k}") for k in range(25)], "table_name string, column_name string, value string"))
    assert retrieve.partial_matches(index, frame(spark, [(1, "abcd")], "query int, phrase string")).count() == 20


def test_dense_search(spark):
    docs = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "doc bigint, vector array<double>")
    queries = frame(spark, [(k, [1.0, 0.2 * k]) for k in range(5)] + [(9, None), (10, [0.0, 0.0])], "query bigint, vector array<double>")
    got = retrieve.dense_search(spark, docs, queries, 2, block=2).collect()
    assert len(got) == 10 and {r.doc for r in got if r.query == 0 and r.rank == 1} == {1}
    assert retrieve.dense_search(spark, docs, queries.limit(0), 2).count() == 0


def test_text_functions(spark):
    assert column(spark, "paid '5' on 2020-01-02, 7.5 or $9", T.mask_values) == "paid <unk> on <unk>, <unk> or $<unk>"
    assert column(spark, "  What   is it ?!  ", T.normalise_question) == "what is it"
    assert column(spark, "x <result> select 1 </result>", T.extract_result) == "select 1" and column(spark, "```sql\nselect 2\n```", T.extract_result) == "select 2"
    assert column(spark, "so {\"a\": {\"b\": 1}} it is", T.extract_json) == '{"a": {"b": 1}}' and column(spark, "none", T.extract_json) is None
    assert [tuple(r) for r in column(spark, "table=t1, column=c 1; table= t2, column=c2", T.term_columns)] == [("t1", "c 1"), ("t2", "c2")]
    pair = frame(spark, [("a a b", "a b c", "", " ")], "x string, y string, e string, s string")
    s = lambda a, b: pair.select(T.bag_similarity(F.col(a), F.col(b))).first()[0]
    assert s("x", "y") == 0.5 and s("x", "e") == 0 and s("s", "s") == 1


def test_sql_text(spark):
    assert column(spark, "SELECT a.x, b.y FROM t AS a JOIN u AS b ON a.i = b.i WHERE a.x > 3 AND b.y = 'z'", sqltext.skeleton) == "select _ from _ join _ where _ > _ and _ = _"
    assert column(spark, "select t.* from t", sqltext.checks) == "select"
    assert column(spark, "select a from t order by max(b) limit 1", sqltext.checks) == "order_by_limit"
    assert column(spark, "select a from t join u on t.a = u.b or t.a = u.c", sqltext.checks) == "join"
    nulls = {"SELECT a FROM t ORDER BY a LIMIT 3": "order_by_null", "SELECT SUM(x) FROM t ORDER BY a LIMIT 3": "order_by_null", "SELECT a FROM t ORDER BY SUM(a) LIMIT 3": "", "select a from t order by a limit 3": "", "SELECT a FROM t ORDER BY a DESC LIMIT 3": ""}
    assert {s: column(spark, s, sqltext.checks) for s in nulls} == nulls
    assert column(spark, "select a || ' ' || b from t", sqltext.split_joined_texts) == "select a ,  b from t"
    assert column(spark, 'select a from t where b like "x%"', sqltext.repair_like) == "select a from t where b LIKE 'x%'"
    assert column(spark, "select 1 where strftime('%Y', date(d)) >= 2010 and strftime('%m', d) = 12 and x = 2011", sqltext.quote_time) == "select 1 where strftime('%Y', date(d)) >= '2010' and strftime('%m', d) = 12 and x = 2011"


def test_descriptions(spark):
    assert column(spark, "a\nb commonsense evidence: z", T.normalise_description) == "a b z"
    assert column(spark, "not useful\r\nCommonsense Evidence:  x", T.normalise_description) == "not useful Commonsense Evidence: x"


def test_only_queries_run(spark):
    frame(spark, [(1,)], "a int").createOrReplaceTempView("kept_view")
    for text in ("drop view kept_view", "create temp view other as select 1", "insert into kept_view select 2", "with x as (select 1) insert into kept_view select * from x", "set a.b = c"):
        assert execute.run(spark, text).result_type == "execution_error"
    assert execute.run(spark, "with x as (select a from kept_view) select * from x union all select 2;").rows == 2


def test_runs_are_remembered(spark):
    r = execute.Runs(spark, most=2)
    assert r.run("select 1") is r.run(" select  1") and r.first_rows("select explode(array(1, 2, 3)) as x order by x", 2) == [(1,), (2,)]
    assert r.check("select null as x") == {"syntax": True, "result": False} and r.check("selec") == {"syntax": False, "result": False}
    assert r.choose(["selec", "select 2", "select 1 + 0", "select 1"]) == "select 1 + 0" and r.choose(["selec"]) is None and len(r.known) == 2
    assert execute.repeat_times(spark, "select 1", 2) < 60_000 and execute.repeat_times(spark, "selec", 2) == float("inf")


def test_sessions_one_by_one(spark):
    shape = "n int, s string, k string"
    for rows, want in (([(1, "s1", "k1"), (2, "s1", "k2"), (3, "s2", "k2")], [1, 3]), ([(1, "s1", "k1"), (2, "s2", "k1"), (3, "s2", "k3"), (4, None, "k4"), (5, None, "k5"), (6, "old", "k6"), (7, "s7", "known")], [1, 3, 4, 5])):
        got = memory.dedup_sessions(frame(spark, [(0, "old", "known")], shape), frame(spark, rows, shape), F.col("s"), [F.col("k")], "n")
        assert sorted(r.n for r in got.collect()) == want


def test_empty_values(spark):
    df = frame(spark, [(" ", float("nan"), [], {}, None), ("x", 0.0, [1], {"a": "b"}, 1)], "a string, b double, c array<int>, d map<string,string>, e int")
    assert [list(r) for r in df.select(*[memory.empty_value(df, c).alias(c) for c in df.columns]).collect()] == [[True] * 5, [False] * 5]


def test_ranks_of_large_groups(spark):
    rows = frame(spark, [("a" if i % 3 else "b", i * 7 % 1000) for i in range(1000)], "g string, n int").repartition(5)
    for down in (False, True):
        got = {(r.g, r.n): r._r for r in memory.ranked(rows, "g", "n", down).collect()}
        for g in "ab":
            ns = sorted((n for h, n in got if h == g), reverse=down)
            assert [got[g, n] for n in ns] == list(range(1, len(ns) + 1))
    assert memory.ranked(rows.limit(0), "g", "n").count() == 0


def test_catalog(spark):
    tables = {"a": frame(spark, [], "id bigint, b_id bigint, note string"), "b": frame(spark, [], "id bigint, x double")}
    columns, pks = catalog.columns_frame(spark, tables), catalog.primary_keys_frame(spark, [("a", ["id"]), ("b", ["id"])])
    fks = frame(spark, [(0, 0, "a", "b_id", "b", None), (1, 0, "a", "gone", "b", "id"), (0, 0, "a", "b_id", "b", None)], "fk_id int, seq int, table_name string, column_name string, target_table string, target_column string")
    fixed = catalog.repair_foreign_keys(fks, pks, columns).collect()
    assert [(r.column_name, r.target_column) for r in fixed] == [("b_id", "id")]
    assert catalog.ddl(tables["b"], "b", ["id"]) == "CREATE TABLE b (\n  id BIGINT,\n  x DOUBLE,\n  PRIMARY KEY (id)\n)"


def test_column_groups(spark):
    links = frame(spark, [("b", "a"), ("b", "c"), ("x", "x"), (None, "y"), ("q", "p")], "a string, b string")
    assert {tuple(r) for r in graph.column_groups(spark, links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")}
