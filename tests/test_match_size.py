"""Matches of many values that look alike, and of many episodes of one database."""

import math
from random import Random

import pytest

from colonnade.operators import match, retrieve
from colonnade.plans.queries import ORACLE, QUERIES
from tests.oracle import connect, same
from tests.test_keyword import shuffled


def cpu(spark) -> float:
    """CPU seconds of all stages so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).executorCpuTime() for i in range(stages.size())) / 1e9


def names(spark, n: int):
    """Values that share a word and a beginning, and a phrase for each: of every third its end is missing."""
    values = retrieve.value_index(spark.range(n).selectExpr("'t' as table_name", "'c' as column_name", "concat('Customer#', lpad(id * 1009 % 1000000, 9, '0')) as value"))
    return values, values.selectExpr("value as query", "case when crc32(value) % 3 = 0 then substring(value, 1, 16) else value end as phrase")


def test_fuzzy_values_with_a_common_word(spark):
    values, phrases = names(spark, 10_000)
    before = cpu(spark)
    assert match.fuzzy_matches(values, phrases).count() == 0
    assert cpu(spark) - before < 30


def test_partial_values_with_a_common_beginning(spark):
    values, phrases = names(spark, 10_000)
    before = cpu(spark)
    short = phrases.where("length(phrase) = 16").select("phrase").distinct()
    want = short.join(values, values.norm.startswith(retrieve.F.lower("phrase"))).groupBy("phrase").count().selectExpr("sum(least(count, 20))").first()[0]
    before = cpu(spark)
    got = retrieve.partial_matches(values, short.selectExpr("phrase as query", "phrase")).count()
    whole = retrieve.partial_matches(values, phrases.where("length(phrase) > 16")).count()
    assert (got, whole) == (want, 0)
    assert cpu(spark) - before < 20


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("names"))
    from colonnade.plans.profile_queries import COLUMNS
    from colonnade.sources.tables import table
    from tests.oracle import DATA

    for t in COLUMNS:
        df = table(spark, DATA, t)
        if t == "customer":
            df = df.limit(1).crossJoin(spark.range(2500).withColumnRenamed("id", "i")).selectExpr("cast(i as {}) as c_custkey".format(dict(df.dtypes)["c_custkey"]), "concat('Customer#', lpad(i * 7, 9, '0')) as c_name", *[c for c in df.columns if c not in ("c_custkey", "c_name")])
        df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
    rows = [(i, "Harbor", f"how many {w} entries are there", f"select a, count(*) from t{i} where b > {i} {'and c = 1 ' * (i % 4)}", i % 5 != 0) for i, w in ((i, ("open", "late", "open late", "")[i % 4]) for i in range(2000))]
    rows.append((2100, "Harbor", "how many open entries", "", True))
    spark.createDataFrame(rows, "record_id bigint, database_id string, user_query string, generated_sql string, label boolean").coalesce(2).write.parquet(f"{d}/episodic_record.parquet")
    return d


@pytest.mark.parametrize("name", ["nearest_values", "value_linked_columns", "values_of_columns"])
def test_nearest_pairs_are_not_shuffled(spark, directory, name):
    before = shuffled(spark)
    same(spark, name, QUERIES[name], ORACLE[name], connect(directory), directory)
    assert shuffled(spark) - before < 2500 * 25


def test_episodes_without_a_skeleton(spark, directory):
    same(spark, "same_database_episodes", QUERIES["same_database_episodes"], ORACLE["same_database_episodes"], connect(directory), directory)


def test_episodes_meet_in_lists(spark, directory):
    """Of 20 questions and 1,600 episodes no pair is a row of a join."""
    df = QUERIES["same_database_episodes"](spark, directory)
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        if "Join" in kind:
            rows = max(rows, x.metrics().apply("numOutputRows").value())
        todo += [x.children().apply(i) for i in range(x.children().size())]
    assert rows < 10_000


def test_nearest_values_of_a_piece(monkeypatch):
    """As over all pairs, and only phrases are taken apart run by run."""
    random, taken, plain = Random(7), [], match.Counter
    text = lambda: ("Code#00" * (random.random() < 0.8) + "".join(random.choice("01aé ") for _ in range(random.randint(1, 6)))).strip().lower() or "a"
    norms, asked = sorted(text() for _ in range(1500)), [text() for _ in range(60)] + ["", "zz"]
    runs = lambda t: plain(f" {t} "[i : i + 3] for i in range(len(t)))
    all_runs = [runs(t) for t in norms]
    norm = lambda x: math.sqrt(sum(c * c for c in x.values()))
    want = []
    for q, p in enumerate(map(runs, asked)):
        dots = [sum(c * x[g] for g, c in p.items() if g in x) for x in all_runs]
        scored = [(math.floor(d / (norm(p) * norm(x)) * 1e6 + 0.5) / 1e6, i) for i, (d, x) in enumerate(zip(dots, all_runs)) if d]
        want += [(q, i, s) for s, i in sorted((x for x in scored if x[0] >= 0.3), key=lambda x: (-x[0], x[1]))[:3]]
    monkeypatch.setattr(match, "Counter", lambda x: taken.append(1) or plain(x))
    got = sorted(zip(*match._nearest(norms, asked, 3, 0.3)), key=lambda r: (r[0], -r[2], r[1]))
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 1e-9
    assert len(taken) <= len(asked)
