import json
from datetime import datetime

from colonnade.sources import files
from colonnade.streaming import ingest


def test_benchmarks(spark, tmp_path):
    one = [{"question_id": 7, "question": "q", "evidence": "e", "SQL": "select 1", "difficulty": "simple", "db_id": "a"}, {"question_id": 8, "question": "r", "evidence": "", "SQL": "select 2", "difficulty": "hard", "db_id": "b"}]
    two = [{"question": "q", "query": "select 1", "db_id": "a"}, {"question": "r", "query": "select 2", "db_id": "b"}]
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps(two))
    assert [(r.question_id, r.sql) for r in files.read_benchmark(spark, str(tmp_path / "one.json"), ["b"]).collect()] == [(8, "select 2")]
    assert [(r.question_id, r.sql, r.db_id) for r in files.read_benchmark(spark, str(tmp_path / "two.json")).collect()] == [(0, "select 1", "a"), (1, "select 2", "b")]


def test_descriptions_and_insights(spark, tmp_path):
    (tmp_path / "t1.csv").write_text('original_column_name,column_name,column_description,data_format,value_description\n"a ",a,"commonsense evidence: the\n  first",text,not useful x\n')
    r = files.read_descriptions(spark, str(tmp_path / "t1.csv")).first()
    assert (r.table_name, r.column_name, r.description, r.value_description) == ("t1", "a", "the first", "x")
    (tmp_path / "i.jsonl").write_text(json.dumps({"insight_id": "x", "retrieval_key": {"nl_triggers": ["t"]}, "guidance": {"intent": "i"}}) + "\n")
    assert files.read_insights(spark, str(tmp_path / "i.jsonl")).first().retrieval_key.nl_triggers == ["t"]


def test_few_shots(spark):
    text = "/* Answer the following: one? */\nselect 1\n\n/* Answer the following: two? */\nselect 2\n/* Answer the following: three? */\nselect "
    got = files.few_shots(spark.createDataFrame([(1, text), (2, "none")], "id int, prompt string"), "prompt").collect()
    assert [(r.id, r.question, r.sql) for r in got] == [(1, "one?", "select 1"), (1, "two?", "select 2")]


def records(spark, rows):
    return spark.createDataFrame([(i, "D", q, s, datetime(y, 1, 1)) for i, q, s, y in rows], "record_id bigint, database_id string, user_query string, generated_sql string, ts timestamp")


def test_record_store(spark, tmp_path):
    files.write_records(records(spark, [(1, "a", "s", 2020), (2, "b", "s", 2023), (3, "c", "s", 2024)]), str(tmp_path / "store"))
    assert sorted(r.record_id for r in files.read_recent(spark, str(tmp_path / "store"), 2).collect()) == [2, 3]


def test_streamed_records(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in ([(1, "How many?", "select 1", 2023), (2, "how  many", "SELECT 1", 2023)], [(3, "how many?!", "select  1", 2024), (4, "other", "select 1", 2024)]):
        records(spark, batch).write.mode("append").parquet(source)
        stream = spark.readStream.schema(records(spark, []).schema).parquet(source)
        q = ingest.start_ingest(stream, store, str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.user_query for r in spark.read.parquet(store).collect())[-1] == "other" and spark.read.parquet(store).count() == 2


def test_event_windows(spark):
    rows = [(datetime(2024, 1, 1, 0, m), "u" if m < 50 else "v", "k", 1.0) for m in (0, 5, 40, 55)]
    events = spark.createDataFrame(rows, "ts timestamp, user string, kind string, value double")
    assert [(r.n, r.total) for r in ingest.event_windows(events, "ts", "kind", "value", "1 hour").collect()] == [(4, 4.0)]
    assert sorted(r.n for r in ingest.event_sessions(events, "ts", "user").collect()) == [1, 1, 2]


def test_description_encodings(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    for name, e in (("One", "utf-8-sig"), ("two", "cp1252"), ("three", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes((head + '"Größe ",size,"commonsense evidence: café",text,Not Useful\n,,,,\n').encode(e))
    got = sorted(tuple(r) for r in files.read_descriptions(spark, f"{tmp_path}/*.csv").collect())
    assert got == [(t, "größe", "size", "café", "text", "") for t in ("one", "three", "two")]


def test_writers(spark, tmp_path):
    pairs = spark.createDataFrame([("d", "a", ["x"]), ("e", "b", None)], "database_id string, a string, methods array<string>")
    files.write_pairs(pairs, f"{tmp_path}/p")
    files.write_pairs(pairs.where("database_id = 'd'").withColumn("a", pairs.a), f"{tmp_path}/p")
    assert files.read_pairs(spark, f"{tmp_path}/p").count() == 2 and files.read_pairs(spark, f"{tmp_path}/p", "d").first().a == "a"
    files.export_csv(pairs, f"{tmp_path}/c")
    assert sorted(r.methods or "" for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").collect()) == ["", '["x"]']
    files.export_predictions(spark.createDataFrame([(1, "old", 0), (1, "new", 1)], "question_id int, sql string, seq int"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().asDict() == {"question_id": "1", "sql": "new"}
    files.write_insights(spark.createDataFrame([("i1",)], "insight_id string"), f"{tmp_path}/i")
    assert files.read_insights(spark, f"{tmp_path}/i").first().insight_id == "i1"
