import pytest

from colonnade.functions import sqlparse
from colonnade.plans.sqltext_queries import schema_overlap


@pytest.mark.parametrize(
    ("sql", "columns"),
    [
        ("select A, sum(\"b\") as total from T where c = 'x.y' group by a order by total desc limit 3", ["t.a", "t.b", "t.c"]),
        ("select x.a, u.b from t as x join u on x.id = u.id where x.a > 1.5", ["t.a", "t.id", "u.b", "u.id"]),
        ("select a, y.b from t join u y on t.id = y.id", [".a", "t.id", "u.b", "u.id"]),
        ("```sql\nwith p as (select t1.a from t as t1 -- no.comment\n where b is null) select * from p\n```", ["t.a", "t.b"]),
        ("select count(*) from t", []),
    ],
)
def test_columns_of(spark, sql, columns):
    got = sqlparse.analyse(spark.createDataFrame([(sql,)], "s string"), "s").first().analysis
    assert sorted({f"{c.table_name}.{c.column_name}" for c in got.columns}) == columns


def test_columns_count_in_the_overlap(spark, tmp_path):
    rows = [
        (1, "d", "same tables, other columns", True, "select a from t"), (2, "d", "same tables, other columns", False, "select b from t"),
        (3, "D", "same columns", True, "select t.a, t.b from t"), (4, "d", "same columns", False, "select b, a from t"),
        (5, "d", "half of the columns", True, "select x.a, x.b from t x"), (6, "d", "half of the columns", False, "select a from t where 'b' <> 'c'"),
        (7, "d", "neither", True, "select a from t"), (8, "d", "neither", False, "select a from u"),
        (9, "d", "only right", True, "select a from t"),
    ]
    spark.createDataFrame(rows, "record_id bigint, database_id string, user_query string, label boolean, generated_sql string").write.parquet(f"{tmp_path}/episodic_record.parquet")
    got = {r.question: r.overlap for r in schema_overlap(spark, str(tmp_path)).collect()}
    assert got == {"d|same tables, other columns": 0.6, "d|same columns": 1.0, "d|half of the columns": 0.8, "d|neither": 0.0}
