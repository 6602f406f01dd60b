import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colonnade.operators.quality import load_findings, load_values, profile_files, write_clustered
from colonnade.plans.scratch import Scratch
from colonnade.sources.footers import dictionary, statistics

PROFILE = "column_id bigint, load_no int, data_format string, min_value double, max_value double, value_statistics struct<total_count:bigint,distinct_count:bigint,null_count:bigint>"


def write(path, rows, **options):
    """Rows (column_id, load_no, row_no, value), each list a row group."""
    schema = pa.schema([("column_id", pa.int64()), ("load_no", pa.int32()), ("row_no", pa.int32()), ("value", pa.string()), ("arrived_at", pa.timestamp("us"))])
    path.mkdir(exist_ok=True)
    with pq.ParquetWriter(path / f"part-{len(list(path.iterdir()))}.parquet", schema, **options) as w:
        for group in rows:
            w.write_table(pa.Table.from_pydict({n: [r[i] if i < 4 else None for r in group] for i, n in enumerate(schema.names)}, schema))


def brute_loads(groups):
    cells = {}
    for c, l, r, v in (x for g in groups for x in g):
        if None not in (c, l, r):
            old = cells.get((c, l, r))
            cells[c, l, r] = v if old is None else old if v is None else min(old, v)
    out = {}
    for (c, l, _), v in cells.items():
        out.setdefault((c, l), []).append(v)
    return {k: (len(v), v.count(None), len(set(v) - {None})) for k, v in out.items()}


@pytest.mark.parametrize("dictionaries", [True, False])
def test_settled_loads_and_scanned_ones(spark, tmp_path, dictionaries):
    r = random.Random(1)
    own = [[(c, l, k, None if k % 7 == 0 else f"v{r.randrange(40)}") for k in range(200)] for c in range(3) for l in (1, 2)]
    few = [[(10, 1, k, "ab"[k % 2]) for k in range(50)]]
    mixed = [[(r.randrange(20, 23), 1, k, f"x{k % 9}") for k in range(60)] + [(20, 1, 3, "again"), (21, None, 1, "x"), (None, 1, 1, "x")]]
    write(tmp_path / "v", own + few, use_dictionary=dictionaries)
    write(tmp_path / "v", mixed, use_dictionary=dictionaries)
    got = load_values(spark, str(tmp_path / "v"), Scratch(spark))
    loads = {(x.column_id, x.load_no): (x.rows, x.nulls, x.distinct) for x in got.loads.collect()}
    assert loads == brute_loads(own + few + mixed)
    assert got.settled == (6 if dictionaries else 0)  # the loads with rows in groups of several are open
    values = {(x.column_id, x.load_no, x.value) for x in got.values.collect()}
    assert {(c, l, v) for g in own for c, l, _, v in g if v is not None} <= values


def test_row_delivered_twice_in_another_file(spark, tmp_path):
    one = [[(1, 1, k, f"v{k}") for k in range(30)]]
    write(tmp_path / "v", one)
    write(tmp_path / "v", [[(1, 1, 5, "v5"), (1, 1, 40, None)]])
    loads = load_values(spark, str(tmp_path / "v"), Scratch(spark))
    assert loads.settled == 0 and loads.loads.collect() == [(1, 1, 31, 1, 30)]


def test_findings(spark, tmp_path):
    rows = [(1, 1, k, "AB-1" if k else "AB-x") for k in range(10)] + [(2, 1, k, str(k - 2)) for k in range(10)] + [(2, 3, k, None if k < 3 else "5") for k in range(10)]
    rows += [(3, 1, k, "ab"[k % 2]) for k in range(20)] + [(3, 2, k, "a" if k < 19 else "b") for k in range(20)] + [(4, 1, 0, ""), (4, 1, 1, "é"), (4, 1, 1, "é")]
    write(tmp_path / "v", [rows])
    profile = [
        (1, 1, "AA-9", None, None, (10, 2, 0)), (2, 1, "INT", -1.0, 7.0, (10, 10, None)), (2, 3, "INT", None, None, (10, 1, 2)), (3, 1, None, None, None, None),
        (3, 2, None, None, None, (20, 3, 0)), (4, 1, "9", None, None, (2, 2, 0)), (5, 1, "INT", 0.0, 1.0, (0, 0, 1)), (6, 1, "INT", 0.0, 1.0, (0, 0, 0)),
    ]
    df = spark.createDataFrame(profile, PROFILE).selectExpr("*", "1 as rows", "2 as nulls", "3 as value")
    got = sorted(tuple(r) for r in load_findings(spark, df, str(tmp_path / "v")).collect())
    assert got == sorted([
        (1, 1, "format"), (2, 1, "range"), (2, 3, "null_count"), (2, 3, "drift"), (3, 2, "distinct_count"), (3, 2, "drift"), (4, 1, "format"), (5, 1, "null_count"),
    ])


def test_exactly_at_the_limits(spark, tmp_path):
    rows = [(1, 1, k, None if k < 2 else "a") for k in range(8)] + [(1, 2, k, None if k < 4 else "a") for k in range(8)]  # nulls move by .25
    rows += [(2, 1, k, "a") for k in range(20)] + [(2, 2, k, "a" if k < 11 else "b") for k in range(20)]  # values move by .45
    write(tmp_path / "v", [rows])
    df = spark.createDataFrame([(c, l, None, None, None, None) for c in (1, 2) for l in (1, 2)], PROFILE)
    assert sorted(tuple(r) for r in load_findings(spark, df, str(tmp_path / "v")).collect()) == [(1, 2, "drift"), (2, 2, "drift")]


def test_empty_tables(spark, tmp_path):
    write(tmp_path / "v", [[]])
    df = spark.createDataFrame([(1, 1, "INT", 0.0, 1.0, (0, 0, 0))], PROFILE)
    assert load_findings(spark, df, str(tmp_path / "v")).count() == 0
    assert load_findings(spark, df.limit(0), str(tmp_path / "v")).count() == 0


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd", "gzip"])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_dictionary_pages(tmp_path, codec, version):
    table = pa.table({
        "s": ["a", None, "b", "é" * 400, "a"] * 50, "i": pa.array([1, 2, None, 2, 1] * 50, pa.int32()), "l": pa.array([2**40, 1, 1, None, 5] * 50), "f": [0.5, 1.5, None, -2.0, 0.5] * 50,
        "many": [f"{k:06d}-{'x' * 40}" for k in range(250)],
    })
    pq.write_table(table, tmp_path / "t.parquet", compression=codec, data_page_version=version, dictionary_pagesize_limit=4000, write_batch_size=32)
    with pa.OSFile(str(tmp_path / "t.parquet")) as f:
        group = pq.ParquetFile(f).metadata.row_group(0)
        for i, name in enumerate(table.column_names):
            got = dictionary(f, group.column(i))
            if name == "many":
                assert got is None  # it outgrew its dictionary
                continue
            values = [v.decode() if isinstance(v, bytes) else v for v in got.to_pylist()]
            assert sorted(values) == sorted(set(table[name].drop_null().to_pylist()))
            assert statistics(group.column(i))[0] == table[name].null_count


def test_profile_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    n = 400
    table = pa.table({
        "id": np.arange(n), "word": [None if k % 5 == 0 else f"w{k % 13}" for k in range(n)], "x": [float("nan") if k == 3 else k / 4 for k in range(n)], "none": pa.nulls(n, pa.int32()),
        "day": pa.array(range(n), pa.date32()), "list": [[k] for k in range(n)], "text": [f"{k}" * 30 for k in range(n)], "rows": [1] * n,
    })
    pq.write_table(table.slice(0, 150), tmp_path / "t" / "a.parquet", row_group_size=60)
    pq.write_table(table.slice(150), tmp_path / "t" / "b.parquet", use_dictionary=False, write_statistics=False)
    got = {r.column: r for r in profile_files(spark, str(tmp_path / "t")).collect()}
    assert set(got) == {"id", "word", "x", "none", "day", "text", "rows"}
    assert all(r.rows == n for r in got.values())
    assert (got["word"].nulls, got["word"].distinct) == (80, 13) and (got["none"].nulls, got["none"].distinct, got["none"].low) == (n, 0, None)
    assert (got["id"].low, got["id"].high, got["id"].distinct) == (0, n - 1, n) and (got["x"].low, got["x"].high, got["x"].distinct) == (0, (n - 1) / 4, n)
    assert got["day"].distinct == n and got["text"].distinct == n and got["rows"].distinct == 1
    assert 0 < got["word"].scanned < got["word"].chunks


def test_clustered_copies(spark, tmp_path):
    """Values in any order and files, delivered twice in part, settle after they are written by load."""
    r = random.Random(5)
    rows = [(c, n, k, None if r.random() < 0.1 else f"v{r.randrange(40)}") for c in range(4) for n in (1, 3) for k in range(200)]
    rows += [(9, 1, k, "abc"[k % 3]) for k in range(50)] + rows[:100] + [(None, 1, 1, "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "column_id bigint, load_no int, row_no int, value string").selectExpr("*", "1 as arrived_at")
    files = write_clustered(df.repartition(3), f"file://{tmp_path}/c", most_rows=150)
    got = load_values(spark, files, Scratch(spark))
    loads = {(x.column_id, x.load_no): (x.rows, x.nulls, x.distinct) for x in got.loads.collect()}
    want = {}
    for c, n, _, _ in rows:
        if c is not None:
            mine = {k: v for a, b, k, v in rows if (a, b) == (c, n)}
            want[c, n] = (len(mine), sum(v is None for v in mine.values()), len({v for v in mine.values() if v is not None}))
    assert loads == want and got.settled == 8
    assert write_clustered(df.limit(0), f"file://{tmp_path}/d") == [] and load_values(spark, [], Scratch(spark)).loads.count() == 0
