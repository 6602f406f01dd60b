import os

import pytest

from colonnade.plans import retrieve_queries as q
from colonnade.plans.profile_queries import COLUMNS, TEXT_COLUMNS
from tests.oracle import DATA, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_hundredth_row_against_brute_force(spark, con):
    phrases = {
        (f"{t}.{c}.{k}", v.strip(" ").lower())
        for t, cs in TEXT_COLUMNS.items() for c in cs
        for k, v in con.execute(f"select {COLUMNS[t][0]}, {c} from {t} where {COLUMNS[t][0]} % 100 = 0 and {c} is not null").fetchall()
    }
    index = con.execute(f"select norm, table_name, column_name, value from {q.INDEX_SQL}").fetchall()
    exact = {(i, *row[1:]) for i, p in phrases for row in index if row[0] == p}
    got = q.value_exact_match(spark, DATA).collect()
    assert exact and len(got) == len(exact) and {(r.query, r.table_name, r.column_name, r.value) for r in got} == exact
    best = {}
    for p in {p for _, p in phrases if len(p) >= 3}:
        hits = [(-round(0.7 * r, 6), *row[1:]) for row in index if len(row[0]) >= 3 and row[0] != p and (p in row[0] or row[0] in p) and (r := min(len(p), len(row[0])) / max(len(p), len(row[0]))) >= 0.4]
        best[p] = sorted(hits)[:20]
    partial = {(i, *h[1:], -h[0]) for i, p in phrases for h in best.get(p, [])}
    got = q.value_partial_match(spark, DATA).collect()
    assert len(got) == len(partial) and {(r.query, r.table_name, r.column_name, r.value, r.score) for r in got} == partial
