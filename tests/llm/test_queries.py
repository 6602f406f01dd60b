import os

import pytest

from colonnade.llm.queries import ORACLE, QUERIES
from tests.oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    same(spark, name, QUERIES[name], ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_columns_of_the_results(spark):
    want = {
        "p1_found": ["record_id", "group_id"], "p2_found": ["signature_id_a", "signature_id_b"], "p3_found": ["query_id_a", "query_id_b"], "p5_found": ["column_key", "group_key"],
        "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, DATA).columns == columns
