import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.oracle import DATA

REPO = str(Path(__file__).resolve().parents[1])


def test_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['colonnade.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {(r.source_column, r.target_column) for r in e.entry(spark).collect()} == {
        ("c_nationkey", "n_nationkey"), ("s_nationkey", "n_nationkey"), ("o_custkey", "c_custkey"), ("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey"),
    }
