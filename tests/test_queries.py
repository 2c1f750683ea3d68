"""Every registered query against its SQL form on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
RUNS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    if name not in SQL:
        RUNS[name](spark, FOLDER).collect()
        return
    outcome = oracle.compare(spark, duck, name, RUNS[name], SQL[name], FOLDER)
    assert outcome.startswith("ok"), outcome
