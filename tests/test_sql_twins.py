"""Every registered query with SQL must return exactly the rows that DuckDB returns."""

import os

import pytest

import __spark_entry__ as entry
from check_sql import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The default run leaves out streams and queries without SQL, whose rules other tests cover on small
# inputs; TEST_EVERYTHING=1 runs them too.
EVERYTHING = os.environ.get("TEST_EVERYTHING") == "1"
STREAMS = {"drift_guard_stream", "shell_history_stream", "daily_cap_stream", "capture_stream", "replay_guard", "knowledge_inbox",
           "import_increment", "retention_sweep", "consolidation_trigger", "consolidation_run"}
TWINS = sorted(n for n in set(entry.queries()) & set(entry.oracle_sql()) if EVERYTHING or n not in STREAMS)
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql())) if EVERYTHING else []


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).limit(5).collect()
