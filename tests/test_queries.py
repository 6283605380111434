"""Every named query against its SQL counterpart on the smallest supplied data."""

from pathlib import Path

import duckdb
import pytest
from check import compare

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not found")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    verdict = compare(spark, connection, SF, name, queries()[name], oracle_sql().get(name))
    assert not verdict.startswith("FAIL"), verdict


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() > 0 and "event_count" in frame.columns
