"""Every query with oracle SQL against DuckDB over the same files."""

import duckdb
import pytest
from conftest import plain, rows

from tidesift import workload
from tidesift.session import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_same_rows_as_oracle(spark, sf_dir, duck, name):
    df = workload.queries()[name](spark, sf_dir)
    expected = duck.sql(f"select * from ({workload.oracle_sql()[name]})")
    assert sorted(df.columns) == sorted(expected.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"select {columns} from ({workload.oracle_sql()[name]})").fetchall()), key=repr)
    assert rows(df) == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
