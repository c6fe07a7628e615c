"""Every fleet query against its SQL in DuckDB over the same tables."""

import os

import duckdb
import pytest

from waybill.plans import fleet, oracle

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


def test_same_names():
    assert set(fleet.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(fleet.queries()))
def test_query(spark, con, name):
    df = fleet.queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    cursor = con.execute(oracle.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, cursor.fetchall())
    assert got


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
