"""Every named query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lipiflow.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        assert rows(got) == rows(oracle.execute(ORACLE_SQL[name]).df())


def test_the_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["roman", "gold", "word", "score", "rank"]
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/lipiflow/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as f:
                assert "llm" not in f.read(), path
