"""The queries of the training-data operators: SQL where there is one, and odd rows through every stage."""

import duckdb
import pytest

from lipiflow.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))


def test_there_is_a_query_for_each_operator():
    import __spark_entry__ as entry

    found = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in found) == 1 for i in range(1, 14)) and "pipeline" in found


def test_odd_rows_pass_every_stage(spark, sf_dir):
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, text, "en", "s", 3), (3, text, "en", "s", 3), (4, text + " more", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, node long")
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == docs.columns
            out.count()
        pieces = p.STAGES[-1][1](spark, out, sf_dir)  # a document has one piece that begins it, and may have more
        assert pieces.where("start = 0").count() == out.count() == (1 if start is docs else 0)
