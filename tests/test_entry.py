"""The entry point's queries run, and those with SQL agree with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each kind; the driver holds all of them against their SQL.
SOME = ["rca_binary_edges", "fc_fitness", "sinkhorn_uniform", "eci", "nestedness", "rank_change", "vocabulary", "dim_rows"]


def rows(df):
    cols = sorted(df.columns)
    clean = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted(map(tuple, clean.values.tolist()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
