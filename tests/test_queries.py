"""Every query with SQL gives what DuckDB gives; the others run."""

import os

import pytest

import __spark_entry__ as e
from foliospark.plans import page_queries, paper_queries, rule_queries  # noqa: F401
from foliospark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(table):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(table.column_names)
    return sorted(tuple(map(plain, r)) for r in zip(*(table[c].to_pylist() for c in names), strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).to_arrow_table() if hasattr(duck.sql("select 1"), "to_arrow_table") else duck.sql(ORACLE_SQL[name]).arrow()
        assert sorted(got.columns) == sorted(want.column_names)
        assert rows(got.toArrow()) == rows(want)
    else:
        assert got.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert e.entry(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(e.oracle_sql()) <= set(e.queries())
