"""Every query that has SQL against DuckDB over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("STRATA_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
CORE = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert normal(df.select(*columns).collect()) == normal(want.select(*columns).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fixture_facts(duck):
    from strata import fixtures as fx

    bad = duck.sql(f"with {fx.A_SQL} select count(*) from h_file_lines n join h_file_lines o on o.doc_id = n.doc_id and o.v = n.v - 1 and o.line = n.line where n.truth_v <> o.truth_v").fetchall()
    assert bad == [(0,)]
