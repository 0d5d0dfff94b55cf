"""Every catalogue query against its SQL on the small synthetic tables, where these are."""

from pathlib import Path

import pytest

from tandem.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return "null"
    return f"{x:.5f}" if isinstance(x, float) else str(x)


#: Without SQL; test_catalog_whole holds it against brute force.
NO_SQL = {"q_html_parse"}


def test_every_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == NO_SQL


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry_without_the_subpackage():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(catalog.oracle_sql()) <= set(e.oracle_sql())
