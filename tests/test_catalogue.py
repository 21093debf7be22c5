"""Every registered query of the library against its SQL on the smallest fixture tables."""
import os

import duckdb
import pytest

from plumbline.plans import catalogue

FOLDER = os.environ.get("PLUMBLINE_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "truths", "alarms", "anticipated", "recall"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
