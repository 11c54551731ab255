import os

import duckdb
import pytest

from conftest import DATA
from quire.plans import queries as core

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def test_every_sql_has_its_query():
    assert set(core.SQL) <= set(core.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, db, name):
    got = core.QUERIES[name](spark, DATA)
    want = db.execute(core.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    b = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in want.fetchall())
    assert a == b


def test_entry_imports_without_the_optional_subpackage():
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
