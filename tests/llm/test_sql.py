import os

import duckdb
import pytest

from conftest import DATA
from quire.llm import queries as llm

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got = llm.QUERIES[name](spark, DATA)
    want = db.execute(llm.SQL[name])
    names = sorted(x[0] for x in want.description)
    assert names == sorted(got.columns)
    order = [x[0] for x in want.description]
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(str(dict(zip(order, r))[c]) for c in names) for r in want.fetchall())
