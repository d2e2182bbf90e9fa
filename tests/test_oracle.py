"""Every query of the core against its SQL on the smallest tables; queries without SQL must run."""

import pytest

from compare import connect, difference
from tidelog.plans import all_registries

SF = "/root/testdata/sf0.001"
QUERIES = {n: f for r in all_registries() for n, f in r.queries.items()}
SQL = {n: s for r in all_registries() for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        df.collect()
