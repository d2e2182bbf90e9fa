"""Every query of the subpackage against its SQL on the smallest tables; queries without SQL must run."""

import pytest

from compare import connect, difference
from tidelog.llm.queries import R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", R.queries)
def test_query(spark, name):
    df = R.queries[name](spark, SF)
    if name in R.sql:
        assert difference(df, connect(SF), R.sql[name]) == ""
    else:
        assert df.collect()
