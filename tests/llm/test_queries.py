import oracle
import pytest

from terrafold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLES:
        assert oracle.differences(df, con, queries.ORACLES[name]) == ""
    else:
        assert df.count() > 0
