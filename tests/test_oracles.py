"""Every core query against its oracle SQL on the smallest tables; those without one must run."""

import oracle
import pytest

from terrafold.plans import network_queries, problem_queries, routing_queries, scalar_queries, source_queries

MODULES = (problem_queries, scalar_queries, network_queries, routing_queries, source_queries)
QUERIES = {n: (f, m.ORACLES.get(n)) for m in MODULES for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    assert df.count() > 0
    if sql is not None:
        assert oracle.differences(df, con, sql) == ""
