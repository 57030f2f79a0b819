"""The operators' queries against their SQL, on two sizes of tables."""

import pytest
from oracle import connect, rows_of_duckdb, rows_of_spark

from vellum.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name, sf):
    path = f"/root/testdata/{sf}"
    assert rows_of_spark(queries.QUERIES[name](spark, path)) == rows_of_duckdb(connect(path), queries.ORACLE_SQL[name])
