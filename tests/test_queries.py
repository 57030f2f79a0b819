"""Every registered reference query against its oracle, on the smallest tables."""

import os

import pytest
from oracle import connect, rows_of_duckdb, rows_of_spark

from vellum.plans import browse, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duckdb(duck, ORACLE[name])


def test_distinct_issues_are_listed_and_counted(spark, tmp_path):
    docs = [(i, "text", "en", f"src{i % 3}", 4) for i in range(0, 12_000, 250)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    for name, labels in (("all", [(d[0], 1, 0) for d in docs if d[0] % 1000]), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{sf}/documents.parquet")
        shown = [d for d in docs if d[0] in {x[0] for x in labels}]
        issues = sorted({f"{d[3]}-{d[0] // 500}" for d in shown})
        got = [tuple(r) for r in browse.distinct_cardinalities(spark, sf).collect()]
        assert got == [(len(shown), len(issues), ",".join(issues) if issues else None)]
