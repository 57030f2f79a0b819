"""The stored table of one row per key: its plans, its versions and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.sources.upserts import KeyedTable

SCHEMA = "k bigint, part string, at int, v string, made int"


@pytest.fixture
def stored(spark, tmp_path):
    return lambda **more: KeyedTable(spark, str(tmp_path / "table"), SCHEMA, ["k", "part"], ["at"], keep=["made"], buckets=4, **more)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_of_a_hundredth_moves_no_row_of_the_base(spark, stored):
    t = stored()
    all_rows = spark.range(20000).selectExpr("id AS k", "'p' || id % 3 AS part", "1 AS at", "'old' AS v", "1 AS made")
    t.upsert(all_rows)
    t.compact()
    assert "Exchange" not in plan(t.read()) and "Bucketed: true" in plan(t.read().groupBy("k", "part").count())
    t.upsert(all_rows.where("k % 100 = 0").withColumns({"v": F.lit("new"), "made": F.lit(2)}))
    t.upsert(all_rows.where("k % 100 = 1").withColumns({"v": F.lit("newer"), "made": F.lit(3)}))
    read = t.read()
    shown = plan(read)
    assert shown.count("Exchange hashpartitioning") == 1 and shown.count("Bucketed: true") == 1
    # The one exchange stands over the deltas: the bucketed scan comes before it, and beside it in the join.
    assert shown.index("Bucketed: true") < shown.index("Exchange hashpartitioning")
    assert {(r.v, r.made): r["count"] for r in read.groupBy("v", "made").count().collect()} == {("old", 1): 19600, ("new", 1): 200, ("newer", 1): 200}
    t.compact()
    assert "Exchange" not in plan(t.read()) and rows(t.read()) == rows(read)


def test_many_writes_equal_a_dictionary(spark, stored):
    rng, t, want = random.Random(3), stored(most=3), {}
    for write in range(7):
        batch = [(rng.randrange(12), rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"]), write * 10 + rng.randrange(3)) for _ in range(rng.choice([0, 1, 15]))]
        t.upsert(spark.createDataFrame(batch, SCHEMA))
        low = lambda x: (x is not None, x or "") if not isinstance(x, int) else (True, x)
        by = {}
        for k, p, at, v, made in batch:
            by.setdefault((k, p), []).append((at, v, made))
        for key, given in by.items():
            at, v, _ = max(given, key=lambda g: ((g[0] is not None, g[0] or 0), low(g[1])))
            made = min(given, key=lambda g: ((g[0] is not None, g[0] or 0), g[2]))[2]
            want[key] = (at, v, want[key][2] if key in want else made)
        assert {(r.k, r.part): (r.at, r.v, r.made) for r in t.read().collect()} == want
    assert t.read().count() == len(want) > 10


def test_a_failed_write_is_never_seen_and_old_versions_stay(spark, stored):
    t = stored()
    assert t.version() == 0 and rows(t.read()) == []
    t.upsert(spark.createDataFrame([(1, "a", 1, "x", 1)], SCHEMA))
    first = t.version()
    with pytest.raises(Exception, match="part is a key"):
        t.upsert(spark.createDataFrame([(1, "a", 1, "y", 2), (2, None, 1, "z", 2)], SCHEMA))
    assert t.version() == first and rows(t.read()) == [(1, "a", 1, "x", 1)]
    t.compact()
    t.upsert(spark.createDataFrame([(1, "a", 0, "y", 2), (2, "a", 0, "z", 2)], SCHEMA))
    assert rows(t.read()) == [(1, "a", 0, "y", 1), (2, "a", 0, "z", 2)]
    assert rows(t.read(first)) == [(1, "a", 1, "x", 1)]


def test_a_session_that_does_not_know_the_table_reads_it_by_its_folder(spark, stored):
    t = stored()
    t.upsert(spark.createDataFrame([(n, "a", 1, "x", 1) for n in range(50)], SCHEMA))
    t.compact()
    before = rows(t.read())
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("keyed_")]:
        spark.sql(f"DROP TABLE {name}")
    again = stored()
    assert rows(again.read()) == before and "Bucketed: true" in plan(again.read().groupBy("k", "part").count())


def test_extra_columns_are_left_and_a_hot_key_is_one_row(spark, stored):
    t = stored()
    t.upsert(spark.range(5000).selectExpr("1 AS k", "'a' AS part", "CAST(id AS int) AS at", "'x' AS v", "CAST(id AS int) AS made", "id AS other"))
    assert rows(t.read()) == [(1, "a", 4999, "x", 0)]
