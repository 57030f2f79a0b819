"""Index, versions, bitmaps, as-of, grid and folds against plain Python on small and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import bitmaps, folds, grid, trigrams
from vellum.operators.asof import asof_join
from vellum.sources.folders import new_folder, read_text, write_text
from vellum.sources.versions import Store


def test_index_finds_every_item_that_holds_the_terms(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "Ärger im ", "THE "]), "".join(rng.choice("abé 𝄞") for _ in range(rng.randrange(40)))) for i in range(0, 900, 3)]
    items = spark.createDataFrame(rows, "id bigint, title string, body string")
    folder = new_folder(spark, "search")
    trigrams.build_index(items, ["title", "body"], folder, block=64)
    text = {i: ((t or "").lower(), b.lower()) for i, t, b in rows}
    for terms in (["abé"], ["a𝄞b"], ["ärger", "ab"], ["the", "aab", "é"], ["nowhere"], ["ab"], ["b𝄞a "]):
        want = {i for i, fields in text.items() if all(any(t in f for f in fields) for t in terms)}
        found = {r.id for r in trigrams.indexed_items(spark, folder, terms, block=64).collect()}
        assert want <= found
        long = [t for t in terms if len(t) >= 3]
        assert found == {i for i, fields in text.items() if all(any(t[k : k + 3] in f for f in fields) for t in long for k in range(len(t) - 2))}
    plan = trigrams.candidates(spark, folder, ["abé"], 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters: [")[1].split("]")[0]


SCHEMAS = {"a": "page bigint, x int", "b": "page bigint, y string"}


def of(spark, store, version=None):
    return {t: sorted(tuple(r) for r in store.read(t, version).collect()) for t in SCHEMAS}


def test_versions_are_seen_whole_or_not_at_all(spark):
    store = Store(spark, new_folder(spark, "store"), "page", SCHEMAS, buckets=4)
    a = lambda rows: spark.createDataFrame(rows, SCHEMAS["a"])
    b = lambda rows: spark.createDataFrame(rows, SCHEMAS["b"])
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "page bigint")
    assert store.version() == 0 and of(spark, store) == {"a": [], "b": []}
    store.replace({"a": a([(k, k) for k in range(9)]), "b": b([(k, "v1") for k in range(9)])}, keys(*range(9)))
    first = of(spark, store)
    assert first == {"a": [(k, k) for k in range(9)], "b": [(k, "v1") for k in range(9)]}

    def fails(table):
        if table == "b":
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.replace({"a": a([(1, 100)]), "b": b([(1, "v2")])}, keys(1), fails)
    assert store.version() == 1 and of(spark, store) == first
    # Rows of other keys are ignored; keys without rows lose theirs; a table left out loses the keys' rows.
    assert store.replace({"a": a([(1, 100), (1, 101), (7, 7)])}, keys(1, 2, 50)) == 2
    assert of(spark, store) == {"a": sorted([(k, k) for k in range(9) if k not in (1, 2)] + [(1, 100), (1, 101)]), "b": [(k, "v1") for k in range(9) if k not in (1, 2)]}
    assert of(spark, store, 1) == first
    assert store.replace({}, keys()) == 3 and store.replace({}, keys(*range(60))) == 4
    assert of(spark, store) == {"a": [], "b": []}


def test_two_changes_cant_claim_one_version(spark):
    folder = new_folder(spark, "store")
    one, other = (Store(spark, folder, "page", SCHEMAS, buckets=2) for _ in range(2))
    rows, keys = {"a": spark.createDataFrame([(1, 1)], SCHEMAS["a"])}, spark.createDataFrame([(1,)], "page bigint")
    with pytest.raises(Exception, match="exist"):
        one.replace(rows, keys, lambda table: other.replace(rows, keys) if table == "b" else None)
    assert one.version() == 1 and of(spark, one)["a"] == [(1, 1)]


def test_small_files_are_replaced_whole(spark):
    path = f"{new_folder(spark, 'files')}/x"
    assert read_text(spark, path) is None
    write_text(spark, path, "one", replace=False)
    write_text(spark, path, "two é", replace=True)
    assert read_text(spark, path) == "two é"


def test_bitmaps_count_distinct_over_any_parts(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.choice("ab"), rng.choice([None, rng.randrange(100_000), rng.randrange(50)])) for _ in range(2000)] + [(9, "c", None)]
    stored = bitmaps.id_bitmaps(spark.createDataFrame(rows, "part int, k string, id bigint"), ["part", "k"], "id")
    want = {}
    for _, k, i in rows:
        if i is not None:
            want.setdefault(k, set()).add(i)
    assert {r.k: r.n for r in bitmaps.distinct_ids(stored, ["k"]).collect()} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_asof_over_a_hot_key_cut_into_many_partitions(spark, partitions):
    rng = random.Random(partitions)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(200)])) for i in range(400)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(0, 200, 9)]), rng.randrange(5), "x") for _ in range(60)]
    got = asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int, id string"), "k", "t", ["v", "id"], partitions)
    want = {}
    for i, k, t in left:
        before = [(rt, v, x) for rk, rt, v, x in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        want[i] = (k, t, *(max(before)[1:] if before else (None, None)))
    assert {r.id: (r.k, r.t, r.asof_v, r.asof_id) for r in got.collect()} == want and got.count() == 400
    assert asof_join(spark.createDataFrame([], "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int, id string"), "k", "t", ["v"]).count() == 0


def boxes(rng, n, first=0):
    out = []
    for i in range(first, first + n):
        x, y = rng.randrange(-40, 40) / 8, rng.randrange(-40, 40) / 8
        out.append((i, x, y, x + rng.randrange(-1, 24) / 8, y + rng.randrange(0, 24) / 8))
    return out


@pytest.mark.parametrize("size", [0.3, 1.0, 50.0])
def test_grid_joins_equal_every_pair(spark, size):
    rng = random.Random(7)
    a, b = boxes(rng, 60), boxes(rng, 50, 100)
    points = [(i, rng.randrange(-50, 70) / 8, rng.randrange(-50, 70) / 8) for i in range(150)]
    kind = "id int, x0 double, y0 double, x1 double, y1 double"
    da, db, dp = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), spark.createDataFrame(points, "pid int, px double, py double")
    got = sorted((r.pid, r.id) for r in grid.points_in_boxes(dp, da, size, 0.125).collect())
    assert got == sorted((p, i) for p, x, y in points for i, x0, y0, x1, y1 in a if x0 <= x1 and y0 <= y1 and x0 - 0.125 <= x <= x1 + 0.125 and y0 - 0.125 <= y <= y1 + 0.125)
    got = sorted((r.id, r.other_id) for r in grid.overlapping(da, db, size).collect())
    assert got == sorted((i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if max(x0, u0) < min(x1, u1) and max(y0, v0) < min(y1, v1))


def test_folds_carry_over_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, rng.randrange(9)])) for i in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, i int, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pack = {(r.g, r.i): r.result for r in folds.packed(d, "g", "i", "n", 500).collect()}
        cut = {(r.g, r.i): r.result for r in folds.chunked(d, "g", "i", "n", 12).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("a", "b", None):
        used, chunk, n = 0, 0, 0
        for i, size in sorted((i, s or 0) for k, i, s in rows if k == g):
            assert pack[g, i] == int(used + size <= 500)
            used += size if used + size <= 500 else 0
            chunk, n = (chunk + 1, size) if n > 0 and n + size > 12 else (chunk, n + size)
            assert cut[g, i] == chunk
    assert folds.packed(d.where(F.lit(False)), "g", "i", "n", 5).count() == 0
