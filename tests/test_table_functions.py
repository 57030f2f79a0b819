"""Table functions in SQL: markup, OCR pages cut into batches, slices, and their awkward values."""

import collections
import random

import pytest

from vellum.functions import table_functions as tf
from vellum.plans import functions_sql


@pytest.fixture(scope="module")
def sql(spark):
    tf.register(spark)
    return spark.sql


def parts(sql, spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return [tuple(r) for r in sql("SELECT * FROM markup_parts(TABLE({d})) ORDER BY id, line, pos", d=d).collect()]


def test_markup(sql, spark):
    got = parts(sql, spark, ["Plain [[co-12]] and **bold**.", "a\n\n  - item [[co-x]] *one*  \n \t\n•\tlast", "** **[[co-1]][[co-2]]", None, "", "****a**"])
    assert got == [
        (0, 0, 0, False, "text", "Plain "), (0, 0, 1, False, "cite", "co-12"), (0, 0, 2, False, "text", " and "), (0, 0, 3, False, "bold", "bold"), (0, 0, 4, False, "text", "."),
        (1, 0, 0, False, "text", "a"), (1, 2, 0, True, "text", "item [[co-x]] *one*"), (1, 4, 0, True, "text", "last"),
        (2, 0, 0, False, "bold", " "), (2, 0, 1, False, "cite", "co-1"), (2, 0, 2, False, "cite", "co-2"),
        (5, 0, 0, False, "text", "**"), (5, 0, 1, False, "bold", "a"),
    ]


def test_long_markup_goes_on_in_parts(sql, spark):
    text = "**b** t\n" * 100_000
    got = spark.createDataFrame([(1, text)], "id bigint, text string")
    assert sql("SELECT kind, count(*) AS n, max(line) AS line FROM markup_parts(TABLE({d})) GROUP BY kind ORDER BY kind", d=got).collect() == [("bold", 100_000, 99_999), ("text", 100_000, 99_999)]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_ocr_pages(sql, spark, batch):
    rng = random.Random(batch)
    rows = [(p, 1, None, -1, 0, w, None, None) for p, w in ((1, 500), (2, 0), (4, None))]
    rows += [(p, 5, rng.randrange(4), i, rng.randrange(400), rng.randrange(90), rng.choice([None, *map(float, range(0, 100, 7)), 40.0]), rng.choice([None, "", "--", "Ab1", "x", "É"])) for p in (1, 2, 3, 4) for i in range(40)]
    rows += [(1, 4, 0, 99, 0, 9, 99.0, "line")]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "page bigint, level int, block int, word_num int, left int, width int, conf double, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.page, r.block): tuple(r)[2:] for r in sql("SELECT * FROM ocr_page(TABLE({d}) PARTITION BY page ORDER BY (level, word_num))", d=d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for p, b in {(r[0], r[2]) for r in rows if r[1] == 5}:
        words = [r for r in rows if r[:3] == (p, 5, b)]
        known = [r[6] for r in words if r[6] is not None]
        kept = [(r, t) for r in words if r[6] is not None and r[6] >= 40 and (t := "".join(c for c in (r[7] or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789"))]
        width = {1: 500}.get(p)
        want[p, b] = (len(known), len(kept), pytest.approx(sum(known) / len(known)) if known else None, max(r[4] + r[5] for r, _ in kept) / width if kept and width else None, sum(len(t) for _, t in kept))
    assert got == want


def test_ocr_pages_go_on_without_a_call_or_a_shuffled_row_for_each(spark, tmp_path):
    texts = {i: " ".join(f"w{k}" for k in range(i % 7 * 300)) for i in range(40)} | {90: None}
    docs = [*texts.items(), (3, "of another row"), (None, "no id")]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = functions_sql.ocr_sql(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Exchange")  # pages are dealt out before they are words
    found = {(r.doc_id, r.block): r.words for r in got.collect()}
    want = collections.Counter((i, k // 40) for i, t in docs for k in range(len((t or "").split(" "))))
    assert found == want and len(got.collect()) == len(want)


def test_slices(sql, spark):
    d = spark.createDataFrame([(0, None), (1, 0), (2, 900), (3, 901), (4, 100_000)], "id int, h bigint")
    got = sql("SELECT id, s.* FROM {d}, LATERAL box_slices(h, 900, 90) s", d=d).collect()
    by = {i: [tuple(r)[1:] for r in got if r.id == i] for i in range(5)}
    assert by[0] == [] and by[1] == [(0, 0, 0)] and by[2] == [(0, 0, 900)] and by[3] == [(0, 0, 496), (1, 406, 901)]
    assert len(by[4]) == 8 and by[4][-1][2] == 100_000 and all(a[2] - b[1] == 90 for a, b in zip(by[4], by[4][1:], strict=False))


def test_empty_tables(sql, spark):
    assert parts(sql, spark, []) == []
    d = spark.createDataFrame([], "page bigint, level int, block int, word_num int, left int, width int, conf double, text string")
    assert sql("SELECT * FROM ocr_page(TABLE({d}) PARTITION BY page ORDER BY (level, word_num))", d=d).collect() == []
