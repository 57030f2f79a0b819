"""Geometry kernels, folds, readers and text rules on small fixtures."""

import hashlib
import hmac
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.functions import audio, dates, geometry
from vellum.functions import text as T
from vellum.operators import kernels, transitions
from vellum.plans import ordered, spend, texts
from vellum.sources import readers

SF = "/root/testdata/sf0.001"


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_suppression_keeps_no_overlapping_boxes():
    rng = random.Random(1)
    page = pd.DataFrame([{"page": 1, "id": i, "x": rng.random(), "y": rng.random(), "w": rng.random() / 2, "h": rng.random() / 2, "score": rng.random()} for i in range(60)])
    kept = kernels.keep_best(page).to_dict("records")

    def iou(a, b):
        ix = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
        iy = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
        return ix * iy / (a["w"] * a["h"] + b["w"] * b["h"] - ix * iy)

    assert all(iou(a, b) <= 0.1 for a in kept for b in kept if a["id"] < b["id"])
    ids = {k["id"] for k in kept}
    for box in page.to_dict("records"):
        assert box["id"] in ids or any(iou(box, k) > 0.1 and k["score"] >= box["score"] for k in kept)


def test_gaps_join_down_a_column_only():
    line = lambda i, x, y, words=4: {"page": 1, "id": i, "x": x, "y": y, "w": 0.2, "h": 0.01, "words": words}
    page = pd.DataFrame([line(0, 0.1, 0.10), line(1, 0.1, 0.12), line(2, 0.6, 0.11), line(3, 0.1, 0.60, 9), line(4, 0.1, 0.13, 2)])
    got = kernels.merged_gaps(page)
    assert got["words"].tolist() == [9, 8] and got["y0"].tolist() == [0.60, 0.10]


def test_columns_are_found_from_left_edges():
    page = pd.DataFrame([{"page": 1, "x": c + 0.0001 * (i % 3), "w": 0.2} for c in (0.05, 0.35, 0.65) for i in range(40)])
    got = kernels.column_grid(page)
    assert [round(x, 2) for x in got["left_edge"]] == [0.05, 0.35, 0.65] and got["lines"].sum() == 120


def test_kernels_run_as_queries(spark):
    boxes = ordered.nms(spark, SF)
    assert 0 < boxes.count() <= spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert ordered.column_grid(spark, SF).count() > 0
    gaps = ordered.gap_merge(spark, SF).collect()
    assert gaps and all(g.words >= 5 and g.x0 <= g.x1 for g in gaps)


def test_signature_is_hmac(spark):
    got = {r.item_id: r.signature for r in ordered.signature(spark, SF).collect()}
    assert got[3] == hmac.new(b"example-secret", b"item:3", hashlib.sha256).hexdigest()


def test_banding_measures_from_the_first_box_of_a_band(spark):
    boxes = [(0, 0.0, 0.5), (1, 0.015, 0.1), (2, 0.03, 0.9), (3, 0.045, 0.2), (4, 0.2, 0.0)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<id:bigint,x:double,y:double>>")
    assert df.select(geometry.banded(F.col("b"))).first()[0] == [1, 0, 3, 2, 4]


def test_pack_goes_on_after_a_skip(spark):
    blocks = [(i, i, n) for i, n in enumerate((5, 9, 3, 4))]
    df = spark.createDataFrame([(blocks,)], "b array<struct<pos:bigint,id:bigint,n:bigint>>")
    got = df.select(ordered.pack(F.col("b"), 12).alias("p")).first().p
    assert (got.used, got.kept, got.skipped) == (12, [0, 2, 3], 1)


def test_running_times_tile_the_segment(spark):
    for rows in ordered.line_times(spark, SF).orderBy("conv_id", "turn").toPandas().groupby("conv_id"):
        t = rows[1]
        assert t["t0"].iloc[0] == 10 and abs(t["t1"].iloc[-1] - 40) < 1e-6
        assert (abs(t["t0"].iloc[1:].to_numpy() - t["t1"].iloc[:-1].to_numpy()) < 1e-5).all()


def test_headlines(spark):
    got = values(spark, T.headline_shaped, "EAST RIDGE BLVD. WIDENED", "The council met on Monday evening and talked.", "Council Meets On Monday", "$450", "", "Boys of the Ward Play Ball", "Riverside Motor And Truck Sales Co.", "of the and")
    assert got == [True, False, True, False, False, True, True, False]


def test_titles_snippets_and_slugs(spark):
    assert values(spark, T.title_case, "O'BRIEN WINS", "Mixed Case", "ABC") == ["O'Brien Wins", "Mixed Case", "ABC"]
    assert values(spark, T.slug, "A&B Co.", "A & B") == ["a-and-b-co", "a-and-b"]
    assert values(spark, lambda c: T.slug(c, spaced_and=False), "A&B Co.", "A & B") == ["aandb-co", "a-and-b"]
    assert values(spark, T.filler_key, "Buy BLUE RIVER Bread", "Buy  Blue River Bread!") == ["buy blue river bread"] * 2
    assert values(spark, T.first_line, "[mark]\n  First \nsecond", None) == ["First", ""]
    assert values(spark, T.unquoted, '"A Title."', "plain") == ["A Title", "plain"]
    assert values(spark, T.initials, "The Harbor News", "Valley Post") == ["HN", "VP"]


def test_dates_and_clock(spark):
    assert values(spark, dates.date_label, "1924-02-01", "spring", "", None, "1924-99-99") == ["Feb 1 1924", "SPRING", "UNDATED", "UNDATED", "1924-99-99"]
    assert values(spark, dates.spoken_date, "Feb 1 1924", "UNDATED") == ["February 1, 1924", "UNDATED"]
    assert values(spark, lambda c: dates.clock(c.cast("double")), "-3", "0", "61.9", "600") == ["0:00", "0:00", "1:01", "10:00"]


def priced(spark, model, at, prices, tokens):
    calls = spark.createDataFrame([(1, model, at, *tokens)], "call_id int, model string, at string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
    calls = calls.select("*", F.to_timestamp("at").alias("called_at")).drop("at")
    table = spark.createDataFrame(prices, "model string, from_day string, input double, output double, cache_write double, cache_read double")
    return spend.with_asof_price(calls, table).first().price_usd


def test_prices(spark):
    m = 1_000_000
    four = [("x", None, 2.0, 10.0, 2.5, 0.2)]
    assert priced(spark, "x", "2026-10-01", four, (m, m // 10, m // 5, m // 2)) == 3.6
    assert priced(spark, "absent", "2026-10-01", four, (m, 0, 0, 0)) is None
    dated = [("y", None, 0.5, 9.0, None, None), ("y", "2027-01-01", 1.0, 18.0, None, None)]
    assert priced(spark, "y", "2026-10-01", dated, (m, m, 0, 0)) == 9.5
    assert priced(spark, "y", "2027-01-01", dated, (m, m, 0, 0)) == 19.0


def test_search(spark):
    assert texts.query_terms('Two "Quoted  words" x') == ["two", "quoted  words", "x"]
    items = spark.createDataFrame([(1, "coal is king", None, "coal", None, None, "coal"), (2, None, "about coal", None, None, None, "king coal"), (3, "king", None, None, None, None, None)], "id int, title string, summary string, subject string, type string, date string, body string")
    got = {r.id: (r.score, r.fields) for r in texts.ranked(items, "coal king").collect()}
    assert got == {1: (13 + 10, "title,subject,body"), 2: (6 + 6, "summary,body")}
    assert texts.ranked(items, "c").count() == 0


def test_loose_json(spark):
    got = values(spark, texts.loose_json, '```json\n{"a": {"b": 1}}\n```', 'so: {"a": 1} done', "no braces")
    assert got == ['{"a": {"b": 1}}', '{"a": 1}', "no braces"]


def test_transitions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, transitions.upsert_latest(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert list(map(tuple, transitions.insert_ignore(old, new, ["k"], [F.asc("v")]).collect())) == [(3, "e")]
    patch = spark.createDataFrame([(1, None, True), (2, "x", False)], "k int, v string, has_v boolean")
    assert sorted(map(tuple, transitions.patched(old, patch, "k", ["v"]).collect())) == [(1, None), (2, "b")]


def test_readers(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"object_class": "article", "role": "news", "text": "A\nB", "region_bbox": None}, {"object_class": "filler_slug", "text": "Coal!"}]))
    assert [(r.pos, r.object_class, r.text) for r in readers.read_blocks(spark, f"{tmp_path}/p1.json").orderBy("pos").collect()] == [(0, "article", "A\nB"), (1, "filler_slug", "Coal!")]
    (tmp_path / "bad.json").write_text(json.dumps([{"role": "x"}]))
    with pytest.raises(Exception, match="needs object_class"):
        readers.read_blocks(spark, f"{tmp_path}/bad.json").collect()
    for n in (0, 1):
        (tmp_path / f"c{n}.json").write_text(json.dumps({"total": 3, "items": [{"pointer": n, "title": "T"}, {"pointer": 7, "title": "T"}]}))
    assert readers.read_catalog(spark, [f"{tmp_path}/c0.json", f"{tmp_path}/c1.json"]).count() == 3
    s = spark.createDataFrame([(1, '{"pageptr":"5","pagetitle":"P"}'), (2, '[{"pageptr":"6"},{"pageptr":"x"}]')], "pointer int, page string")
    assert sorted(((r.pointer, r.printed_page, r.page_record) for r in readers.page_structure(s).collect()), key=str) == [(1, 1, 5), (2, 1, 6), (2, 2, None)]
    head = "\t".join(c.split()[0] for c in readers.OCR.split(", "))
    rows = ["1 1 0 0 0 0 0 0 200 100 -1 ", "5 1 1 1 1 1 20 10 40 10 91 Hello,", "5 1 1 1 1 2 70 10 40 10 12 w0rld", "5 1 1 1 1 3 120 10 9 10 95 --"]
    (tmp_path / "o.tsv").write_text("\n".join([head, *("\t".join(r.split(" ")) for r in rows)]))
    words = readers.read_ocr(spark, f"{tmp_path}/o.tsv")
    assert sorted((r.token, r.x, r.w) for r in words.collect()) == [("hello", 0.1, 0.2), ("w0rld", 0.35, 0.2)]
    assert [(r.conf, r.words) for r in readers.ocr_blocks(words).collect()] == [(51.5, 1)]


def test_replay_and_resume(spark):
    objects = spark.createDataFrame([(1, 0), (1, 1)], "page int, seq int")
    recorded = spark.createDataFrame([("1:1", "heavy")], "key string, tier string")
    assert sorted(map(tuple, readers.replayed(objects, recorded).collect())) == [(1, 0, None), (1, 1, "heavy")]
    asked, done = spark.createDataFrame([(1,), (2,)], "pointer int"), spark.createDataFrame([(2,), (2,)], "pointer int")
    assert [r.pointer for r in readers.unresolved(asked, done, "pointer").collect()] == [1]


def test_exports_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert readers.export_json(df, [f"{tmp_path}/x", f"{tmp_path}/y"])
    assert not readers.export_json(df.limit(0), [f"{tmp_path}/x"]) and spark.read.json(f"{tmp_path}/x").count() == 1
    assert readers.first_available(lambda: spark.read.parquet("/nowhere"), lambda: df).count() == 1
    assert readers.conform(df, {"id": ("bigint", 0), "note": ("string", "-")}).first().asDict() == {"id": 1, "note": "-"}
    m = spark.createDataFrame([({"voice": "b", "odd": "x"},), (None,)], "s map<string,string>")
    got = [r[0] for r in m.select(readers.merged_settings(F.col("s"), {"voice": "a", "pace": "slow"})).collect()]
    assert got == [{"voice": "b", "pace": "slow"}, {"voice": "a", "pace": "slow"}]
    cards = spark.createDataFrame([(["a", "b", "a", "c", "d"],)], "i array<string>")
    assert cards.select(readers.reader_card(F.col("i"))).first()[0] == ["a", "b", "c"]
    models = spark.createDataFrame([("v-9-tts", ["generateContent"]), ("v-10-tts", ["generateContent"]), ("v-11", ["generateContent"]), ("v-12-tts", [])], "name string, methods array<string>")
    assert [r.name for r in readers.voice_models(models).collect()] == ["v-10-tts", "v-9-tts"]


def test_sound_and_images():
    samples = b"\x00\x80\xff\x7f\x01\x00"
    assert audio.samples_of(audio.wav(samples)) == samples and audio.samples_of(samples) == samples
    assert audio.jpeg_size(bytes.fromhex("ffd8ffe000040000ffc0000b080102030401") + bytes(8)) == (0x0304, 0x0102)
    assert audio.jpeg_size(b"\xff\xd8") is None


def test_pages_collapse_their_own_fillers(spark, tmp_path):
    """A page with 55, 42 and 34 blocks, of which 0, 6 and 5 are copies of one filler: 55, 37 and 30 rows."""
    for n, fillers in ((55, 0), (42, 6), (34, 5)):
        blocks = [{"object_class": "advertisement", "role": "ad", "text": f"Ad {i}"} for i in range(n - fillers)]
        for i in range(fillers):
            blocks.insert(3 * i + 1, {"object_class": "filler_slug", "role": "slug", "text": ["Buy BLUE RIVER Bread", "Buy Blue River Bread!"][i % 2]})
        (tmp_path / f"page{n}.json").write_text(json.dumps(blocks))
    b = readers.read_blocks(spark, f"{tmp_path}/page*.json")
    rows = ordered.collapsed(b.select("file", "pos", F.col("text").alias("line"), (F.col("object_class") == "filler_slug").alias("filler")), "file").collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.file, []).append(r)
    assert sorted(len(v) for v in by_page.values()) == [30, 37, 55]
    assert sorted(r.occurrences for r in rows if r.filler) == [5, 6] and all(r.occurrences == 1 for r in rows if not r.filler)
    assert all(sorted(r.seq for r in v) == list(range(len(v))) for v in by_page.values())
