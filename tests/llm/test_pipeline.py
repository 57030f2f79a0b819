"""The pipeline's contract on a small corpus."""

import random

import corpus_pipeline
import pytest
from test_decontamination import every_pair
from test_line_dedup import brute_every_pair, filled
from test_operators import near_groups

from vellum.llm import queries


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    item = say(40)
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        rows.append((i, say(80) + "\n" + (" vile nasty rotten" * 3 if bad else say(9)), "en", "s", 0))
        labels.append((i, int(i % 3 > 0), int(bad)))
    long = say(200)
    changed = long.replace(long.split()[50], "edited", 1)
    rows += [(200, long, "en", "s", 0), (201, changed, "en", "s", 0), (202, long, "en", "s", 0), (203, say(20) + " " + item, "en", "s", 0), (204, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id for r in docs.collect()}
    assert not any(i % 5 == 0 for i in seen["toxicity"] if i < 200) and len(seen["toxicity"]) >= 160
    assert seen["line_dedup"] == seen["toxicity"]
    assert seen["line_dedup"] - seen["simhash"] == {201, 204}  # 202 and the null text are both empty by then
    assert seen["simhash"] - seen["decontamination"] == {203}
    assert seen["mixing"] == seen["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["mixing"]


def test_every_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))


def test_stages_survive_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    extra = ["doc", "spans", "id", "h", "carried", "label", "predicted", "tokens", "rate", "p", "group_id", "kept", "item_id", "a.b", "row", "root"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(i, t, None, None, None, *["x"] * len(extra)) for i, t in [(1, "a b c"), (1, "a b c"), (1, "other"), (None, None), (None, "x"), (2, ""), (3, "w " * 3000)]]
    for name, data in (("full", rows), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "p q r s t u")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        columns = docs.columns
        for n, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{stage_name}")
            docs = spark.read.parquet(f"{sf}/{stage_name}")
            assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert (docs.count() > 0) == bool(data)


def test_the_chain_of_stages_equals_brute_force_on_a_whole_table(spark, tmp_path):
    """Each stage on what the one before wrote: sf0.01, whole texts, written apart from the operators."""
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs, got = source, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(got[name])
    before = {r.doc_id: r for r in source.collect()}
    predicted = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, sf).collect()}
    assert set(got["toxicity"]) == {i for i, p in predicted.items() if not p} and set(predicted) == set(before)
    assert all(r == before[i] for i, r in got["toxicity"].items())

    rows = [(i, (r.text or "").encode()) for i, r in got["toxicity"].items()]
    cut, _ = brute_every_pair(rows, 5)
    for i, t in rows:
        r = got["line_dedup"][i]
        assert filled((r.text or "").encode()) == [x for p, x in enumerate(filled(t)) if p not in cut[i]]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source)
    assert len(got["line_dedup"]) == len(rows) and sum(map(len, cut.values())) > 100

    ids = sorted(got["line_dedup"])
    words = [[w for w in got["line_dedup"][i].text.translate({c: c + 32 for c in range(65, 91)}).translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w] for i in ids]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    least = near_groups(sets)
    assert set(got["simhash"]) == {ids[k] for k, x in enumerate(least) if x == k} and len(got["simhash"]) < len(ids)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in every_pair([(i, r.text) for i, r in got["simhash"].items()], items, 5, 0.8)}
    assert set(got["decontamination"]) == set(got["simhash"]) - leaks and leaks

    mixed = got["mixing"]
    assert set(mixed) == set(got["decontamination"])
    total = sum(r.tokens for r in mixed.values())
    shares = {d: sum(r.tokens * r.rate * r[f"p_{d}"] for r in mixed.values()) / total for d in corpus_pipeline.TARGETS}
    worst = max(abs(shares[d] - t) for d, t in corpus_pipeline.TARGETS.items())
    assert worst == pytest.approx(next(iter(mixed.values())).missed, abs=1e-6) and worst < 0.03
