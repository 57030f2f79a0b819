"""Decontamination against tiling every document with every item, written apart from the operator."""

import random
import re

import pytest

from vellum.llm import decontamination

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def coverage(test, doc, least):
    """Greedy string tiling by its definition: the longest free common run first, then the next."""
    free_t, free_d, covered = [True] * len(test), [True] * len(doc), 0
    places = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    while True:
        best = (least - 1, 0, 0)
        for i, w in enumerate(test):
            for j in places.get(w, ()) if free_t[i] else ():
                n = 0
                while i + n < len(test) and j + n < len(doc) and test[i + n] == doc[j + n] and free_t[i + n] and free_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered / len(test)
        free_t[i : i + n], free_d[j : j + n] = [False] * n, [False] * n
        covered += n


def every_pair(docs, items, least, threshold):
    grams = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    tests = [(k, w, grams(w)) for k, w in ((k, tokens(t)) for k, t in items) if len(w) >= least]
    out = {}
    for d, text in docs:
        doc = tokens(text)
        own = grams(doc)
        for k, w, g in tests:
            if own & g and (c := coverage(w, doc, least)) >= threshold:
                out[d, k] = c
    return out


@pytest.mark.parametrize("broadcast_tokens", [200_000, 0])
def test_equal_to_every_pair_on_a_whole_table(spark, broadcast_tokens):
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    want = every_pair([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5, 0.8)
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.decontaminate(docs, items, broadcast_tokens=broadcast_tokens).collect()}
    assert len(want) >= 10 and got == pytest.approx(want)


@pytest.mark.parametrize("broadcast_tokens", [200_000, 0])
@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_equal_to_every_pair_around_the_threshold(spark, broadcast_tokens, threshold):
    rng = random.Random(51)
    say = lambda k, n=40: [f"w{rng.randrange(n)}" for _ in range(k)]
    common = say(12, 10**6)
    items = [(k, " ".join((common if k % 2 else []) + say(rng.randrange(3, 30), 10**6))) for k in range(30)]
    docs = []
    for d in range(120):
        test = rng.choice(items)[1].split()
        parts = [test[i : i + rng.randrange(4, 12)] for i in range(0, len(test), 7)]
        rng.shuffle(parts)
        keep = rng.random()
        docs.append((d, " ".join(w for p in parts if rng.random() < keep for w in [*p, *say(2)])))
    docs += [(200 + d, " ".join([*say(5), *common, *say(5)])) for d in range(80)]  # seeds that many documents and tests share
    want = every_pair(docs, items, 5, threshold)
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.decontaminate(*frames, threshold=threshold, broadcast_tokens=broadcast_tokens).collect()}
    assert got == pytest.approx(want) and want
