"""Operators against brute force on a whole table: sf0.01."""

import hashlib

import numpy as np
import pytest
import xxhash

from vellum.llm import queries

SF = "/root/testdata/sf0.01"
SPACE = b" \t\n\v\f\r"


@pytest.fixture(scope="module")
def rows(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, (r.text or "").encode()) for r in got)


def words_of(text):
    return text.translate(bytes(32 if c in SPACE else c for c in range(256))).split(b" ") if text.strip(SPACE) else []


def test_suffix_dedup(spark, rows):
    seen, want = set(), {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            h = xxhash.xxh3_128_intdigest(t[p : p + 100])
            if h in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(h)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for a, b in zip(b"\x00" + bytes(gone), gone, strict=False) if b and not a)
        want[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 10_000


def test_substring_dedup(spark, rows):
    docs = [(i, [w for w in words_of(t) if w]) for i, t in rows]
    first, want = {}, {}
    for i, w in docs:
        for p in range(len(w) - 49):
            first.setdefault(xxhash.xxh3_128_intdigest(b" ".join(w[p : p + 50])), i)
    for i, w in docs:
        gone = bytearray(len(w))
        for p in range(len(w) - 49):
            if first[xxhash.xxh3_128_intdigest(b" ".join(w[p : p + 50]))] < i:
                gone[p : p + 50] = b"\x01" * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_simhash(spark, rows):
    prints = []
    for _, t in rows:
        w = [x for x in words_of(bytes(c + 32 if 65 <= c <= 90 else c for c in t)) if x]
        shingles = [b" ".join(w[p : p + 3]) for p in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    fps = np.array(prints, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    least = np.arange(len(fps))
    while True:  # the smallest place within reach, one step at a time
        step = np.array([least[row].min() for row in near])
        if (step == least).all():
            break
        least = step
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, least.tolist(), strict=True)}
    assert len(set(least.tolist())) < len(rows)
