"""The numbered operators against brute force, round trips and held-out accuracy."""

import binascii
import collections
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import decontamination, exact_dedup, mixing, near_duplicates, repeats, simhash, substring_dedup, suffix_dedup, terms, toxicity, url_filter, warc
from vellum.llm.components import with_components

DOCS = "doc_id bigint, text string, spans string, doc string"  # two columns with clashing names
WORDS = ["alpha", "beta", "Gamma", "delta", "épée", "the", "of", "zeta", "eta", "theta"]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with nulls, blanks, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(k))
    passage = say(70)
    texts: list = [None, "", " \t\n", "one", "one two", say(30), passage, "x " * 400, "é" * 90]
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0:
            texts.append(rng.choice([t for t in texts if t] or ["a"]))
        elif kind == 1:
            texts.append(say(rng.randrange(60)) + "\n" + passage + "\n" + say(rng.randrange(60)))
        elif kind == 2:
            w = (rng.choice([t for t in texts if t and len(t) > 100])).split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(say(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))))
    texts.append(passage + "\n" + say(6000))
    return [(i, t, "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, bucket_bytes=500).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "b"), (1, "B")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect())
    assert got == [(-1, None, 2, True), (-1, None, 2, True), (1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_grace_recursion_spills_and_keeps_hash_collisions_apart(tmp_path):
    rng = random.Random(3)
    contents = [b"%d" % rng.randrange(400) * 20 for _ in range(3000)]
    records = [(xxhash.xxh3_64_intdigest(c), c, 1, i, [i]) for i, c in enumerate(contents)]
    records += [(77, b"left", 1, 9000, [9000]), (77, b"right", 1, 9001, [9001])]  # one hash, two contents
    out = {c: (n, top, sorted(reps)) for _, c, n, top, reps in exact_dedup.grace_groups(records, 5000, str(tmp_path))}
    for c in set(contents):
        at = [i for i, x in enumerate(contents) if x == c]
        assert out[c] == (len(at), max(at), at)
    assert out[b"left"][0] == out[b"right"][0] == 1
    assert not list(tmp_path.iterdir())


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(t[p : p + length])
        runs = sum(1 for a, b in zip(b"\x00" + bytes(gone), gone, strict=False) if b and not a)
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def brute_words(rows, window):
    first, out = {}, {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, t in rows:
        w = t.split()
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = b"\x01" * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length,context", [(100, 32), (40, 8), (101, 96)])
def test_suffix_dedup(docs, empty, length, context):
    want = brute_bytes(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, length, context).collect()}
    assert got == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("window", [50, 35])
def test_substring_dedup(docs, empty, window):
    want = brute_words(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()), window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, window).collect()}
    assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_cover_has_every_difference():
    differences = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.PERIOD))


def test_repeated_ids_are_one_document_if_equal(spark):
    text = "".join(f"{i} word " for i in range(200))
    d = spark.createDataFrame([(1, text), (1, text), (None, "x"), (2, text), (2, "other")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (2, len(text))]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(d).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 400)]


@pytest.mark.parametrize("batch", [10_000, 20])
def test_substring_dedup_of_repeated_ids_with_other_texts(spark, batch):
    """Only a smaller doc_id makes a window go: rows of one id, null ids among them, never one another's."""
    rng = random.Random(batch)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passages = [say(rng.randrange(50, 90)) for _ in range(6)]
    rows = []
    for _ in range(150):
        words = say(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(20)
            words += rng.choice(passages)[at:] + say(rng.randrange(12))
        rows.append((rng.choice([None, 0, 1, 1, 2, 3, 5, 8, 13, 2**40]), " ".join(words)))
    rows += rows[:20]
    order = lambda i: -1 if i is None else i
    first = {}
    for i, text in rows:
        words = text.split()
        for a in range(len(words) - 49):
            w = tuple(words[a : a + 50])
            first[w] = min(first.get(w, 2**60), order(i))
    want = []
    for i, text in rows:
        words = text.split()
        gone = {p for a in range(len(words) - 49) if first[tuple(words[a : a + 50])] < order(i) for p in range(a, a + 50)}
        want.append((order(i), len(words), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest()))
    assert sum(w[2] > 0 for w in want) > 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_a_short_passage_amid_different_words_is_no_hot_group(spark):
    rng = random.Random(41)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    short, long = say(45), say(70)
    texts = [f"{say(40)} {short} {say(40)}" for _ in range(3000)] + [f"{say(30)} {long} {say(30)}" for _ in range(30)]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    rows = d.select(F.col("doc_id").alias("doc"), "text")
    for maker, wide in ((substring_dedup._anchors(50), 6), (suffix_dedup._phrases(100, 32), 40)):
        anchors = rows.mapInArrow(maker, repeats.ANCHOR).where("state <> 1")
        batches = 6 * 12  # phrases leave in steps of some hundred kilobytes
        assert anchors.groupBy("g").count().agg(F.max("count")).first()[0] < (repeats.SPREAD + 1) * (6 if wide == 6 else batches)
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(d, 50).collect()}
    holders = [i for i, t in enumerate(texts) if long in t]
    assert {i for i, n in got.items() if n} == set(holders[1:]) and {got[i] for i in holders[1:]} == {70}
    small = d.where("doc_id < 400")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(small).collect()}
    assert got == brute_bytes([(i, t.encode()) for i, t in enumerate(texts[:400])], 100)


def test_suffix_ranks_are_the_order_of_the_suffixes():
    rng = np.random.default_rng(8)
    for length in (8, 9, 16, 40, 100, 101):
        data = rng.integers(97, 99, 600, np.uint8)
        data[300:450] = data[40:190]
        rank = suffix_dedup.suffix_ranks(data, length)
        whole = data.tobytes()
        strings = [whole[i : i + length] for i in range(600 - length + 1)]
        rank = rank[: len(strings)]
        order = np.argsort(rank, kind="stable")
        assert [strings[i] for i in order] == sorted(strings)
        assert len(set(rank.tolist())) == len(set(strings))


def test_entries_stay_in_whole_groups_over_batch_borders(monkeypatch):
    rng = random.Random(17)
    phrases = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(30)]
    rows = sorted((rng.randrange(40), rng.choice(phrases)[: rng.randrange(50, 61)], i, rng.randrange(1000)) for i in range(400))
    first, want = {}, set()
    for g, x, doc, lo in sorted(rows, key=lambda r: r[2:]):
        for p in range(len(x) - 39):
            if first.setdefault((g, x[p : p + 40]), (doc, lo + p)) != (doc, lo + p):
                want |= {(doc, lo + p + i) for i in range(40)}
    # A string that lies in two groups isn't a case that triggers make: give each group its own bytes.
    rows = [(g, x.translate(bytes((c + g) % 256 for c in range(256))), doc, lo) for g, x, doc, lo in rows]
    for size in (1, 7, 64, 400):
        for ordered in (50, 700, 10**6):
            monkeypatch.setattr(suffix_dedup, "ORDERED", ordered)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["g", "phrase", "doc", "lo"]) for i in range(0, 400, size)]
            got = {(r["doc"], p) for b in suffix_dedup._ordered(40)(iter(batches)) for r in b.to_pylist() for p in range(r["lo"], r["hi"])}
            assert got == want


@pytest.mark.parametrize("most", [1, 3])
def test_big_groups_go_by_longer_triggers_and_by_strings(docs, monkeypatch, most):
    monkeypatch.setattr(repeats.scan, "__defaults__", (most,))
    want = brute_bytes(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()), 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want


def test_scan_over_batch_borders():
    rng = random.Random(5)
    for groups, keys in ((6, 3), (60, 2), (200, 2)):
        rows = sorted({(rng.randrange(groups), rng.randrange(keys), i // 20, rng.randrange(50) * 8 + i % 8) for i in range(400)})
        for across in (False, True):
            first: dict = {}
            for g, k, doc, _ in rows:
                first.setdefault((g, k), doc)
            several = collections.Counter(g for g, _ in first)
            want, seen = [], set()
            for g, k, doc, lo in rows:
                covered = doc > first[g, k] if across else (g, k) in seen
                seen.add((g, k))
                if covered or several[g] > 1:
                    want.append((doc, lo, lo + 1, repeats.COVERED if covered else repeats.EDGE))
            assert all(_scan(rows, size, across) == sorted(want) for size in (1, 2, 7, 50, 10**6))
            # Groups of over two keys are big.
            big = {(doc, lo) for g, k, doc, lo in rows if several[g] > 2}
            told = sorted((d, a, b, repeats.BIG if s == repeats.EDGE and (d, a) in big else s) for d, a, b, s in want)
            if len({r[2:] for r in rows}) == len(rows):
                assert all(_scan(rows, size, across, 2) == told for size in (1, 2, 7, 50, 10**6))


def _scan(rows, size, across, most=repeats.GROUP):
    def batches():
        for lo in range(0, len(rows), size):
            g, k, doc, lo_ = (np.array(x) for x in zip(*rows[lo : lo + size], strict=True))
            yield repeats.rows_batch({"g": g, "k": k, "doc": doc, "lo": lo_.astype(np.int32), "hi": (lo_ + 1).astype(np.int32), "state": np.zeros(len(g), np.int32)})

    return sorted(tuple(r.values()) for b in repeats.scan(across, most)(batches()) for r in b.to_pylist())


def fingerprint(text):
    w = lower(text).split()
    sh = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict, distance: int) -> dict:
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in fps}


def test_simhash(docs, empty):
    fps = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = components(fps, 3)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    text = "one two three four five"
    d = spark.createDataFrame([(None, text), (5, text.upper()), (5, text), (7, None), (2, ""), (2, " \n"), (9, "alone in here")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(d).collect()), key=str)
    assert got == sorted([(None, None), (5, None), (5, None), (7, 2), (2, 2), (2, 2), (9, 9)], key=str)


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_fingerprint_links_find_every_pair(spark, group_rows):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), group_rows=group_rows).collect()
    got = {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in links}
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    assert got <= want and partition(fps, got) == partition(fps, want) and len(partition(fps, want)) < len(fps)


def partition(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = collections.defaultdict(set)
    for x in nodes:
        groups[root(x)].add(x)
    return sorted(sorted(g) for g in groups.values())


def test_a_hot_key_is_dealt_out_by_further_bits(spark):
    rng = random.Random(19)
    # All share the low 40 bits; clusters within the others, so that many keys are hot.
    fps = {(rng.getrandbits(24) << 40) | 0x123456789A for _ in range(300)}
    fps |= {x ^ (1 << rng.randrange(40, 64)) ^ (1 << rng.randrange(40, 64)) for x in list(fps) for _ in range(3)}
    d = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    links = simhash.fingerprint_links(d, group_rows=100).collect()
    got = {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in links}
    assert got <= want and partition(fps, got) == partition(fps, want)


def test_spanning_links_of_a_dense_group_are_fewer_than_its_rows():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(0x0F0F0F0F0F0F0F0F) ^ (np.uint64(1) << rng.integers(0, 64, 2500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2500, np.uint64)))
    u, v = simhash.spanning_links(fps, 3)
    pairs = [(a, b) for i, j in simhash.linked_blocks(fps, 3) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    want = int((np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3).sum() - len(fps)) // 2
    assert len(pairs) == want > 10 * len(fps) and len(u) < len(fps)
    assert partition(range(len(fps)), zip(u.tolist(), v.tolist(), strict=True)) == partition(range(len(fps)), pairs)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 500]], "node bigint")
    got = {r.node: r.root for r in with_components(nodes, spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 500: 500}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        w = [rng.choice(WORDS) + str(rng.randrange(2000)) for _ in range(rng.randrange(40, 300))]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(0, 6)):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(10**6))
            rows.append(" ".join(v))
    rows += [None, "", "a b", "A  b"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    sets = {i: frozenset(simhash.shingle_hashes(lower(t), 5)) for i, t in enumerate(rows)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(d).collect()}
    assert got == {i: find(i) for i in sets}


def near_groups(sets):
    """Groups of near duplicates by looking at every pair of sets."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_in_a_dense_group_of_edited_copies(spark):
    rng = random.Random(21)
    base = [f"b{k}" for k in range(204)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(204), rng.randrange(3, 7)):
            w[k] = f"e{i}x{k}"
        rows.append(" ".join(w))
    want = near_groups([frozenset(simhash.shingle_hashes(t.encode(), 5)) for t in rows])
    assert 1 < len(set(want)) < len(rows)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(d).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("most", [6, 9])
def test_near_duplicates_in_a_family_of_1500_edited_copies(spark, most):
    rng = random.Random(23)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(1500):
        w = list(base)
        for k in rng.sample(range(300), rng.randrange(1, most + 1)):
            w[k] = f"e{i}x{k}"
        rows.append(" ".join(w))
    # Every pair, by the product of the shingles' incidence.
    sets = [sorted(set(simhash.shingle_hashes(t.encode(), 5))) for t in rows]
    number = {h: k for k, h in enumerate(sorted({h for x in sets for h in x}))}
    inside = np.zeros((1500, len(number)), np.float32)
    for i, x in enumerate(sets):
        inside[i, [number[h] for h in x]] = 1
    both, n = inside @ inside.T, inside.sum(1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    least = np.arange(1500)
    while True:
        step = np.array([least[x].min() for x in near])
        if (step == least).all():
            break
        least = step
    assert (len(set(least.tolist())) == 1) == (most == 6)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(d).collect()}
    assert [got[i] for i in range(1500)] == least.tolist()


def test_near_duplicates_of_repeated_ids_and_clashing_columns(spark):
    text, near, other = (" ".join(f"w{k}" for k in range(60)) + x for x in ("", " more", " else"))
    far = " ".join(f"z{k}" for k in range(60))
    rows = [(5, text, 1), (5, text, 2), (5, far, 3), (6, near, 4), (None, other, 5), (7, far, 6), (8, None, 7), (8, "", 8), (9, "  ", 9), (10, "one of its kind", 10)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, `a.b` int, root string, doc string")
    got = sorted((r["a.b"] for r in near_duplicates.one_of_each_group(d).collect()))
    assert got in ([3, 5, 7, 10], [3, 5, 8, 10])
    assert near_duplicates.one_of_each_group(d).columns == d.columns
    groups = near_duplicates.near_duplicate_groups(d).collect()
    assert sorted((r.doc_id or 0, r.group_id or 0) for r in groups) == [(0, 0), (5, 0), (5, 0), (5, 5), (6, 0), (7, 5), (8, 8), (8, 8), (9, 8), (10, 10)]
    unique = d.where("`a.b` IN (1, 4, 5, 6, 7)")
    assert sorted(r["a.b"] for r in near_duplicates.one_of_each_group(unique).collect()) == [5, 6, 7]
    assert near_duplicates.one_of_each_group(d.limit(0)).count() == 0


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles, by stage."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_near_duplicates_shuffle_only_texts_that_they_need(spark, tmp_path):
    rng = random.Random(24)
    texts = [[f"{rng.getrandbits(240):060x}" for _ in range(300)] for _ in range(400)]
    rows = [" ".join(w) for w in texts] + [" ".join([*w[:-1], "edit"]) for w in texts[:20]]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    path = str(tmp_path)
    d.write.parquet(f"{path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where all sides are large
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        seen = shuffled_bytes(spark)
        near_duplicates.one_of_each_group(spark.read.parquet(f"{path}/docs")).write.parquet(f"{path}/out")
        moved = sum(n for stage, n in shuffled_bytes(spark).items() if stage not in seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in spark.read.parquet(f"{path}/out").collect()) == list(range(400))
    assert moved < 0.8 * sum(map(len, rows)), (moved, sum(map(len, rows)))


def test_filter_of_ids_loses_none(spark):
    rows = spark.range(0, 40_000).select((F.col("id") * 7 - 1000).alias("doc"))
    ids = rows.where("doc % 50 = 0").unionAll(spark.createDataFrame([(-(2**63),)], "doc bigint"))
    rows = rows.unionAll(spark.createDataFrame([(-(2**63),)], "doc bigint"))
    got = {how: [r.doc for r in near_duplicates.passing(rows, ids, F.col("doc"), how).collect()] for how in ("left_semi", "left_anti")}
    want = {r.doc for r in ids.collect()}
    assert want <= set(got["left_semi"]) and not want & set(got["left_anti"])
    assert sorted(got["left_semi"] + got["left_anti"]) == sorted(r.doc for r in rows.collect())
    assert len(got["left_semi"]) < len(want) + 50
    assert near_duplicates.passing(rows, ids.limit(0), F.col("doc")).count() == 0


def test_near_duplicates_loses_no_pair_of_short_texts(spark):
    rng = random.Random(22)
    rows = []
    for i in range(2000):  # 4 of 5 shingles: exactly 0.8
        w = [f"s{i}x{k}" for k in range(9)]
        rows += [" ".join(w), " ".join(w[:8])]
    rows += [" ".join(f"s{rng.randrange(2000)}x{k}" for k in range(9)) for _ in range(500)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(d).collect()}
    assert [got[i] for i in range(4000)] == [i // 2 * 2 for i in range(4000)]
    assert all(got[i] == i for i in range(4000, 4500))


def test_shingle_runs_stay_whole_or_are_cut_by_size():
    token = np.array([1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5])
    root = np.array([7, 7, 8, 1, 1, 2, 2, 3, 4, 5, 9, 1, 2])
    for step in range(1, 14):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + step]) for c in (token, root)], names=["token", "root"]) for lo in range(0, 13, step)]
        for most in (0, 3):
            seen = [(t, part) for (t, _), part in near_duplicates._runs(iter(batches), ["token", "root"], most)]
            assert np.concatenate([t for t, _ in seen]).tolist() == token.tolist()
            whole = [set(t.tolist()) for t, part in seen if not part]
            assert sum(map(len, whole)) == len(set().union(*whole))
            assert all(set(t.tolist()) == {3} for t, part in seen if part)


def test_spanning_links_of_a_large_group_keep_it_connected():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, 2, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 2), dtype=np.uint64)
    links = near_duplicates.spanning_links(center ^ flips, 30)
    parent = list(range(3000))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert len({find(i) for i in range(3000)}) == 1 and len(links) < 3000


def test_forests_hold_leaders_only_of_a_group_without_end():
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2**63, 2, dtype=np.uint64)
    prints = (center ^ (np.uint64(1) << rng.integers(0, 64, (20_000, 2), dtype=np.uint64))).view(np.int64)
    names = ["key", "doc", "f1", "f2"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(500, 7), np.arange(lo, lo + 500), prints[lo : lo + 500, 0].copy(), prints[lo : lo + 500, 1].copy())], names=names)
        for lo in range(0, 20_000, 500)
    ]
    links = [(r["u"], r["v"]) for b in near_duplicates._forests(30)(iter(batches)) for r in b.to_pylist()]
    seen, edges = {0}, collections.defaultdict(list)
    for a, b in links:
        edges[a].append(b)
        edges[b].append(a)
    todo = [0]
    while todo:
        for x in edges[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    assert len(seen) == 20_000 and len(links) < 20_000


def brute_tiles(test, doc, least):
    """Greedy string tiling by looking at every pair of positions, longest run first."""
    free_t, free_d, tiles = [True] * len(test), [t >= 0 for t in doc], []
    while True:
        best = (0, 0, 0)
        for i in range(len(test)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(test) and j + n < len(doc) and free_t[i + n] and free_d[j + n] and test[i + n] == doc[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append(n)
        free_t[i : i + n] = [False] * n
        free_d[j : j + n] = [False] * n


def test_greedy_tiles_match_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        test = [rng.randrange(4) for _ in range(rng.randrange(5, 25))]
        cut = rng.randrange(len(test))
        doc = [rng.randrange(4) for _ in range(5)] + test[cut:] + [-1, *test[:cut]]
        tiles = decontamination.greedy_tiles(test, doc, 3)
        assert sorted(n for n, _, _ in tiles) == sorted(brute_tiles(test, doc, 3))
        assert all(test[i : i + n] == doc[j : j + n] for n, i, j in tiles)
        assert len({p for n, i, _ in tiles for p in range(i, i + n)}) == sum(n for n, _, _ in tiles)


@pytest.mark.parametrize("broadcast_tokens", [200_000, 0])
def test_decontamination(spark, broadcast_tokens):
    item = "the quick brown fox jumps over the lazy dog while nine old clocks strike twelve at noon".split()
    other = "an unrelated question about rivers mountains lakes and seas of the world".split()
    moved = item[9:] + ["filler"] + item[:9]
    texts = {1: " ".join(["lead", *item, "tail"]), 2: "A. " + " ".join(moved).upper(), 3: " ".join(item[:8]), 4: None, 5: "", 6: "-- " + " --\n".join(item), 7: " ".join(["w"] * 5000 + item), 8: " ".join(other[:5])}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, item_id string")
    tests = spark.createDataFrame([(10, " ".join(item), 1), (11, " ".join(other), 1), (12, None, 1), (13, "too short", 1)], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontamination.decontaminate(docs, tests, broadcast_tokens=broadcast_tokens).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 10)}
    assert got[2, 10].n_tiles == 2 and got[1, 10].coverage == 1.0
    assert decontamination.decontaminate(docs, tests.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big, small = "<p>é\r\n\r\n" * 300, "tiny"
    rng = random.Random(8)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(200_000))
    rows = [(1, "http://a/", big), (2, "http://b/%\n", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", noise), (None, "u", "null id")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, sha1 string").repartition(2)
    from vellum.llm.common import new_dir

    folder = new_dir(spark, "warc")
    manifest = warc.write_warc(pages, folder)
    for split in (64, 1000, 1 << 22):  # ranges far smaller than a record, and one for all
        got = {r.page_id: r for r in warc.read_warc(spark, manifest, folder, split, with_payload=True).collect()}
        assert len(got) == len(rows)
        for i, url, html in rows:
            data = (html or "").encode()
            r = got[i]
            assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), hashlib.sha1(data).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
            assert r.payload == (None if i in (1, 2) else html or "")
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_ranges_go_to_a_task_each(spark, tmp_path):
    rows = [(i, f"https://example.org/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 60) for i in range(300)]
    folder = f"{tmp_path}/warc"
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), folder)
    ranges = sum(-(-r.bytes // 4096) for r in manifest.collect())
    got = warc.read_warc(spark, manifest, folder, split_bytes=4096)
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert ranges > 5 and got.rdd.getNumPartitions() == ranges and tasks > ranges / 2
    assert sorted(r.page_id for r in got.collect()) == list(range(300))
    assert warc.read_warc(spark, manifest, folder, split_bytes=4096, most_tasks=2).rdd.getNumPartitions() == 2


def test_warc_repeated_rows(spark):
    big = "x" * 1000
    rows = [(4, "u", big), (4, "u", big), (2, "u", big), (2, "u", big), (None, "u", big), (1, "u", "x" * 999), (0, "u", "x" * 999)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(4, "response", None)] * 2 + [(2, "revisit", 4)] * 2 + [(None, "revisit", 4), (1, "response", None), (0, "response", None)], key=str
    )


def test_warc_reader_rejects_false_magic():
    record = warc._record(1, "u", b"x", 1, hashlib.sha1(b"x").hexdigest(), None)
    archive = b"\x1f\x8b\x08 junk" + warc._gzip(b"not a record") + warc._gzip(record) + b"\x1f\x8b\x08" + warc._gzip(record)
    assert len(list(warc.records_in(io.BytesIO(archive), 0, len(archive), chunk=7))) == 2
    starts = [s for s in range(len(archive)) if list(warc.records_in(io.BytesIO(archive), s, s + 1))]
    assert len(starts) == 2


def test_url_filter_rules_and_features(spark):
    urls = {
        1: "http://a.org/x", 2: "https://EXAMPLE.org/es/1", 3: "http://m.example.org/en/17?q=1", 4: "http://x.com/fr/1", 5: "http://x.com/de/1", 6: "http://x.com/en/1",
        7: None, 8: "", 9: "no scheme", 10: "http://badexample.org/es/", 11: "ftp://org", 12: "http://net/?a=1&b=2#f", 13: "http://a.org?x/", 14: "http://x.com/fr",
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls.items()] * 2, "page_id bigint, url string, host string")
    got = collections.defaultdict(list)
    for r in url_filter.url_filter(pages).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values()) and len(got) == len(urls)
    rules = {i: v[0][2] for i, v in got.items()}
    assert rules == {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "com/fr/", 5: "com/de/", 10: "org/", **dict.fromkeys((6, 7, 8, 9, 11, 12, 13, 14))}
    assert got[3][0][:2] == ("m.example.org", "/en/17") and got[13][0][:2] == ("a.org", "") and got[7][0][:2] == ("", "")
    assert {v[0][3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_trees_learn_held_out_urls(spark):
    rng = random.Random(10)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.4
        rows.append((f"http://h{i}.net/" + ("9" * rng.randrange(6, 12) if bad else "page" * rng.randrange(1, 3)), 1, float(bad)))
    frame = spark.createDataFrame(rows, "url string, n int, label double")
    features = url_filter.with_features(url_filter.with_parts(frame))
    prior, trees = url_filter.train(features.where("pmod(xxhash64(url), 3) <> 0"), rounds=3)
    margin = sum((url_filter.tree_column(t) for t in trees), F.lit(prior))
    held = features.where("pmod(xxhash64(url), 3) = 0").select("label", (margin > 0).cast("double").alias("said")).collect()
    assert np.mean([r.label == r.said for r in held]) > 0.95


def toxic_rows(n=500, seed=12):
    rng = random.Random(seed)
    rows, labels = [(10_000, None), (10_001, "")], []
    for i in range(n):
        bad = rng.random() < 0.3
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten", "crooked"]).title())
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_labels(spark):
    rows, labels = toxic_rows()
    got = toxicity.toxicity(spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([truth[r.doc_id] == r.predicted for r in got if r.held_out and r.doc_id in truth]) > 0.97


def test_toxicity_of_repeated_rows_and_labels(spark):
    rows, labels = toxic_rows(200)
    d = spark.createDataFrame(rows + rows[2:4] + [(None, rows[5][1])], "doc_id bigint, text string")
    got = toxicity.toxicity(d, spark.createDataFrame(labels * 2 + [(None, 1, 1), (77_777, None, None)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 3
    scores = collections.defaultdict(set)
    for r in got:
        scores[r.doc_id].add(r.score)
    assert all(len(x) == 1 for x in scores.values()) and scores[None] == scores[rows[5][0]]


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(20)
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}


def test_vocabulary_finds_the_chosen_terms():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab.-") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [b" ".join(rng.choice(words) for _ in range(50)) for _ in range(200)]
    every = sorted(set().union(*[terms.terms_of(t) | terms.shape_terms(t) for t in texts]))
    number = {t: i for i, t in enumerate(rng.sample(every, 400))}
    vocabulary = terms.Vocabulary(list(number))
    for t in texts:
        assert vocabulary.numbers(t) == sorted(number[x] for x in terms.terms_of(t) | terms.shape_terms(t) if x in number)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    dense = np.zeros((700, 60))
    for i in range(700):
        terms = rng.choice(60, rng.integers(1, 12), replace=False)
        terms = np.unique(terms * terms // 60)
        dense[i, terms] = rng.random(len(terms)) ** 4
        dense[i] /= np.linalg.norm(dense[i])
    example, term = np.nonzero(dense)
    mixed = rng.permutation(len(example))
    index = toxicity.BlockMaxIndex(example[mixed], term[mixed], dense[example, term][mixed], 700, 60, block=32)
    read = []
    scores = index.from_rows
    index.from_rows = lambda *x: read.append(1) or scores(*x)
    assert 0 < (index.row >= 0).sum() < 60  # both kinds of postings
    for i in range(0, 700, 7):
        terms = np.flatnonzero(dense[i])
        exact = dense @ dense[i]
        for but in (-1, i):
            rest = exact if but < 0 else np.where(np.arange(700) == i, 0.0, exact)
            at, sims = index.nearest(terms, dense[i, terms], 10, but)
            kth = np.sort(rest)[-10]
            assert set(at) == set(np.flatnonzero((rest >= kth - toxicity.TIE) & (rest > 0))) and np.allclose(sims, exact[at], atol=1e-6)
    assert len(read) < 0.9 * 200 * index.blocks  # blocks are left out


def test_toxicity_model_is_tf_idf_over_all_words(spark):
    rows, labels = toxic_rows(300, seed=5)
    rows.append((20_000, "Word1 word1, word1! (word2) unheard-of"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    truth = {i: t for i, _, t in labels}
    bags = {i: collections.Counter(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in t.lower().split()) for i, t in rows if t}
    n, ones = len(truth), sum(truth.values())
    df = collections.Counter(w for i in truth for w in bags[i])
    df1 = collections.Counter(w for i in truth if truth[i] for w in bags[i])
    assert set(model.known) == {w.encode() for w in df}

    def vector(bag):
        v = {}
        for w, tf in bag.items():
            if w in df:
                a, b, c = df1[w], df[w] - df1[w], ones - df1[w]
                e = n - a - b - c
                spread = (a + b) * (c + e) * (a + c) * (b + e)
                phi = abs(a * e - b * c) / spread**0.5 if spread else 0.0
                v[w] = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df[w])) + 1) * (phi + 0.001)
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(bags[i]) for i in truth}
    for i in [*range(0, 300, 30), 20_000]:
        own = vector(bags[i])
        cosines = sorted(((sum(x * vectors[j].get(w, 0.0) for w, x in own.items()), j) for j in truth), reverse=True)
        terms, w = model.vector(dict(rows)[i].lower().encode())
        at, sims = model.index.nearest(terms, w, 15)
        assert np.allclose(np.sort(sims)[::-1][:15], [c for c, _ in cosines[:15]], atol=1e-6)
        assert {int(model.ids[x]) for x in at} >= {j for c, j in cosines[:15] if c > cosines[14][0] + 1e-5}


def test_the_labelled_sample_is_bounded_by_rows_and_bytes(spark):
    many = spark.range(50_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    same = spark.range(50_000).selectExpr("8L AS doc_id", "'one text' AS text")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    sample = terms.labelled_sample(many.unionAll(same), labels, "toxic", 2000)
    assert 1500 < sample.count() < 2500 and sample.where("doc_id = 8").count() <= 1
    assert terms.labelled_sample(same, labels, "toxic", 2000).collect()[0].label == 1
    small = terms.labelled_sample(many, labels, "toxic", 2000, bound_bytes=5000).agg(F.sum(F.length("text"))).first()[0]
    assert 1500 < small < 10_000
    assert terms.labelled_sample(many, labels, "toxic", 2000, longest=6).count() == 10


def test_mixing_meets_its_targets(spark):
    rng = random.Random(13)
    rows, labels = [(900, None), (901, "")], []
    for i in range(600):
        d = rng.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]
        rows.append((i, " ".join([f"w{rng.randrange(50)}" for _ in range(rng.randrange(10, 80))] + [["good", "poor", "vile"][d]] * 3)))
        labels.append((i, int(d == 0), int(d == 2)))
    docs, labels = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, rate double"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    targets = {"high": 0.4, "low": 0.35, "toxic": 0.25}
    got = mixing.mix(docs, labels, targets, keep=["doc_id"]).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    total = sum(r.tokens for r in got)
    for d, t in targets.items():
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in got) / total - t) < 0.0003
    assert {r.missed for r in got} == {got[0].missed} and got[0].missed < 0.0003
    # Nothing rates at all brings one domain alone about.
    far = mixing.mix(docs, labels, {"high": 0.0, "low": 0.0, "toxic": 1.0}, keep=["doc_id"]).collect()
    shares = [sum(r.tokens * r.rate * r[f"p_{d}"] for r in far) / total for d in mixing.DOMAINS]
    assert far[0].missed == pytest.approx(max(shares[0], shares[1], 1 - shares[2]), abs=1e-6)


def test_posteriors_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = mixing.fit_domains(docs, labels, keep=toxicity.NOT_HELD_OUT)
    truth = labels.withColumn("label", F.expr(mixing.DOMAIN_SQL)).where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).where(f"NOT ({toxicity.NOT_HELD_OUT})")
    said = mixing.with_posteriors(docs.join(truth, "doc_id"), model, ["label"]).select("carried.label", "p").collect()
    p, y = np.array([r.p for r in said]), np.array([r.label for r in said])
    share = np.bincount(y, minlength=3) / len(y)
    loss, right = -np.log(p[np.arange(len(y)), y]).mean(), (p.argmax(1) == y).mean()
    print(f"held out: {len(y)}, right {right:.3f} (largest class {share.max():.3f}), log loss {loss:.3f} (shares alone {-(share * np.log(share)).sum():.3f}), mean posteriors {p.mean(0).round(3)} of {share.round(3)}")
    assert right > share.max() + 0.02 and loss < 0.95 * -(share * np.log(share)).sum() and np.abs(p.mean(0) - share).max() < 0.05


def test_projected_gradient_agrees_with_a_plain_one():
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    n = rng.integers(1, 100, 300)
    w, target, l2 = n / n.sum(), np.array([0.1, 0.2, 0.7]), 1e-2
    inverse = np.linalg.inv((p * w[:, None]).T @ p + 0.01 * np.eye(3))
    steps = []
    for _ in range(300):
        point = mixing.fold_rates(p, steps, l2)[1]
        steps.append(inverse @ ((w * point) @ p - target))
    rates, plain = mixing.fold_rates(p, steps, l2)[0], np.ones(300)
    for _ in range(20_000):
        plain = np.maximum(0, plain - (p @ (inverse @ ((w * plain) @ p - target)) + l2 * (plain - 1)) / (1 + l2))
    assert np.allclose(rates, plain, atol=1e-3)
