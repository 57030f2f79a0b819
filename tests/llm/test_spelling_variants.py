"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from vellum.llm import spelling_variants as S


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows):
    out = Counter()
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def brute(words):
    nears = {w: [x for x in words if edits(w, x)] for w in words}
    form = {}
    for w, own in nears.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(nears[w]), words[form[w]] if form[w] is not None else None)
    return out


def rows_of(df):
    got = df.collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")


def some_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 13))) for _ in range(40)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), 39)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", rng.choice("abé")]) + w[k + rng.randrange(2) :]
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1"]).join(out)))
    rows += [(1000, "chainaaaa " * 3 + "chainaaab " * 40 + "chainaabb " * 500)]  # a form of a form
    return rows + [(None, "unknown unknown unknowns"), (7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1])]


@pytest.mark.parametrize("owners", [500, 2])
def test_equal_to_every_pair(spark, owners):
    rows = some_rows(5)
    words = brute_words(rows)
    want = brute(words)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] not in (None, v[1]) for v in want.values())
    assert rows_of(S.spelling_variants(documents(spark, rows), owners=owners, shard_patterns=100)) == want


def test_hot_segments_lose_and_repeat_nothing(spark):
    """Words that all share a half, in either place, and are told apart by ever shorter segments."""
    words = {a + b for a in ("prefixed", "prefixes") for b in ("", "x", "y", "xy", "yx", "xx", "xyz", "yyz", "xyzz", "aaaa", "aaab", "aaba", "abaa")}
    words |= {a + "suffixed" for a in ("a", "b", "ab", "ba", "abc", "abd", "xbc", "abcd")} | {"a" * k for k in range(7, 40)} | {"é" * 100_000, "é" * 100_001, "é" * 50_000 + "a" + "é" * 50_000}
    n = {w: 1 + len(w) % 5 for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    for owners in (1, 3, 500):
        got = {r.word: (r.n_near, r.top, r.form) for r in S.near_words(table, owners=owners, shard_patterns=20).collect()}
        want = {}
        for w in words:
            own = [x for x in words if S.near(w, x)]
            if own:
                best = min(own, key=lambda x: (-n[x], x))
                want[w] = (len(own), n[best], best)
        assert got == want


def test_near_is_one_edit():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    assert all(S.near(a, b) == edits(a, b) for a in words for b in words)


def test_roots_follow_chains_of_any_length(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(20)] + [("x", "w010"), ("y", "z")]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{a: "w020" for a, _ in chain[:-1]}, "y": "z"}


def test_empty_tables_and_no_words(spark):
    assert rows_of(S.spelling_variants(documents(spark, []))) == {}
    assert rows_of(S.spelling_variants(documents(spark, [(1, "a b c"), (2, None), (3, "singleton")]))) == {}


def test_a_scan_compares_few_of_many_owners_and_finds_all(monkeypatch):
    rng, compared, near = random.Random(7), [], S.near
    words = sorted({"prefix" + "".join(rng.choice("abcdef") for _ in range(rng.choice((6, 6, 7, 5)))) for _ in range(4000)})
    shard = S.Shard()
    for w in words:
        shard.add(w, len(w), 6, 0, 0)
    monkeypatch.setattr(S, "near", lambda a, b: compared.append(a) or near(a, b))
    asked = words[::40]
    for w in asked:
        own = [x for x in words if near(w, x)]
        assert shard.scan(w)[:2] == (len(own), max(map(len, own), default=0))
    assert len(compared) < len(asked) * len(words) / 20
