"""The license scan against Python's expressions and a containment test of every pair of matches."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.llm import license_scan as S
from vellum.llm.license_rules import BASE, CONFIDENCE, GATES, RULES, spaced, whole_words


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = words_of(text)
    norm = "".join(f" {w} " for w in words)
    places, base = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    found = [(norm.count(" ", 0, m.start()) // 2, norm.count(" ", 0, m.end()) // 2, r) for r in RULES for m in re.finditer(whole_words(r.pattern), norm)]
    kept = [
        (a, b, r)
        for a, b, r in found
        if not any(c <= a and d >= b and o.priority <= r.priority and ((c, d) != (a, b) or (o.priority, o.number) < (r.priority, r.number)) for c, d, o in found)
    ]
    labels = base | {r.label for *_, r in kept}
    score = max([CONFIDENCE[r.priority] for *_, r in kept] + [S.BASE_SCORE if base else 0.0])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score), sorted((r.label, r.number, r.priority, a, b) for a, b, r in kept)


def scanned(spark, texts):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, norm string, `row` string")
    rows = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in S.license_scan(d).collect()}
    spans = {i: [] for i in rows}
    for r in S.license_scan(d, detections=True).collect():
        spans[r.doc_id].append((r.label, r.number, r.priority, r.start, r.end))
    return [(rows[i], sorted(spans[i])) for i in range(len(texts))]


CASES = {
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "SPDX-License-Identifier: MIT": "mit",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "GNU General Public License, version 2 or (at your option) any later version": "gpl,gpl-2.0-or-later",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "shared under CC BY-NC-SA": "cc-by,cc-by-nc-sa",
    "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "All rights reserved.": "reserved",
    "dedicated to the public domain": "public-domain",
    "Wir fahren mit der Lizenz zum Apache": "",
    "the permissions of a cc byte": "",
    "3-clause BSD license": "bsd-3-clause",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
}


def test_labels_of_known_lines(spark):
    got = scanned(spark, list(CASES))
    assert {t: g[0][5] for t, g in zip(CASES, got, strict=True)} == CASES


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    lines = [*CASES, "cc by cc by CC-BY", "all rights reserved all rights reserved", "filler words é ÉÀ 12", "gnu gpl v3", "general public", "license", "Licence", "Ünder the öl MIT license", "copyright (c) 1999 2004 me"]
    texts = [None, "", " \t..", " ", *lines] + [rng.choice([" ", "\n", "", " -- "]).join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts.append(("word " * 300 + "Licensed under CC BY 4.0. mit license ") * 400)
    got = scanned(spark, texts)
    for text, own in zip(texts, got, strict=True):
        want = brute(text) if text is None or len(text) < 100_000 else None
        if want:
            assert own == want, text
    assert got[-1][0][:4] == (307 * 400 + 400, 400, 302, 399 * 308 + 302) and len(got[-1][1]) == 800


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in d.collect()}
    got = S.license_scan(d).collect()
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(rows[r.doc_id])[0] for r in got)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}")
def test_a_match_holds_its_gate_and_keyword(rule):
    @settings(max_examples=4, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(whole_words(rule.pattern).replace("[^ ]", "[a-z]"), fullmatch=True))
    def holds(text):
        assert spaced(rule.keyword) in text and any(spaced(g) in text for g in GATES) and spaced(rule.gate) in text
        assert rule.gate in GATES and text == "".join(f" {w} " for w in words_of(text))

    holds()


def test_repeated_rows_and_empty_tables(spark):
    kind = "doc_id bigint, text string"
    d = spark.createDataFrame([(1, "MIT license"), (1, "MIT license"), (1, "none"), (None, "cc by")], kind)
    assert sorted((str(r.doc_id), r.labels, r.score) for r in S.license_scan(d).collect()) == [("1", "", 0.0), ("1", "mit", 0.9), ("1", "mit", 0.9), ("None", "cc-by", 0.5)]
    assert S.license_scan(spark.createDataFrame([], kind)).count() == 0
