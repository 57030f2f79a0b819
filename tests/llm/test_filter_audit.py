"""The filter audit against a walk through every order, row by row."""

import itertools
import re
from collections import Counter

from vellum.llm import filter_audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute(rows, labels):
    """rows (doc_id, text, source), labels {doc_id: (quality, toxic)}."""
    at = [((-(2**63) if i is None else i), t or "", s or "") for i, t, s in rows]
    first = {}
    for i, t, _ in at:
        first[t] = min(first.get(t, i), i)
    flags = [fails(t) | {"E": first[t] < i} for i, t, _ in at]
    out, shapley = {}, Counter()
    for part in {s for _, _, s in at}:
        mine = [k for k, r in enumerate(at) if r[2] == part]
        for order in itertools.permutations("ABCDE"):
            alive = set(mine)
            for step, f in enumerate(order, 1):
                failing = {k for k in mine if flags[k][f]}
                gone = failing & alive
                alive -= gone
                q = [labels.get(at[k][0], (0, 0)) for k in gone]
                only = sum(flags[k][f] and sum(flags[k].values()) == 1 for k in mine)
                out[part, "".join(order), step] = (len(alive), len(gone), len(failing) - len(gone), only, sum(x[0] == 1 for x in q), sum(x[1] == 1 for x in q))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, source string, flags int, part string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.filter_audit(docs, marks).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_equal_to_every_order_walked(spark):
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", " \t", long, long + " #", "A " * 300, "a " * 300, long.upper(), "ä" * 40 + "A", "ä" * 60 + "A", "one | two", "x y " * 250, long + "\r\nend"]
    rows = [(k if k % 9 else None, texts[k * 7 % len(texts)], [None, "", "s1", "s2", "a b"][k % 5]) for k in range(140)]
    rows += [(7, long, "s1"), (7, long, "s2"), (7, "other", "s1")] + [(k, "copied", "hot") for k in range(500, 900)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    known = {}
    for i, q, t in labels:
        if i is not None:
            known[i] = (max(known.get(i, (0, 0))[0], q), max(known.get(i, (0, 0))[1], t))
    want = brute(rows, known)
    got = audited(spark, rows, labels)
    assert got == want and len(got) == 600 * len({s or "" for *_, s in rows})


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    got = audited(spark, [(1, "a", None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_many_parts_and_a_very_long_text(spark):
    rows = [(k, f"text {k}", f"part {k}") for k in range(1000)] + [(3000, "Word " * 2_000_000, "long")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame([(3000, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.filter_audit(docs, marks).where("step = 1 and filter_order in ('BCADE', 'ABCDE')").collect()
    assert len(got) == 2 * 1001
    (long,) = [r for r in got if r.part == "long" and r.filter_order == "BCADE"]
    assert (long.kept, long.removed, long.redundant, long.unique_fails, long.good_lost, long.toxic_lost) == (0, 1, 0, 0, 1, 1)
    assert all((r.kept, r.removed) == ((1, 0) if r.filter_order == "BCADE" else (0, 1)) for r in got if r.part != "long")
