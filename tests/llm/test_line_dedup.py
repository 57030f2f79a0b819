"""Line deduplication against alignments of every pair of documents."""

import collections
import random

from oracle import connect, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from vellum.llm import line_dedup, queries


def filled(text):
    return [x.strip(b" \t\n\v\f\r") for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]


def brute(rows, least_words):
    """Places of the lines of each document in a run of least_words words that an earlier document has:
    every pair that shares a line, every diagonal of the pair."""
    lines = [(i, filled(t)) for i, t in sorted(rows)]
    holders = collections.defaultdict(list)
    for k, (_, own) in enumerate(lines):
        for x in set(own):
            holders[x].append(k)
    gone = {}
    for k, (i, own) in enumerate(lines):
        cut = set()
        for e in {e for x in set(own) for e in holders[x] if e < k}:
            places = collections.defaultdict(list)
            for p, x in enumerate(lines[e][1]):
                places[x].append(p)
            diagonals = collections.defaultdict(set)
            for q, x in enumerate(own):
                for p in places.get(x, ()):
                    diagonals[p - q].add(q)
            for at in diagonals.values():
                for q in at:
                    if q - 1 in at:
                        continue
                    end = q
                    while end in at:
                        end += 1
                    if sum(len(own[x].split()) for x in range(q, end)) >= least_words:
                        cut |= set(range(q, end))
        gone[i] = cut
    return gone


def patience_lines(a, b):
    """A textbook patience diff over lines: common ends, unique lines in rising order, then between them."""
    while_in = []
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        while_in.append((lo, lo))
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        while_in.append((ea, eb))
    ca, cb = collections.Counter(a[lo:ea]), collections.Counter(b[lo:eb])
    once = [(a.index(x, lo, ea), j) for j, x in enumerate(b[lo:eb], lo) if ca[x] == 1 and cb[x] == 1]
    best = []
    for k, (i, _) in enumerate(once):
        before = max((best[m] for m in range(k) if once[m][0] < i), key=len, default=[])
        best.append([*before, once[k]])
    chain = max(best, key=len, default=[])
    for (i0, j0), (i1, j1) in zip([(lo - 1, lo - 1), *chain], [*chain, (ea, eb)], strict=True) if chain else ():
        while_in += [(i0 + 1 + i, j0 + 1 + j) for i, j in patience_lines(a[i0 + 1 : i1], b[j0 + 1 : j1])]
    return sorted(while_in + chain)


def brute_patience(rows, least_words):
    """Places of the lines in blocks that a patience diff of every pair that shares a line aligns."""
    lines = [(i, filled(t)) for i, t in sorted(rows)]
    holders = collections.defaultdict(list)
    for k, (_, own) in enumerate(lines):
        for x in set(own):
            holders[x].append(k)
    gone = {}
    for k, (i, own) in enumerate(lines):
        cut = set()
        for e in {e for x in set(own) for e in holders[x] if e < k}:
            block, last = [], None
            for pair in [*patience_lines(lines[e][1], own), None]:
                if last is not None and pair != (last[0] + 1, last[1] + 1):
                    if sum(len(own[q].split()) for q in block) >= least_words:
                        cut |= set(block)
                    block = []
                if pair is not None:
                    block.append(pair[1])
                last = pair
        gone[i] = cut
    return gone


def latest_longest(values):
    """Places of a longest rising run, that of the latest: by comparing every pair."""
    size, before = [], []
    for i, v in enumerate(values):
        size.append(1 + max((size[j] for j in range(i) if values[j] < v), default=0))
        before.append(max((j for j in range(i) if size[j] == size[i] - 1), default=None))
    at = max((i for i, n in enumerate(size) if n == max(size)), default=None)
    out = []
    while at is not None:
        out.append(at)
        at = before[at] if size[at] > 1 else None
    return out[::-1]


def brute_aligned(rows, least_words):
    """Places of the lines that patience diff aligns with the earliest holders of a document's lines and short runs, and of
    those that match out of order."""
    lines = [(i, filled(t)) for i, t in sorted(rows)]

    def seeds(own):
        words, out = [len(x.split()) for x in own], set()
        for i in range(len(own)):
            ends = [(i, e) for e in range(i + 1, len(own) + 1) if sum(words[i:e]) >= least_words][:1]
            starts = [(b, i + 1) for b in range(i, -1, -1) if sum(words[b : i + 1]) >= least_words][:1]
            out |= {*ends, *starts}
        found = collections.defaultdict(list)
        for a, b in sorted(out):
            found[tuple(own[a:b])].append(a)
        return found

    holder, gone, moved = {}, {}, {}
    for i, own in lines:
        mine, by_partner = seeds(own), collections.defaultdict(list)
        for run, at in mine.items():
            if run in holder:
                partner, place, once = holder[run]
                by_partner[partner] += [(a, place, once and len(at) == 1, len(run)) for a in at]
            else:
                holder[run] = (i, at[0], len(at) == 1)
        cut, out_of_order = set(), set()
        for matches in by_partner.values():
            matches.sort(key=lambda m: (m[0], -m[1]))
            once = [m for m in matches if m[2]]
            anchors = [once[k] for k in latest_longest([m[1] for m in once])]
            kept = list(anchors)
            edges = [(-1, -1), *[m[:2] for m in anchors], (10**9, 10**9)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                between = [m for m in matches if not m[2] and lo[0] < m[0] < hi[0] and lo[1] < m[1] < hi[1]]
                kept += [between[k] for k in latest_longest([m[1] for m in between])]
            places = lambda ms: {p for a, _, _, n in ms for p in range(a, a + n)}
            cut |= places(kept)
            out_of_order |= places([m for m in matches if m not in kept])
        gone[i], moved[i] = cut, out_of_order - cut
    return gone, moved


#: With moved blocks gone, too, SQL can say what goes: a line in a run of up to five lines (each has a word)
#: with five words that an earlier document has.
MOVED_SQL = r"""
      WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS raw
        FROM documents),
      s AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
      f AS (SELECT *, count(*) FILTER (WHERE bare <> '') OVER (PARTITION BY doc_id ORDER BY raw) AS pos FROM s),
      g AS (SELECT doc_id, pos, bare, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS words FROM f WHERE bare <> ''),
      r AS (
        SELECT a.doc_id, a.pos, k.n, string_agg(b.bare, chr(10) ORDER BY b.pos) AS run
        FROM g a, range(1, 6) k(n), g b
        WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + k.n - 1
        GROUP BY 1, 2, 3 HAVING count(*) = k.n AND sum(b.words) >= 5),
      h AS (SELECT run, min(doc_id) AS holder FROM r GROUP BY 1),
      x AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM r JOIN h USING (run) WHERE holder < doc_id),
      k AS (SELECT f.*, x.pos IS NOT NULL AS gone FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.pos = f.pos)
      SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone AND bare <> '') AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY raw) FILTER (WHERE NOT gone), '')) AS kept_sha256
      FROM k GROUP BY 1"""


def test_with_moved_blocks_equal_to_sql(spark):
    path = "/root/testdata/sf0.01"
    got = line_dedup.line_dedup(spark.read.parquet(f"{path}/documents.parquet"), moved=True).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of_spark(got) == rows_of_duckdb(connect(path), MOVED_SQL)


def removed(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r for r in line_dedup.line_dedup(d, **kw).collect()}


def test_equal_to_brute_force_on_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    want = brute(rows, 5)
    got = {r.doc_id: r for r in line_dedup.line_dedup(d, moved=True).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert sum(map(len, want.values())) > 500
    for i, text in rows:
        kept = [x for p, x in enumerate(filled(text)) if p not in want[i]]
        assert filled(got[i].kept.encode()) == kept
    # By itself, the alignment decides: what it aligns goes, what matches out of order stays.
    gone, moved = brute_aligned(rows, 5)
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    assert {i: (r.n_removed, r.n_moved) for i, r in got.items()} == {i: (len(gone[i]), len(moved[i])) for i in gone}
    assert all(filled(got[i].kept.encode()) == [x for p, x in enumerate(filled(text)) if p not in gone[i]] for i, text in rows)
    assert sum(map(len, gone.values())) > 500 and sum(map(len, moved.values())) > 10 and all(gone[i] | moved[i] == want[i] for i in want)
    # Whatever patience diff aligns in any pair of documents is among these lines.
    aligned = brute_patience(rows, 5)
    assert all(aligned[i] <= want[i] for i in aligned) and sum(map(len, aligned.values())) > 500


def test_equal_to_brute_force_on_small_vocabularies(spark):
    rng = random.Random(31)
    lines = ["a b", "c", "d e f", "one two three four five", "g h i j", "six words are in this line", "k", ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(i, "\n".join(f"{rng.choice('pqrst')} {rng.randrange(4)}" for _ in range(rng.randrange(9)))) for i in range(60, 200)]
    want = brute([(i, t.encode()) for i, t in rows], 5)
    got = removed(spark, rows, moved=True)
    assert {i: r.n_removed for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    gone, moved = brute_aligned([(i, t.encode()) for i, t in rows], 5)
    got = removed(spark, rows)
    assert {i: (r.n_removed, r.n_moved) for i, r in got.items()} == {i: (len(gone[i]), len(moved[i])) for i in gone}


def test_without_an_alignment_nothing_goes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "patience", lambda matches: [])
    block = [f"line number {k} of a shared block" for k in range(4)]
    got = removed(spark, [(1, "\n".join(block)), (2, "\n".join(["two", *block]))])
    assert (got[2].n_removed, got[2].n_moved, got[2].kept) == (0, 4, "\n".join(["two", *block]))


def test_a_very_long_text(spark):
    rng = random.Random(9)
    lines = [f"line {k} of a text with very many lines {rng.random()}" for k in range(120_000)]
    got = removed(spark, [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[60_000:], *lines[:50_000]]))])
    assert (got[2].n_removed, got[2].n_moved) == (60_000, 50_000) and got[1].n_removed == 0


def test_a_block_whose_lines_each_have_an_earlier_holder(spark):
    block = [f"line {k} has a first holder of its own" for k in range(6)]
    rows = [(k, f"{block[k]}\nother text {k}") for k in range(6)]
    rows += [(10, "\n".join(["head of ten", *block])), (11, "\n".join(["eleven says", *block, "ends"]))]
    got = removed(spark, rows)
    assert [got[i].n_removed for i in (10, 11)] == [6, 6]
    assert got[11].kept == "eleven says\nends"


def test_a_block_that_its_first_document_holds_twice(spark):
    block = [f"repeated line number {k} of five" for k in range(5)]
    rows = [(1, "\n".join([*block, "between", *block])), (2, "\n".join(["two", *block])), (3, "\n".join(["three", *block, "end"]))]
    got = removed(spark, rows)
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 5, 5]


def test_seeds_of_short_lines_and_least_words(spark):
    block = ["a b", "c d", "e f"]
    rows = [(0, "\n".join(["x", *block, "y"])), (1, "\n".join(["p", *block, "q"])), (2, "a b\nz\nc d"), (3, "\n".join(["a b", "", "c d", " ", "e f", "", "rest"]))]
    got = removed(spark, rows)
    assert [got[i].n_removed for i in range(4)] == [0, 3, 0, 3]
    assert got[3].kept == "rest"
    assert [removed(spark, rows, least_words=7)[i].n_removed for i in range(4)] == [0, 0, 0, 0]


def test_moved_blocks_are_told_apart(spark):
    a, b = [f"first block line {k} x" for k in range(3)], [f"second block line {k} y" for k in range(2)]
    rows = [(0, "\n".join([*a, "mid", *b])), (1, "\n".join([*b, "other", *a]))]
    got = removed(spark, rows, moved=True)
    assert (got[1].n_removed, got[1].n_moved, got[1].kept) == (5, 2, "other")
    still = removed(spark, rows)
    assert (still[1].n_removed, still[1].n_moved, still[1].kept) == (3, 2, "\n".join([*b, "other"]))


def test_patience_rises_and_takes_unique_matches_first():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 15)
        matches = sorted(((rng.randrange(12), rng.randrange(12), rng.random() < 0.5) for _ in range(n)), key=lambda m: (m[0], -m[1]))
        got = [matches[i] for i in line_dedup.patience(matches)]
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        sure = [m[1] for m in matches if m[2]]
        best = [1] * len(sure)
        for i in range(len(sure)):
            best[i] += max((best[j] for j in range(i) if sure[j] < sure[i]), default=0)
        assert sum(m[2] for m in got) == max(best, default=0)


def test_edge_cases(spark):
    kind = "doc_id bigint, text string, `a.b` int, doc string, carried string"
    text = "one line of five words\nanother line of five words\n\n"
    rows = [(None, text, 1, "x", "y"), (2, None, 2, "x", "y"), (3, "", 3, "x", "y"), (4, text, 4, "x", "y"), (5, text, 5, "x", "y"), (5, text, 5, "x", "y"), (5, "z " + text, 6, "x", "y")]
    d = spark.createDataFrame(rows, kind)
    got = line_dedup.line_dedup(d, carry=["a.b", "doc"]).select("*", F.col("carried.`a.b`").alias("n")).collect()
    assert sorted((r.n, r.n_lines, r.n_removed) for r in got) == [(1, 2, 0), (2, 0, 0), (3, 0, 0), (4, 2, 2), (5, 2, 2), (5, 2, 2), (6, 2, 1)]
    assert line_dedup.line_dedup(d.limit(0), carry=["a.b"]).count() == 0


def test_one_line_in_every_document_gives_one_match_each(spark):
    rows = [(i, f"own line of document {i}\nthis line stands in all documents\nmore of {i}") for i in range(3000)]
    got = removed(spark, rows)
    assert [got[i].n_removed for i in range(3000)] == [0, *[1] * 2999]


def seed_places(own, least_words):
    """Places of every run of lines of least_words words that can't be shortened from the end or from the start."""
    words, out = [len(x.split()) for x in own], set()
    for i in range(len(own)):
        out |= set([(i, e) for e in range(i + 1, len(own) + 1) if sum(words[i:e]) >= least_words][:1])
        out |= set([(b, i + 1) for b in range(i, -1, -1) if sum(words[b : i + 1]) >= least_words][:1])
    found = collections.defaultdict(list)
    for a, b in sorted(out):
        found[tuple(own[a:b])].append(a)
    return found


def first_longest(pairs):
    """A longest run of pairs that rises in both: by comparing every two, with the smallest partners from the end on."""
    pairs, size = sorted(pairs), {}
    for a, b in pairs:
        size[a, b] = 1 + max((size[m] for m in size if m[0] < a and m[1] < b), default=0)
    out, n, ends = [], max(size.values(), default=0), pairs
    while n:
        out.append(min((m for m in ends if size[m] == n), key=lambda m: (m[1], m[0])))
        n, ends = n - 1, [m for m in pairs if m[0] < out[-1][0]]
    return out[::-1]


def brute_every_pair(rows, least_words):
    """Places of the lines that patience diff aligns with any earlier document that shares a seed, and of the other lines in
    seeds that earlier documents have: every pair, all places, no class and no round."""
    docs = [(i, seed_places(filled(t), least_words)) for i, t in sorted(rows)]
    gone, moved = {}, {}
    for k, (i, mine) in enumerate(docs):
        cut, held = set(), set()
        for _, theirs in docs[:k]:
            once, others = {}, collections.defaultdict(int)
            for run in mine.keys() & theirs.keys():
                held |= {p for a in mine[run] for p in range(a, a + len(run))}
                for a in mine[run]:
                    for b in theirs[run]:
                        at = once if len(mine[run]) == len(theirs[run]) == 1 else others
                        at[a, b] = max(at.get((a, b), 0), len(run))
            sure = sorted(once, key=lambda m: (m[0], -m[1]))
            anchors = [sure[x] for x in latest_longest([b for _, b in sure])]
            kept = {m: once[m] for m in anchors}
            for lo, hi in zip([(-1, -1), *anchors], [*anchors, (10**9, 10**9)], strict=True):
                kept |= {m: others[m] for m in first_longest([m for m in others if lo[0] < m[0] < hi[0] and lo[1] < m[1] < hi[1]])}
            cut |= {p for (a, _), n in kept.items() for p in range(a, a + n)}
        gone[i], moved[i] = cut, held - cut
    return gone, moved


def test_every_earlier_document_equal_to_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    whole = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    rng = random.Random(32)
    lines = ["a b", "c", "d e f", "one two three four five", "g h i j", "six words are in this line", "k", ""]
    small = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12))).encode()) for i in range(60)]
    small += [(i, "\n".join(f"{rng.choice('pqrst')} {rng.randrange(4)}" for _ in range(rng.randrange(9))).encode()) for i in range(60, 160)]
    small += [(i, "\n".join(f"line {c} has words enough" for c in rng.sample("uvwxyz", rng.randrange(1, 7))).encode()) for i in range(160, 300)]
    for rows, differ in ((whole, 10), (small, 50)):
        gone, moved = brute_every_pair(rows, 5)
        got = removed(spark, [(i, t.decode()) for i, t in rows], every=True)
        assert {i: (r.n_removed, r.n_moved) for i, r in got.items()} == {i: (len(gone[i]), len(moved[i])) for i in gone}
        assert all(filled(got[i].kept.encode()) == [x for p, x in enumerate(filled(t)) if p not in gone[i]] for i, t in rows)
        earliest, _ = brute_aligned(rows, 5)
        assert sum(gone[i] != earliest[i] for i in gone) > differ


def test_a_later_holder_counts_where_the_earliest_has_another_order(spark):
    a, b, c = ([f"{name} block line {k} of three" for k in range(3)] for name in ("first", "second", "third"))
    rows = [(0, [*a, *b]), (1, [*b, *a]), (2, [*b, *a]), (3, c), (4, ["own", *b, *a, *c]), (5, [*c, *a, *b, "x"])]
    rows = [(i, "\n".join(x)) for i, x in rows]
    got = removed(spark, rows, every=True)
    assert [got[i].n_removed for i in range(6)] == [0, 3, 6, 0, 9, 9]
    assert [got[i].n_moved for i in range(6)] == [0, 3, 0, 0, 0, 0]
    assert removed(spark, rows, every=True, moved=True)[1].n_removed == 6


def test_a_later_place_in_a_holder_counts(spark):
    block, mark = [f"repeated line number {k} of five" for k in range(5)], "a line that marks the middle"
    rows = [(1, "\n".join([*block, mark, *block])), (2, "\n".join(["two", mark, *block]))]
    assert (removed(spark, rows, every=True)[2].n_removed, removed(spark, rows, every=True)[2].kept) == (6, "two")


def test_many_holders_in_another_order_come_before_the_one_that_fits(spark):
    a, b = "the first of two common lines", "the second of two common lines"
    rows = [(0, f"{a}\nzero\n{b}")] + [(i, f"{b}\nlinks number {i // 2} with a neighbour\n{a}") for i in range(1, 200)] + [(200, f"{a}\nlast\n{b}")]
    got = removed(spark, rows, every=True)
    gone, moved = brute_every_pair([(i, t.encode()) for i, t in rows], 5)
    assert got[200].kept == "last" and {i: (r.n_removed, r.n_moved) for i, r in got.items()} == {i: (len(gone[i]), len(moved[i])) for i in gone}


def test_without_an_alignment_no_copy_goes_either(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "pair_blocks", lambda shared: [])
    block = "\n".join(f"line number {k} of a shared block" for k in range(4))
    got = removed(spark, [(1, block), (2, block), (3, "three\n" + block)], every=True)
    assert [(got[i].n_removed, got[i].n_moved) for i in (2, 3)] == [(0, 0), (0, 0)]


def test_every_earlier_document_on_long_texts_nulls_and_equal_ids(spark):
    text = "one line of five words\nanother line of five words\n\n"
    rows = [(None, text), (2, None), (3, ""), (4, text), (5, text), (5, text), (5, "z " + text)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(line_dedup.line_dedup(d, every=True).select("doc_id", "n_lines", "n_removed").collect(), key=lambda r: (r[0] or 0, r[2]))
    assert [r[1:] for r in got] == [(2, 0), (0, 0), (0, 0), (2, 2), (2, 1), (2, 2), (2, 2)]
    assert line_dedup.line_dedup(d.limit(0), every=True).count() == 0
    lines = [f"line {k} of a text with very many lines" for k in range(60_000)]
    got = removed(spark, [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[30_000:], *lines[:25_000]])), (3, "\n".join(["again and again and again"] * 3000)), (4, "\n".join(["again and again and again"] * 2000 + ["end"]))], every=True)
    assert [(got[i].n_removed, got[i].n_moved) for i in (2, 3, 4)] == [(30_000, 25_000), (0, 0), (2000, 0)]


def test_the_query_aligns_with_every_earlier_document(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    block = [f"{k} is a line of a block" for k in "pqrstu"]
    straight, turned = "\n".join(block).encode(), "\n".join([*block[3:], *block[:3]]).encode()
    rows += [(10**6 + k, t) for k, t in enumerate([straight, turned, turned])]
    gone, _ = brute_every_pair(rows, 5)
    assert len(gone[10**6 + 2]) == 6 and len(brute_aligned(rows, 5)[0][10**6 + 2]) == 3
    sf = str(tmp_path)
    spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id bigint, text string").write.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op10_line_dedup(spark, sf).collect()}
    assert got == {i: len(x) for i, x in gone.items()}
