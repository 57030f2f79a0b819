"""Line deduplication by pairwise alignment.

1. *Lines.* A text's lines that hold a word are hashed (128 bits, ends stripped) and numbered.
2. *Overlapping documents.* A seed is a line of `least_words` words, or one of the shortest
   runs of neighbouring lines, from or up to a shorter line, that have as many. A seed
   leads every document that has it to one partner: the earliest document with that seed.
   Every block of lines to delete is made of such seeds, so all overlaps are found. A
   seed in a third of all documents costs one row in each, as rare and common seeds have one
   partner alike: no frequency needs to be cut off, and no pairs within a group are made.
3. *Alignment.* The seeds that lead a document to one partner are its matches with that
   partner: where the seed stands in the one and in the other. Patience diff aligns
   them: the longest rising run of seeds that both have once, then the same among
   the others between those.
   `every=True` (the query op10 and the pipeline) has no such single partner: a document is
   aligned with every earlier document that has one of its seeds, see `aligned_with_any`.
4. *Deletion.* Aligned blocks are deleted from the later document, together with the
   blank lines that follow their lines. Matches out of order are blocks that were moved; they
   stay, and n_moved counts their lines. (`moved=True` deletes them, too: then a line goes if and only
   if it lies in a run of neighbouring lines with `least_words` words that an earlier document has.)

Pairs need no cut-off by frequency: a line's earliest holder bounds the pairs of a common line as
rarity bounds those of a rare one. Of several longest alignments, that of the latest matches counts. A document's
matches travel once, to its own row; a document has a few rows a line, whatever it shares with others.

Edge cases: null and empty texts have no lines and stay as they are (null counts as
empty); a document may lose all lines, and stays with an empty text; a null doc_id comes
before all others; equal rows are one document and get equal answers; rows that repeat a
doc_id with other texts count in the order of a hash of their texts; an empty table
gives an empty result; other columns are ignored, or carried if asked for.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import schema_with, staged, texts
from vellum.llm.repeats import merged, numbered, real_id, sha256_hex, span_arrays, spans_per_doc, unique_rows

#: A seed of a document: its hash, its number of lines, and the places of its first lines.
_SEED = "h1 bigint, h2 bigint, doc bigint, n int, at array<int>"
#: With every earlier document: each round looks at so many times as many further holders of a seed.
WIDER = 8


def filled_lines(text: bytes) -> list[bytes]:
    """The lines with a word, stripped at both ends."""
    return [s for s in (line.strip() for line in text.split(b"\n")) if s]


def seed_runs(lines: list[bytes], least_words: int) -> list[tuple[int, int]]:
    """(lo, hi) of every line of least_words words, and of the shortest runs from and up to each shorter line."""
    words = [len(x.split()) for x in lines]
    out = []
    for i, own in enumerate(words):
        if own >= least_words:
            out.append((i, i + 1))
            continue
        for step in (1, -1):
            j, total = i, own
            while total < least_words and 0 <= j + step < len(lines):
                j += step
                total += words[j]
            if total >= least_words:
                out.append((min(i, j), max(i, j) + 1))
    return out


def _seeds(least_words: int):
    def pack(out: dict[tuple[bytes, int, int], list[int]]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(x[0] for x in out), np.int64).reshape(-1, 2)
        arrays = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array(list(out.values()), pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "doc", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: dict[tuple[bytes, int, int], list[int]] = {}
            for doc, text in zip(batch.column("doc").to_pylist(), texts(batch), strict=True):
                lines = filled_lines(text)
                hashes = [digest(x) for x in lines]
                for lo, hi in sorted(set(seed_runs(lines, least_words))):
                    h = hashes[lo] if hi == lo + 1 else digest(b"".join(hashes[lo:hi]))
                    out.setdefault((h, doc, hi - lo), []).append(lo)
                if len(out) > 200_000:
                    yield pack(out)
                    out = {}
            yield pack(out)

    return run


def longest_rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(matches: list[tuple[int, int, bool]]) -> list[int]:
    """Numbers of the matches (place in one text, place in the other, once in both) that patience
    diff aligns, rising in both places. matches: sorted by the first place, and down the other."""
    sure = [i for i, m in enumerate(matches) if m[2]]
    anchors = [sure[i] for i in longest_rising([matches[i][1] for i in sure])]
    # Between the anchors: the longest rising runs of the matches that fit there.
    starts, ends = [matches[i][0] for i in anchors], [matches[i][1] for i in anchors]
    gaps: dict[int, list[int]] = {}
    for i, (a, b, once) in enumerate(matches):
        gap = bisect_left(starts, a)
        if not once and bisect_left(ends, b) == gap and (gap == len(anchors) or (starts[gap] != a and ends[gap] != b)):
            gaps.setdefault(gap, []).append(i)
    more = [own[i] for own in gaps.values() for i in longest_rising([matches[x][1] for x in own])]
    return sorted(anchors + more)


def rising_pairs(rows: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """A longest run of pairs (place, one of its partners) that rises in both. rows: by place, partners ascending.
    Of several, that whose last partner, then place, is smallest; and so on towards the start. What is
    held are the steps that improve a pile, not all pairs of a line repeated in both texts."""
    tops: list[int] = []
    at: list[int] = []
    steps: list[tuple[int, int, int]] = []
    for a, partners in rows:
        better, i = [], 0
        while i < len(partners):
            pile = bisect_left(tops, partners[i])
            if pile == len(tops):
                better.append((pile, partners[i]))
                break
            if partners[i] < tops[pile]:
                better.append((pile, partners[i]))
            i = bisect_right(partners, tops[pile], i)
        for pile, b in reversed(better):
            steps.append((a, b, at[pile - 1] if pile else -1))
            if pile == len(tops):
                tops.append(b)
                at.append(len(steps) - 1)
            else:
                tops[pile], at[pile] = b, len(steps) - 1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(steps[i][:2])
        i = steps[i][2]
    return out[::-1]


def pair_blocks(shared: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int]]:
    """(lo, hi) in one text of what patience diff aligns with another. shared: every seed that both
    have, as its number of lines and all its places in the one and in the other, each rising."""
    once: dict[tuple[int, int], int] = {}
    for n, own, other in shared:
        if len(own) == len(other) == 1:
            once[own[0], other[0]] = max(n, once.get((own[0], other[0]), 0))
    sure = sorted(once, key=lambda m: (m[0], -m[1]))
    anchors = [sure[i] for i in longest_rising([b for _, b in sure])]
    starts, ends = [a for a, _ in anchors], [b for _, b in anchors]
    out = [(a, a + once[a, b]) for a, b in anchors]
    # Between the anchors: the longest rising runs of the repeated seeds there, at any of their places.
    gaps: dict[int, dict[int, list[tuple[int, list[int]]]]] = {}
    for n, own, other in shared:
        if len(own) == len(other) == 1:
            continue
        fits: dict[int, list[int]] = {}
        for b in other:
            gap = bisect_left(ends, b)
            if gap == len(ends) or ends[gap] != b:
                fits.setdefault(gap, []).append(b)
        for a in own:
            gap = bisect_left(starts, a)
            if gap in fits and (gap == len(starts) or starts[gap] != a):
                gaps.setdefault(gap, {}).setdefault(a, []).append((n, fits[gap]))
    for places in gaps.values():
        rows = [(a, own[0][1] if len(own) == 1 else sorted({b for _, bs in own for b in bs})) for a, own in sorted(places.items())]
        for a, b in rising_pairs(rows):
            own = places[a]
            out.append((a, a + (own[0][0] if len(own) == 1 else max(n for n, bs in own if b in bs))))
    return out


def _align(moved: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_moved = [], []
            for own in batch.column("matches"):
                by_first: dict[int, list[tuple[int, int, bool, int]]] = {}
                for m in own.as_py():
                    for lo in m["at"]:
                        by_first.setdefault(m["first"], []).append((lo, m["first_at"] >> 1, len(m["at"]) == 1 and bool(m["first_at"] & 1), m["n"]))
                kept, left = [], []
                for matches in by_first.values():
                    matches.sort(key=lambda m: (m[0], -m[1]))
                    aligned = set(patience([m[:3] for m in matches]))
                    for i, m in enumerate(matches):
                        (kept if i in aligned else left).append((m[0], m[0] + m[3]))
                gone = {p for lo, hi in kept for p in range(lo, hi)}
                out_of_order = {p for lo, hi in left for p in range(lo, hi)} - gone
                spans.append([{"lo": lo, "hi": hi} for lo, hi in (kept + left if moved else kept)])
                n_moved.append(len(out_of_order))
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind), pa.array(n_moved, pa.int64())], names=["doc", "spans", "n_moved"])

    return run


def deleted_blocks(rows: DataFrame, least_words: int = 5, moved: bool = False) -> DataFrame:
    """rows (doc, text) -> (doc, spans, n_moved): runs (lo, hi) of filled lines to delete."""
    seeds = staged(rows.mapInArrow(_seeds(least_words), _SEED), "seeds")
    # Spark keeps the least per task before the shuffle: a hot seed is one row a task.
    # The result is a table, so that both sides of the join are dealt out for it and Spark can
    # split a hot seed's rows. first_at: place, and whether the first document has it once.
    place = F.shiftleft(F.array_min("at"), 1) + (F.size("at") == 1).cast("int")
    held = seeds.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by(place, "doc").alias("first_at")).where("first < last").drop("last")
    held = staged(held, "held_seeds")
    matches = seeds.join(held, ["h1", "h2"]).where("first < doc").select("doc", F.struct("first", "first_at", "n", "at").alias("m"))
    return matches.groupBy("doc").agg(F.collect_list("m").alias("matches")).mapInArrow(_align(moved), "doc bigint, spans array<struct<lo: int, hi: int>>, n_moved bigint")


def _spans_batch(doc: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """Rows (doc, lo, hi), spans of a document that touch as one."""
    both = [merged(*np.array(sorted(x), np.int64).reshape(-1, 2).T) if x else None for x in spans]
    numbers = np.array([0 if x is None else len(x[0]) for x in both], np.int64)
    docs = np.repeat(doc.to_numpy(zero_copy_only=False), numbers)
    lo, hi = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in both if x is not None]]).astype(np.int32) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lo), pa.array(hi)], names=["doc", "lo", "hi"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of the order in which a document's shared seeds stand, and the seeds."""
    for batch in batches:
        digests = []
        for own in batch.column("seeds"):
            flat = np.array(sorted((p, m["h1"], m["h2"]) for m in own.as_py() for p in m["at"]), np.int64)
            flat[:, 0] = np.cumsum(np.r_[0, flat[1:, 0] != flat[:-1, 0]])
            digests.append(xxhash.xxh3_128_digest(flat.tobytes()))
        c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), batch.column("seeds")], names=["doc", "c1", "c2", "seeds"])


def _align_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place with the same place of the class's first document: no longer run than all of them exists."""
    for batch in batches:
        spans = [pair_blocks([(m["n"], [p], [p]) for m in own.as_py() for p in m["at"]]) for own in batch.column("seeds")]
        yield _spans_batch(batch.column("doc"), spans)


def _align_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [pair_blocks([(m["n"], m["own"], m["others"]) for m in shared.as_py()]) for shared in batch.column("shared")]
        yield _spans_batch(batch.column("doc"), spans)


def _still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the seeds with a line outside the document's spans."""
    for batch in batches:
        left = []
        for own, spans in zip(batch.column("open"), span_arrays(batch.column("spans")), strict=True):
            lo, hi = (x.tolist() for x in merged(*spans)) if spans is not None else ([], [])
            for m in own.as_py():
                within = [bisect_right(lo, p) - 1 for p in m["at"]]
                if any(i < 0 or hi[i] < p + m["n"] for i, p in zip(within, m["at"], strict=True)):
                    left.append(m["number"])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64())], names=["number"])


def _with_moved(moved: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_moved = [], []
            for kept, matched in zip(batch.column("spans"), batch.column("matched"), strict=True):
                kept, matched = kept.as_py() or [], matched.as_py() or []
                gone = {p for x in kept for p in range(x["lo"], x["hi"])}
                n_moved.append(len({p for x in matched for p in range(x["lo"], x["hi"])} - gone))
                spans.append(kept + matched if moved else kept)
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind), pa.array(n_moved, pa.int64())], names=["doc", "spans", "n_moved"])

    return run


def aligned_with_any(rows: DataFrame, least_words: int = 5, moved: bool = False) -> DataFrame:
    """rows (doc, text) -> (doc, spans, n_moved): runs (lo, hi) of filled lines that patience diff aligns
    with any earlier document that has a seed of them, by all seeds and places that the two share.

    * An alignment depends on nothing but the order in which the two documents' shared seeds stand. Documents with the same
      order are a class: all but the first are aligned with the first, and one pair of classes stands for all.
    * Holders of a seed are numbered in order, so that those before a document have the numbers before its own. A
      round takes the next ones of each seed that isn't wholly aligned: 1, then 8, 64 and so on, until every
      seed is aligned or has been tried with all its holders. No partner is left out; what goes needs no further
      one. A line that every earlier holder has in another order is tried with all of them.
    * A pair's shared seeds are found from the document with fewer seeds.
    """
    seeds = staged(rows.mapInArrow(_seeds(least_words), _SEED), "seeds")
    held = staged(seeds.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2"), "held_seeds")
    own = seeds.join(held, ["h1", "h2"]).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2", "n", "at")).alias("seeds"))
    kind = "seeds array<struct<h1: bigint, h2: bigint, n: int, at: array<int>>>"
    own = staged(own.mapInArrow(_classes, f"doc bigint, c1 bigint, c2 bigint, {kind}"), "own_seeds")
    firsts = staged(own.groupBy("c1", "c2").agg(F.min("doc").alias("doc")).select("doc"), "first_documents")
    span = "doc bigint, lo int, hi int"
    found = own.join(firsts, "doc", "left_anti").mapInArrow(_align_copies, span)

    each = own.join(firsts, "doc", "left_semi").select("doc", F.size("seeds").alias("size"), F.explode("seeds").alias("m")).select("doc", "size", "m.*")
    number = numbered(each.select("h1", "h2", "doc"), ["h1", "h2", "doc"])
    holders = staged(each.join(number, ["h1", "h2", "doc"]), "holders")
    places = holders.select("doc", "h1", "h2", "n", "at")
    others = holders.select(F.col("number").alias("before"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("doc").alias("other"), F.col("size").alias("other_size"))
    still, tried, wide, matched = holders, 0, 1, None
    while True:
        tries = still.withColumn("k", F.explode(F.sequence(F.lit(tried + 1), F.lit(tried + wide)))).withColumn("before", F.col("number") - F.col("k"))
        tries = tries.join(others, "before").where("h1 = g1 AND h2 = g2").select("number", "k", "doc", "size", "other", "other_size", "n", "at")
        tries = staged(tries, "tries")
        if tries.isEmpty():
            break
        tried, wide = tried + wide, wide * WIDER
        if matched is None:
            matched = tries.select("doc", "n", F.explode("at").alias("lo")).select("doc", "lo", (F.col("lo") + F.col("n")).alias("hi"))
        pairs = tries.select("doc", "other", (F.col("size") <= F.col("other_size")).alias("by_own")).distinct()
        pairs = pairs.withColumn("less", F.when(F.col("by_own"), F.col("doc")).otherwise(F.col("other"))).withColumn("more", F.when(F.col("by_own"), F.col("other")).otherwise(F.col("doc")))
        shared = pairs.join(places.withColumnRenamed("doc", "less"), "less").join(places.select(F.col("doc").alias("more"), "h1", "h2", F.col("at").alias("at_more")), ["more", "h1", "h2"])
        side = lambda own: F.when(F.col("by_own") == F.lit(own), F.col("at")).otherwise(F.col("at_more"))
        shared = shared.groupBy("doc", "other").agg(F.collect_list(F.struct("n", side(True).alias("own"), side(False).alias("others"))).alias("shared"))
        found = found.unionAll(staged(shared.mapInArrow(_align_pairs, span), "aligned"))
        # A seed goes on if its furthest holder in this round was not its first one.
        last = tries.where(F.col("k") == tried).groupBy("doc").agg(F.collect_list(F.struct("number", "n", "at")).alias("open"))
        left = last.join(spans_per_doc(found), "doc", "left").mapInArrow(_still_open, "number bigint")
        still = staged(holders.join(staged(left, "open_seeds"), "number", "left_semi"), "open_holders")
    spans = spans_per_doc(found)
    spans = spans.join(spans_per_doc(matched).withColumnRenamed("spans", "matched"), "doc", "full") if matched is not None else spans.withColumn("matched", F.lit(None).cast("array<struct<lo: int, hi: int>>"))
    return spans.mapInArrow(_with_moved(moved), "doc bigint, spans array<struct<lo: int, hi: int>>, n_moved bigint")


def without_blocks(text: bytes, lo: list[int], hi: list[int]) -> bytes:
    """The text without these runs of filled lines and the blank lines after their lines."""
    gone = {p for a, b in zip(lo, hi, strict=True) for p in range(a, b)}
    kept, filled, dropping = [], -1, False
    for line in text.split(b"\n"):
        if line.strip():
            filled += 1
            dropping = filled in gone
        if not dropping:
            kept.append(line)
    return b"\n".join(kept)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, spans in zip(texts(batch), span_arrays(batch.column("spans")), strict=True):
            n_lines.append(len(filled_lines(text)))
            lo, hi = (x.tolist() for x in merged(*spans)) if spans is not None else ([], [])
            n_removed.append(sum(hi) - sum(lo))
            kept.append(without_blocks(text, lo, hi) if lo else text)
        sha = pa.array([sha256_hex(k) for k in kept])
        moved = batch.column("n_moved").fill_null(0)
        arrays = [batch.column("id"), batch.column("carried"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), moved, sha, pa.array([k.decode() for k in kept])]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "carried", "n_lines", "n_removed", "n_moved", "kept_sha256", "kept"])


def line_dedup(docs: DataFrame, least_words: int = 5, carry: Sequence[str] = (), moved: bool = False, every: bool = False) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, n_moved (matched out of order: they stay, or with `moved`
    are among those removed), kept_sha256, kept (text) per document, and carried: a struct of the columns to carry, if any.
    every: documents are aligned with every earlier one that has a seed of theirs, not only with its earliest holder."""
    rows, with_spans, _ = unique_rows(docs, carry)
    joined = with_spans((aligned_with_any if every else deleted_blocks)(rows, least_words, moved))
    out = joined.mapInArrow(_delete, schema_with(joined.schema["carried"], "id bigint", "n_lines bigint, n_removed bigint, n_moved bigint, kept_sha256 string, kept string"))
    return out.select(real_id("id").alias("doc_id"), "n_lines", "n_removed", "n_moved", "kept_sha256", "kept", *["carried"] * bool(carry))
