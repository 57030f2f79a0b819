"""What the two repeated-passage operators share: the first-occurrence scan, and removal.

Both operators describe documents by *anchors*: places that repeated passages of the
least length must share. An anchor row has the group key g (a hash of the anchor's
own content), the key k (a hash of its whole surroundings), its document, and
the span lo..hi that these surroundings cover.

First-occurrence scan, over rows sorted by (g, k, doc, lo):

* Rows with equal g and k have equal surroundings: whatever window lies in the
  later ones also lies in the first. They are *covered* whole.
* First rows whose g turns up with a second k share an anchor but not the
  surroundings: some of their windows may be equal. These *edges* of repeated
  passages are few; what lies in them is compared by itself. Edges of a g with over
  `GROUP` k are told apart as *big*, since a task shouldn't hold them all.
* A g with one k has nothing else to compare.

No row is compared with another pair by pair, so a passage in a third of all
documents costs as much as its rows. Before the shuffle each task covers what it
can by itself: of rows with equal keys in a batch only the first goes on, so a hot
key reaches the shuffle once a batch. A hot g with ever other k (a short passage amid
different ones) is known for one in a batch: its rows are dealt out by (g, k), and a
note goes to g in their place. Rows with an equal key that miss each other so are edges, and
meet window by window. The scan keeps one group's first rows.

Keys are 128 bits in all: g and k for anchors, two halves for windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import staged, texts

ANCHOR = "g bigint, k bigint, doc bigint, lo int, hi int, state int"
SPAN = "doc bigint, lo int, hi int, state int"

#: States of a row: still to be judged; covered; an edge that needs a look; to be judged, and a big
#: edge unless covered; no row, but a note that its g has very many k; an edge of a g with many k.
OPEN, COVERED, EDGE, SURE, NOTE, BIG = 0, 1, 2, 3, 4, 5
#: A g with more k than this has big edges.
GROUP = 4096
#: So many k of one g in a batch are dealt out by (g, k) from there.
SPREAD = 8
_TYPES = {"g": np.int64, "k": np.int64, "doc": np.int64, "lo": np.int32, "hi": np.int32, "state": np.int32}


#: Where ids repeat, a row's number has the rank of its id above so many bits; null ids are negative.
SHARED = 27


def ranks(doc: np.ndarray, shared: bool) -> np.ndarray:
    """What orders documents: the id, or, where ids repeat, its rank, which all rows of one id have."""
    return np.where(doc < 0, -1, doc >> SHARED) if shared else doc


def rows_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def combine(g: np.ndarray, k: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, across: bool, shared: bool = False) -> dict[str, np.ndarray]:
    """Within one batch: cover the later rows of equal keys, leave the rest open.

    across: only rows of a larger doc are covered; else later rows of one doc are, too. shared: docs are
    numbers of rows whose ids repeat, and rows of one id cover none of one another.
    Covered spans of a document that overlap or touch leave as one row; its g is the
    document, so that such rows spread in the shuffle. Rows of a g with many k are
    edges unless covered: they spread by (g, k), and one note tells the rows of that g elsewhere.
    """
    order = np.lexsort((lo, doc, k, g))
    new = np.ones(len(g), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (k[order][1:] != k[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = np.zeros(len(g), bool)
    rank = ranks(doc[order], shared)
    later[order] = rank > rank[first] if across else ~new
    spans = merged_spans(doc[later], lo[later], hi[later])
    new_g = np.ones(len(g), bool)
    new_g[1:] = g[order][1:] != g[order][:-1]
    number = np.cumsum(new_g) - 1
    kinds = np.bincount(number, new)
    sure = np.zeros(len(g), bool)
    sure[order] = kinds[number] >= SPREAD if len(g) else False
    notes = g[order][new_g][kinds >= SPREAD]
    spread = np.where(sure, (g * np.int64(0x2545F4914F6CDD1D)) ^ (k * np.int64(0x369DEA0F31A53F85)), g)
    keep = ~later
    zero = np.zeros(len(spans[0]), np.int64)
    none = np.zeros(len(notes), np.int32)
    return {
        "g": np.r_[spread[keep], spans[0], notes],
        "k": np.r_[k[keep], zero, none],
        "doc": np.r_[doc[keep], spans[0], np.full(len(notes), 2**63 - 1)],
        "lo": np.r_[lo[keep], spans[1], none],
        "hi": np.r_[hi[keep], spans[2], none],
        "state": np.r_[np.where(sure[keep], SURE, OPEN), np.full(len(zero), COVERED), np.full(len(notes), NOTE)].astype(np.int32),
    }


def merged_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by (doc, lo), those of a doc that overlap or touch as one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # One axis for all docs, each beyond the reach of the one before.
    number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]).astype(np.int64)
    shift = number * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    cut = np.flatnonzero(lo[1:] + shift[1:] > reach[:-1]) + 1
    start, end = np.r_[0, cut], np.r_[cut - 1, len(doc) - 1]
    return doc[start], lo[start], (reach[end] - shift[end]).astype(hi.dtype)


def scan(across: bool, shared: bool = False, most: int = GROUP) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first-occurrence scan over rows sorted by (g, k, doc, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last group so far: its key, its current k and that k's first doc, the number of
        # its k, whether it is big, and its first rows, which wait for that number.
        g0 = k0 = d0 = None
        kinds0, big0 = 0, False
        wait: list[np.ndarray] = []
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _TYPES}
            done = col["state"] == COVERED
            if done.any():
                yield rows_batch({c: col[c][done] for c in ("doc", "lo", "hi", "state")})
                col = {c: v[~done] for c, v in col.items()}
            g, k, doc, state = col["g"], col["k"], col["doc"], col["state"]
            n = len(g)
            if not n:
                continue
            note = state == NOTE
            new_g = np.ones(n, bool)
            new_g[1:] = g[1:] != g[:-1]
            new_k = new_g.copy()
            new_k[1:] |= k[1:] != k[:-1]
            goes_on = g0 is not None and g[0] == g0
            same_k = goes_on and k[0] == k0
            new_g[0], new_k[0] = not goes_on, not same_k
            at = np.maximum.accumulate(np.where(new_k, np.arange(n), -1))
            lead = np.where(at >= 0, doc[np.maximum(at, 0)], d0 if same_k else 0)
            later = (ranks(doc, shared) > ranks(lead, shared) if across else ~new_k) & ~note
            # Number the groups of this batch; 0 is the one carried over, if it goes on.
            number = np.cumsum(new_g) - (0 if goes_on else 1)
            kinds = np.bincount(number, new_k & ~note, number[-1] + 1)
            big = np.bincount(number, note, number[-1] + 1) > 0
            if goes_on:
                kinds[0] += kinds0
                big[0] |= big0
            big |= kinds > most
            if wait and not goes_on:
                yield from _edges(wait, kinds0, EDGE)
                wait = []
            elif wait and (big[0] or number[-1] > 0):
                yield from _edges(wait, kinds[0], BIG if big[0] else EDGE)
                wait = []
            last = number == number[-1]
            in_big = big[number] | (state == SURE)
            emit = (later | in_big | (~last & (kinds[number] >= 2))) & ~note
            held = last & ~emit & ~note
            if held.any():
                wait.append(np.stack([doc[held], col["lo"][held], col["hi"][held]]))
            if emit.any():
                out = np.where(later, COVERED, np.where(in_big, BIG, EDGE)).astype(np.int32)
                yield rows_batch({"doc": doc[emit], "lo": col["lo"][emit], "hi": col["hi"][emit], "state": out[emit]})
            g0, k0, d0, kinds0, big0 = g[-1], k[-1], lead[-1], kinds[-1], bool(big[-1])
        if wait:
            yield from _edges(wait, kinds0, EDGE)

    return run


def _edges(wait: list[np.ndarray], kinds: int, state: int) -> Iterator[pa.RecordBatch]:
    """The waiting rows of a group, if it has several k."""
    if kinds >= 2:
        doc, lo, hi = np.concatenate(wait, axis=1)
        yield rows_batch({"doc": doc, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "state": np.full(len(doc), state, np.int32)})


def first_occurrences(rows: DataFrame, across: bool, shared: bool = False) -> DataFrame:
    """ANCHOR rows -> SPAN rows that are covered or edges."""
    return rows.repartition("g").sortWithinPartitions("g", "k", "doc", "lo").mapInArrow(scan(across, shared), SPAN)


def spans_per_doc(spans: DataFrame) -> DataFrame:
    """doc, spans: its (lo, hi), a bounded number of rows' worth a document."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def span_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Each row's (lo, hi) arrays, sorted by lo; None for null."""
    flat = column.flatten() if len(column) else None
    offsets = column.offsets.to_numpy() if len(column) else []
    offsets = offsets - offsets[0] if len(offsets) else offsets
    valid = column.is_valid().to_pylist()
    lo = flat.field("lo").to_numpy(zero_copy_only=False) if flat is not None else None
    hi = flat.field("hi").to_numpy(zero_copy_only=False) if flat is not None else None
    for i, ok in enumerate(valid):
        if not ok or offsets[i] == offsets[i + 1]:
            yield None
            continue
        a, b = lo[offsets[i] : offsets[i + 1]], hi[offsets[i] : offsets[i + 1]]
        order = np.argsort(a, kind="stable")
        yield a[order], b[order]


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted spans; spans that touch are one run."""
    reach = np.maximum.accumulate(hi)
    cut = np.flatnonzero(lo[1:] > reach[:-1]) + 1
    return lo[np.r_[0, cut]], reach[np.r_[cut - 1, len(lo) - 1]]


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows with their number in the order of these columns: a sort over ranges, then each
    range's start from the counts of those before it (a row per range)."""
    place = F.monotonically_increasing_id()  # 33 bits within the partition, the partition above them
    ranges = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", place), "ranges")
    ranges = ranges.select(*by, F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return staged(ranges.join(starts, "range").select(*by, (F.col("start") + F.col("place")).alias("number")), "numbers")


def shared_numbers(rows: DataFrame) -> DataFrame:
    """Distinct rows (doc, h) with a number in their order, from which `ranks` tells the id's rank."""
    unknown = F.col("doc") == -(2**63)
    without = numbered(rows.where(unknown), ["doc", "h"]).select("doc", "h", (F.col("number") - (1 << 62)).alias("number"))
    known = rows.where(~unknown)
    rank = numbered(known.select("doc").distinct(), ["doc"]).withColumnRenamed("number", "rank")
    place = (F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1).cast("long")
    fits = F.when(F.col("place") < (1 << SHARED), F.shiftleft("rank", SHARED) + F.col("place")).otherwise(F.raise_error(F.lit("too many texts of one id")).cast("bigint"))
    return known.withColumn("place", place).join(rank, "doc").select("doc", "h", fits.alias("number")).unionAll(without)


def unique_rows(docs: DataFrame, carry: Sequence[str] = (), text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Callable[[DataFrame], DataFrame], bool]:
    """Rows (doc, text) with a doc of their own, in the order of doc_id (null first), what joins
    columns per doc to every input row: (id, text, carried, row, columns), and whether ids repeat.

    Where no doc_id repeats, doc is doc_id, and row is null. Else equal rows become one, and rows are
    numbered in the order of doc_id and a hash of the text (`shared_numbers`); row is a number of the input row.
    carried is a struct of the columns to carry, or null.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    each = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"), F.col(text).cast("string").alias("text"), carried.alias("carried"))
    rows = each.select("doc", "text")
    if rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows, lambda spans: each.withColumn("row", F.lit(None).cast("bigint")).join(spans.hint("shuffle_hash"), "doc", "left").withColumnRenamed("doc", "id"), False
    keyed = staged(each.withColumns({"h": F.xxhash64(F.coalesce("text", F.lit(""))), "row": F.monotonically_increasing_id()}), "repeated_ids")
    number = shared_numbers(keyed.select("doc", "h").distinct())
    one = keyed.dropDuplicates(["doc", "h"]).join(number, ["doc", "h"]).select(F.col("number").alias("doc"), "text")

    def with_spans(spans: DataFrame) -> DataFrame:
        joined = keyed.join(number, ["doc", "h"]).select(F.col("doc").alias("id"), "text", "carried", "row", F.col("number").alias("doc"))
        return joined.join(spans.hint("shuffle_hash"), "doc", "left").drop("doc")

    return one, with_spans, True


def real_id(col: str) -> Column:
    return F.when(F.col(col) != -(2**63), F.col(col))


def window_rows(unit: Callable[[bytes], tuple[bytes, np.ndarray, np.ndarray]], length: int, across: bool, shared: bool = False) -> Callable:
    """Rows (doc, text, spans) -> ANCHOR rows, one for each window of `length` units in a span.

    unit gives a text's bytes and the first and last byte of each of its units. A window
    is known by a hash of 128 bits, whose halves are g and k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, doc, start = [], [], []
            for d, text, spans in zip(batch.column("doc").to_pylist(), texts(batch), span_arrays(batch.column("spans")), strict=True):
                if spans is None:
                    continue
                data, first, end = unit(text)
                lo, hi = merged(spans[0], spans[1] - length + 1)
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    s = first[a:b].tolist()
                    e = end[a + length - 1 : b + length - 1].tolist()
                    halves += [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(s, e, strict=True)]
                    start.append(np.arange(a, b, dtype=np.int32))
                    doc.append(np.full(b - a, d, np.int64))
                if len(halves) > 400_000:
                    yield _windows(halves, doc, start, length, across, shared)
                    halves, doc, start = [], [], []
            if halves:
                yield _windows(halves, doc, start, length, across, shared)

    return run


def _windows(halves: list[bytes], doc: list, start: list, length: int, across: bool, shared: bool) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
    lo = np.concatenate(start)
    return rows_batch(combine(both[:, 0].copy(), both[:, 1].copy(), np.concatenate(doc), lo, (lo + length).astype(np.int32), across, shared))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_spans(rows: DataFrame, anchors: DataFrame, unit: Callable, length: int, across: bool, shared: bool = False) -> DataFrame:
    """All covered spans (doc, lo, hi, of `length` units at least) of rows (doc, text), from their anchors."""
    judged = staged(first_occurrences(anchors, across, shared), "judged_anchors")
    edges = spans_per_doc(judged.where(F.col("state") != COVERED))
    windows = first_occurrences(rows.join(edges.hint("shuffle_hash"), "doc").mapInArrow(window_rows(unit, length, across, shared), ANCHOR), across, shared)
    return judged.unionAll(windows).where(F.col("state") == COVERED).select("doc", "lo", "hi")
