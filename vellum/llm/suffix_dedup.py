"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a
document with a smaller doc_id, or earlier in the same one. Strings never cross
documents, overlaps count, and strings are judged on the input.

Parsing. A rolling hash of `context` bytes is taken at every position. A string's
trigger is the leftmost position of its smallest hash. Triggers depend on
nothing but content, every string has one, and equal strings have it at equal
offsets. Strings in a row with one trigger make a phrase: the bytes from its first
string's start to its last one's end. Phrases overlap by length - 1 bytes, so that every
string lies whole within one. A corpus of n bytes has about 2n / 70 phrases.

Parse. Spark sorts the occurrences of phrases by trigger, phrase and place in the corpus. That is
the suffix array of the parse to the depth of one phrase, which is as deep as a string
reaches. A phrase's first occurrence is the dictionary's entry; each later one is covered whole,
which settles the inside of long repeats: highly repetitive text costs one row a phrase
and not one a byte. Entries whose trigger no other entry has can't share a string with
any, and need no order.

Dictionary. Entries with a common trigger come together with their bytes, and the
suffixes of a block of such groups are put in order by prefix doubling (ranks of 8 bytes, of 16,
and so on, cut off at `length`). Equal neighbours in that suffix array are equal strings. An
entry knows its first occurrence, so an entry's place in the parse and a suffix's place in
the entry give the order in the corpus: of equal suffixes all but the first are covered.

A trigger that more than `GROUP` entries have (a short passage amid ever other text) is
too much for a task. Its entries are parsed again with long triggers, which
make phrases of a few strings, and what is too much even then goes string by string.

Edge cases: null and empty texts, and texts shorter than `length`, lose nothing; a
null doc_id comes before all others; equal rows are one document and get equal
answers; rows that repeat a doc_id with other texts count as documents in the order of
a hash of their texts; an empty table gives an empty result; other columns are
ignored. Text that is cut inside a UTF-8 sequence stays bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SLICE, staged, texts, utf8
from vellum.llm.repeats import (
    ANCHOR, BIG, COVERED, EDGE, combine, first_occurrences, merged, merged_spans, real_id, rows_batch, sha256_hex, span_arrays, spans_per_doc, unique_rows, window_rows,
)

_ENTRY = "g bigint, phrase binary, doc bigint, lo int"
#: Bytes of entries that are put in order at once.
ORDERED = 1 << 20

#: Positions hashed at once: keeps the arrays in cache, and long texts within bounds.
STEP = 1 << 18

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def rolling(data: np.ndarray, context: int) -> np.ndarray:
    """A 64-bit hash of the `context` (a multiple of 8) bytes from each position on."""
    n = len(data) - context + 1
    h = np.zeros(n, np.uint64)
    for i in range(0, context, 8):
        word = np.ndarray((n,), "<u8", data, i, (1,))
        h = (h ^ (word * _MULTIPLIERS[(i // 8) % 4])) * _MULTIPLIERS[(i // 8 + 1) % 4]
        h ^= h >> np.uint64(29)
    return h


def triggers(data: np.ndarray, length: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of `length` bytes its trigger's position, and the rolling hashes."""
    h = rolling(data, context)
    width = length - context + 1
    # High half: the hash; low half: the position, so that the least of equal hashes is the leftmost.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def phrases_of(data: np.ndarray, at: np.ndarray, length: int, context: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of segments, step by step: trigger hash, first and end byte, number of the segment; at bounds the segments in data."""
    for p in range(0, len(data) - length + 1, STEP):
        part = data[p : p + STEP + length - 1]
        trigger, h = triggers(part, length, context)
        # Strings that cross a segment's end are none.
        ends = at[np.searchsorted(at, p, "right") : np.searchsorted(at, p + len(part), "left")] - p
        cross = (ends[:, None] - np.arange(1, length)).ravel()
        trigger[cross[(cross >= 0) & (cross < len(trigger))]] = -1
        cut = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        first, last = cut, np.r_[cut[1:], len(trigger)]
        real = trigger[first] >= 0
        first, last = first[real], last[real]
        if len(first):
            lo = first + p
            yield h[trigger[first]].view(np.int64), lo, last + p + length - 1, np.searchsorted(at, lo, "right") - 1


def phrase_rows(whole: bytes, at: np.ndarray, doc: np.ndarray, base: np.ndarray, length: int, context: int) -> Iterator[pa.RecordBatch]:
    """ANCHOR rows of the phrases of segments: at bounds them in whole, base is each one's place in its document."""
    digest = xxhash.xxh3_64_intdigest
    for g, lo, hi, own in phrases_of(np.frombuffer(whole, np.uint8), at, length, context):
        k = np.array([digest(whole[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
        move = base[own] - at[own]
        yield rows_batch(combine(g, k, doc[own], (lo + move).astype(np.int32), (hi + move).astype(np.int32), across=False))


def entry_rows(whole: bytes, at: np.ndarray, doc: np.ndarray, base: np.ndarray, length: int, context: int) -> Iterator[pa.RecordBatch]:
    """The same phrases as entries of the dictionary: with their bytes."""
    for g, lo, hi, own in phrases_of(np.frombuffer(whole, np.uint8), at, length, context):
        phrase = pa.array([whole[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(g), phrase, pa.array(doc[own]), pa.array((lo + base[own] - at[own]).astype(np.int32))], names=["g", "phrase", "doc", "lo"])


def _phrases(length: int, context: int):
    """Phrases of whole texts: rows (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, SLICE) for lo in range(0, len(batch), SLICE)):
                data, at = utf8(part.column("text"))
                yield from phrase_rows(data.tobytes(), at, part.column("doc").to_numpy(zero_copy_only=False), np.zeros(len(at), np.int64), length, context)

    return run


def _in_spans(make: Callable, length: int, context: int):
    """Phrases of spans of texts, rows (doc, text, spans), by phrase_rows or entry_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, base, docs = [], [], []
            for d, text, spans in zip(batch.column("doc").to_pylist(), texts(batch), span_arrays(batch.column("spans")), strict=True):
                if spans is None:
                    continue
                # Strings of a span: those that start in it and end in it. Spans are merged by their strings.
                lo, hi = merged(spans[0], spans[1] - length + 1)
                parts += [text[a : b + length - 1] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                base += lo.tolist()
                docs += [d] * len(lo)
            if parts:
                at = np.r_[0, np.cumsum([len(x) for x in parts])]
                yield from make(b"".join(parts), at, np.array(docs, np.int64), np.array(base, np.int64), length, context)

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """A number for each position: the rank, among all, of the `length` bytes from there on. Prefix doubling."""
    n = len(data) - 7
    words = np.ndarray((n,), ">u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)
    rank, size = np.unique(words, return_inverse=True)[1], 8

    def both(step: int) -> np.ndarray:
        return rank[: len(rank) - step] * np.int64(n) + rank[step:]

    while 2 * size <= length:
        rank = np.unique(both(size), return_inverse=True)[1]
        size *= 2
    return both(length - size) if length > size else rank


def repeats_in(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, lo, hi) of the strings of a block of entries that aren't the first of their kind in the corpus.

    data: the entries' bytes, one after the other; doc, lo: their first occurrences.
    """
    strings = sizes - length + 1
    entry = np.repeat(np.arange(len(sizes)), strings)
    off = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
    rank = suffix_ranks(data, length)[(np.cumsum(sizes) - sizes)[entry] + off]
    own, place = doc[entry], lo[entry] + off
    order = np.lexsort((place, own, rank))
    again = order[1:][rank[order][1:] == rank[order][:-1]]
    return merged_spans(own[again], place[again].astype(np.int32), (place[again] + length).astype(np.int32))


def _ordered(length: int):
    """Entries sorted by g -> the spans of their repeated strings; blocks hold whole groups."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        phrase = t["phrase"].combine_chunks()
        data, at = utf8(phrase)
        spans = repeats_in(data, np.diff(at), t["doc"].to_numpy(), t["lo"].to_numpy(), length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while len(batch):
                g = batch.column("g").to_numpy()
                if size >= ORDERED:  # full: what is left of its last group, if any
                    end = int(np.searchsorted(g, held[-1].column("g")[-1].as_py(), side="right"))
                else:  # up to the end of the group that fills the block
                    bytes_to = size + np.cumsum(pc.binary_length(batch.column("phrase")).to_numpy())
                    full = min(int(np.searchsorted(bytes_to, ORDERED)), len(g) - 1)
                    end = int(np.searchsorted(g, g[full], side="right"))
                    size = int(bytes_to[end - 1])
                if end:
                    held.append(batch.slice(0, end))
                batch = batch.slice(end)
                if len(batch) and size >= ORDERED:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


def repeated_strings(rows: DataFrame, length: int, context: int) -> DataFrame:
    """Spans (doc, lo, hi) of rows (doc, text) that repeat earlier strings; a doc's may overlap."""
    finer = (length - 10) // 8 * 8
    covered, entries = [], []
    makers = [(context, _phrases(length, context))]
    if finer > context:
        makers.append((finer, _in_spans(phrase_rows, length, finer)))
    source = rows
    for own, maker in makers:
        judged = staged(first_occurrences(source.mapInArrow(maker, ANCHOR), across=False), "judged_phrases")
        covered.append(judged.where(F.col("state") == COVERED).select("doc", "lo", "hi"))
        edges = rows.join(spans_per_doc(judged.where(F.col("state") == EDGE)).hint("shuffle_hash"), "doc")
        entries.append(edges.mapInArrow(_in_spans(entry_rows, length, own), _ENTRY))
        big = judged.where(F.col("state") == BIG)
        if big.isEmpty():
            break
        source = rows.join(spans_per_doc(big).hint("shuffle_hash"), "doc")
    else:
        strings = first_occurrences(source.mapInArrow(window_rows(bytes_of, length, False), ANCHOR), across=False)
        covered.append(strings.where(F.col("state") == COVERED).select("doc", "lo", "hi"))
    for own in entries:
        covered.append(own.repartition("g").sortWithinPartitions("g").mapInArrow(_ordered(length), "doc bigint, lo int, hi int"))
    out = covered[0]
    for more in covered[1:]:
        out = out.unionAll(more)
    return out


def bytes_of(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    at = np.arange(len(text) + 1)
    return text, at[:-1], at[1:]


_KEPT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _remove(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, spans in zip(texts(batch), span_arrays(batch.column("spans")), strict=True):
                rest, runs = text, 0
                if spans is not None:
                    lo, hi = merged(*spans)
                    runs = len(lo)
                    rest = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(rest))
                n_spans.append(runs)
                sha.append(sha256_hex(rest))
                kept.append(rest if with_bytes else None)
            longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *longs, pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, context: int = 32, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) per document."""
    if context % 8 or not 8 <= context <= length:
        raise ValueError("context must be a multiple of 8, and no longer than length")
    rows, with_spans, _ = unique_rows(docs)
    out = with_spans(spans_per_doc(repeated_strings(rows, length, context))).mapInArrow(_remove(with_bytes), _KEPT)
    return out.select(real_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
