"""Substring deduplication of word windows by difference-cover anchors.

A word goes if it lies in a window of `window` words whose sequence also starts in a
document with a smaller doc_id. D is a difference cover modulo v: every
residue is a difference of two of its members. For any two positions i and j some
d < v puts both i + d and j + d on residues of D. So two equal windows share, at one
offset, an anchor of window - v + 1 words that both documents hash, though each
document hashes only the positions with a residue in D (6 of 31).

An anchor then extends: its surroundings are the v - 1 words before and after it, which
hold every window that it lies in. Rows with an anchor's surroundings in common are
settled whole; windows at the rims of repeated passages are compared one by one (see
`repeats`). Windows are judged on the input.

Edge cases: null, empty and blank texts have no words; a text shorter than a window
loses nothing; a null doc_id is earlier than any other; equal rows are one document and
get equal answers; rows that repeat a doc_id with other texts are each judged against smaller
doc_ids only, never against one another; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vellum.llm.common import texts
from vellum.llm.repeats import ANCHOR, combine, merged, real_id, repeated_spans, rows_batch, sha256_hex, span_arrays, spans_per_doc, unique_rows

#: A perfect difference set: each non-zero residue is one difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def words_of(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space; first and end byte of each."""
    data = b" ".join(text.split())
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if not data:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return data, np.r_[0, gaps + 1], np.r_[gaps, len(data)]


def _anchors(window: int, shared: bool = False):
    size = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            g, k, doc, lo, hi = [], [], [], [], []
            for d, text in zip(batch.column("doc").to_pylist(), texts(batch), strict=True):
                data, first, end = words_of(text)
                n = len(first)
                if n < window:
                    continue
                p = np.flatnonzero(np.resize(in_cover, n - size + 1))
                a, b = np.maximum(p - PERIOD + 1, 0), np.minimum(p + window, n)
                g += [digest(data[i:j]) for i, j in zip(first[p].tolist(), end[p + size - 1].tolist(), strict=True)]
                # Surroundings cut off at a document's end differ by where the anchor lies in them.
                k += [digest(data[i:j], s) for i, j, s in zip(first[a].tolist(), end[b - 1].tolist(), (p - a).tolist(), strict=True)]
                doc.append(np.full(len(p), d, np.int64))
                lo.append(a.astype(np.int32))
                hi.append(b.astype(np.int32))
                if len(g) > 500_000:
                    yield _pack(g, k, doc, lo, hi, shared)
                    g, k, doc, lo, hi = [], [], [], [], []
            if g:
                yield _pack(g, k, doc, lo, hi, shared)

    return run


def _pack(g: list[int], k: list[int], doc: list, lo: list, hi: list, shared: bool) -> pa.RecordBatch:
    keys = (np.array(x, np.uint64).view(np.int64) for x in (g, k))
    return rows_batch(combine(*keys, np.concatenate(doc), np.concatenate(lo), np.concatenate(hi), True, shared))


_KEPT = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for text, spans in zip(texts(batch), span_arrays(batch.column("spans")), strict=True):
                words = text.split()
                n = len(words)
                if spans is not None:
                    left, at = [], 0
                    for a, b in zip(*(x.tolist() for x in merged(*spans)), strict=True):
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                rest = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(sha256_hex(rest))
                kept.append(rest.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (words joined by one space) per document."""
    if window <= PERIOD:
        raise ValueError(f"a window must be longer than the cover's period of {PERIOD} words")
    rows, with_spans, shared = unique_rows(docs)
    spans = spans_per_doc(repeated_spans(rows, rows.mapInArrow(_anchors(window, shared), ANCHOR), words_of, window, True, shared))
    out = with_spans(spans).mapInArrow(_remove(with_text), _KEPT)
    return out.select(real_id("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
