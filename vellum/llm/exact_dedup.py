"""Exact deduplication by Grace hashing.

Texts are equal when their bytes are identical after lower-casing A-Z. The
method has three steps, none of which holds an unbounded group:

1. *Combine*, map side. Each Arrow batch enters an open-addressing table that
   compares complete contents. A group of copies leaves a batch as one
   representative, so a text that makes up a third of the corpus reaches the
   shuffle at most once per batch.
2. *Partition*. Representatives are dealt out by content hash (Spark's shuffle
   is the first level of partitioning). A task that meets more distinct bytes
   than `bucket_bytes` writes its records to spill files by further hash bits
   and recurses, until a bucket fits its table. Spill files live only as long
   as the task that wrote them; a retried task writes its own.
3. *Apply*. Every row joins its representative's verdict by representative
   number. A number covers the rows of one batch at most, so no key is hot.

Between 1 and 3 the rows are a table in the shared folder: representative
numbers stay the same if an executor is lost.

Edge cases: a null text counts as empty and equals other empty texts; a null
doc_id never wins against one that is set; rows repeated with the same doc_id
count one by one in group_size, and all rows that carry the winning doc_id are
kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import staged, texts

FANOUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing; a slot matches on complete content."""

    def __init__(self, records: int = 64) -> None:
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self._resize(max(64, 2 * records))

    def _resize(self, least: int) -> None:
        self.mask = (1 << (least - 1).bit_length()) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry number of this content, and whether it is new."""
        at = h & self.mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == h and self.contents[found] == content:
                return found, False
            at = (at + 1) & self.mask
        self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        if 2 * len(self.contents) > self.mask:
            self._resize(4 * len(self.contents))
        return len(self.contents) - 1, True


#: A record on its way through the buckets: hash, content, rows, largest id, representative numbers.
Record = tuple[int, bytes, int, int | None, list[int]]


def grace_groups(records: Iterable[Record], bucket_bytes: int, folder: str, level: int = 0) -> Iterator[Record]:
    """Merge records of equal content; contents held at once stay within bucket_bytes."""
    table, rows, largest, numbers, held = ContentTable(), [], [], [], 0
    records = iter(records)
    # The lowest bits address the table and the shuffle; the buckets use those above.
    shift = 20 + FANOUT_BITS * level
    for h, content, n, top, reps in records:
        entry, new = table.entry(h, content)
        if new:
            rows.append(0)
            largest.append(None)
            numbers.append([])
            held += len(content) + 200
        rows[entry] += n
        largest[entry] = top if largest[entry] is None else largest[entry] if top is None else max(top, largest[entry])
        numbers[entry] += reps
        held += 8 * len(reps)
        if held > bucket_bytes and len(table.contents) > 1 and shift < 64:
            break
    merged = zip(table.hashes, table.contents, rows, largest, numbers, strict=True)
    if held <= bucket_bytes or len(table.contents) <= 1 or shift >= 64:
        yield from merged
        return
    paths = [os.path.join(folder, f"{level}-{b}-{h & 0xFFFF:x}") for b in range(1 << FANOUT_BITS)]
    files = [open(p, "wb") for p in paths]
    for part in (merged, records):
        for record in part:
            pickle.dump(record, files[(record[0] >> shift) & ((1 << FANOUT_BITS) - 1)], pickle.HIGHEST_PROTOCOL)
    del table, merged, rows, largest, numbers
    for f in files:
        f.close()
    for p in paths:
        yield from grace_groups(_spilled(p), bucket_bytes, folder, level + 1)
        os.unlink(p)


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


_COMBINED = "doc_id bigint, text_sha256 string, rep bigint, h bigint, content binary, n bigint, top bigint"
_GROUPS = "rep bigint, keep_id bigint, group_size bigint"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        table, entries, size, top, sha = ContentTable(len(ids)), [], [], [], []
        for doc_id, content in zip(ids, texts(batch, lower=True), strict=True):
            entry, new = table.entry(xxhash.xxh3_64_intdigest(content), content)
            if new:
                size.append(0)
                top.append(None)
                sha.append(hashlib.sha256(content).hexdigest())
            size[entry] += 1
            if doc_id is not None and (top[entry] is None or doc_id > top[entry]):
                top[entry] = doc_id
            entries.append(entry)
        seen, first = set(), []
        for entry in entries:
            first.append(entry not in seen)
            seen.add(entry)
        for lo in range(0, len(ids), 1000):
            part = list(zip(ids[lo : lo + 1000], entries[lo : lo + 1000], first[lo : lo + 1000], strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([i for i, _, _ in part], pa.int64()),
                    "text_sha256": pa.array([sha[e] for _, e, _ in part], pa.string()),
                    "rep": pa.array([base + e for _, e, _ in part], pa.int64()),
                    "h": pa.array([_signed(table.hashes[e]) if f else None for _, e, f in part], pa.int64()),
                    "content": pa.array([table.contents[e] if f else None for _, e, f in part], pa.binary()),
                    "n": pa.array([size[e] if f else None for _, e, f in part], pa.int64()),
                    "top": pa.array([top[e] if f else None for _, e, f in part], pa.int64()),
                }
            )
        base += len(table.contents)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _merge(bucket_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                cols = [batch.column(c) for c in ("h", "content", "n", "top", "rep")]
                for h, content, n, top, rep in zip(*(c.to_pylist() for c in (cols[0],)), cols[1], *(c.to_pylist() for c in cols[2:]), strict=True):
                    yield h & (2**64 - 1), content.as_py(), n, top, [rep]

        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            reps, keep, size = [], [], []
            for _, _, n, top, numbers in grace_groups(records(), bucket_bytes, folder):
                for lo in range(0, len(numbers), 50_000):
                    part = numbers[lo : lo + 50_000]
                    reps += part
                    keep += [top] * len(part)
                    size += [n] * len(part)
                    if len(reps) >= 50_000:
                        yield _group_batch(reps, keep, size)
                        reps, keep, size = [], [], []
            if reps:
                yield _group_batch(reps, keep, size)

    return run


def _group_batch(reps: list, keep: list, size: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "keep_id": pa.array(keep, pa.int64()), "group_size": pa.array(size, pa.int64())})


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 64 << 20) -> DataFrame:
    """Group equal texts; the row with the largest id of each group is kept.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    bucket_bytes bounds the content a task holds before it partitions further.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    combined = staged(rows.mapInArrow(_combine, _COMBINED), "exact_dedup")
    reps = combined.where(F.col("content").isNotNull()).select("h", "content", "n", "top", "rep")
    groups = reps.repartition("h").mapInArrow(_merge(bucket_bytes), _GROUPS)
    return (
        combined.select("doc_id", "text_sha256", "rep")
        .join(groups, "rep")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
