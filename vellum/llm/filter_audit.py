"""Filter interaction audit over a packed bitmap index.

1. *Flags.* One pass over the whole texts says which filters a document fails (`quality_flags`).
   The filter on repeated texts compares whole texts by SHA-256: the smallest doc_id of each text
   is counted per task before the shuffle, and joined back by (text, doc_id), so that a text in a
   third of all rows is no hot key. Labels are joined by doc_id.
2. *Index.* Each partition packs its rows into NumPy bitsets: one for every filter, one for
   every label, and one for the rows themselves, in which every part has bytes of its own.
3. *Subsets.* The rows that outlive a set of filters are those of the set without its last filter,
   AND-NOT that filter's bits: 2^k ANDs give all subsets that may be the prefix of an order.
   Popcounts by part are the only rows that leave a partition; Spark sums them.
4. *Orders.* Every figure of a step is a difference of the counts of two subsets. All orders
   (k!, 120 for five filters) times the steps are joined to the counts of each part.

A partition holds one Arrow batch's bits at a time; what it hands on is bounded by the parts of a batch
times 2^k, and Spark adds these up by (part, subset) before and after the shuffle.

Edge cases: null and empty texts count as empty (they have no words: fail "under 200 words" and no
other share); a null part is the part ''; a null doc_id comes before all others and has
no label; rows that repeat a doc_id and a text are each counted, and none is earlier than the other;
labels that repeat a doc_id count as 1 if any of them is; an empty table gives no
parts, hence no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import staged, texts

#: The filters, in the order of the flags' bits.
FILTERS = "ABCDE"

_SYMBOL = re.compile(rb"[#$%&*|]")
_FLAGS = "doc bigint, part string, flags int, h1 bigint, h2 bigint, h3 bigint, h4 bigint"


def text_flags(text: bytes) -> int:
    """Bits 0 to 3: under 200 words; under half of them distinct; over 2 % capitals; a symbol."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    capitals = int(np.count_nonzero((data >= 65) & (data <= 90)))
    points = int(np.count_nonzero((data & 0xC0) != 0x80))
    few, repeated = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | repeated << 1 | (100 * capitals > 2 * points) << 2 | (_SYMBOL.search(text) is not None) << 3


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags, digests = [], []
        for text in texts(batch):
            flags.append(text_flags(text))
            digests.append(hashlib.sha256(text).digest())
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(flags, pa.int32()), *[pa.array(h[:, i].copy()) for i in range(4)]], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("doc", pa.int64()), ("part", pa.string()), ("flags", pa.int32()), *[(f"h{i}", pa.int64()) for i in (1, 2, 3, 4)]])


def quality_flags(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc, part, flags): the five filters that each row fails, as bits in the order of FILTERS."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    each = staged(rows.mapInArrow(_flags, _FLAGS), "filter_flags")
    text = ["h1", "h2", "h3", "h4"]
    first = each.groupBy(*text).agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    later = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(0)
    return each.join(first, [*text, "doc"], "left").select("doc", "part", F.col("flags").bitwiseOR(later).alias("flags"))


def _subset_counts(filters: int, labels: int):
    """Rows (part, flags, labels) -> (part, subset, n, n of each label): rows that fail no filter of the subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            codes = parts.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=len(parts.dictionary))
            # Every part starts at a byte of its own, so that popcounts by byte add up by part.
            bytes_of = (sizes + 7) >> 3
            start = np.cumsum(bytes_of) - bytes_of
            within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.repeat(start, sizes) * 8 + within

            def packed(bits: np.ndarray) -> np.ndarray:
                spread = np.zeros(int(bytes_of.sum()) * 8, bool)  # noqa: B023
                spread[place] = bits[order]  # noqa: B023
                return np.packbits(spread)

            flags, marks = batch.column("flags").to_numpy(), batch.column("labels").to_numpy()
            fails = [packed((flags >> f) & 1 == 1) for f in range(filters)]
            wanted = [packed((marks >> m) & 1 == 1) for m in range(labels)]
            alive = {0: packed(np.ones(len(codes), bool))}
            for subset in range(1, 1 << filters):
                last = subset.bit_length() - 1
                alive[subset] = alive[subset & ~(1 << last)] & ~fails[last]
            counts = [[np.add.reduceat(np.bitwise_count(bits).astype(np.int64), start) for bits in (rows, *[rows & w for w in wanted])] for rows in alive.values()]
            p = len(sizes)
            arrays = [pa.concat_arrays([parts.dictionary] * len(alive)), pa.array(np.repeat(np.array(list(alive), np.int32), p))]
            arrays += [pa.array(np.concatenate([c[k] for c in counts])) for k in range(1 + labels)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "subset", "n", *[f"n{k}" for k in range(labels)]])

    return run


def subset_counts(rows: DataFrame, filters: int, labels: int) -> DataFrame:
    """rows (part, flags, labels: bits) -> for each part and each subset of filters, the rows that
    fail none of it (n), and of these the rows with each label (n0, n1, ...)."""
    names = ["n", *[f"n{k}" for k in range(labels)]]
    packed = rows.select("part", "flags", "labels").mapInArrow(_subset_counts(filters, labels), ", ".join(["part string", "subset int", *[f"{n} bigint" for n in names]]))
    return packed.groupBy("part", "subset").agg(*[F.sum(n).alias(n) for n in names])


def interactions(counts: DataFrame, filters: str, labels: Sequence[str]) -> DataFrame:
    """Counts of subsets -> part, filter_order, step, kept, removed, redundant, unique_fails,
    <label>_lost, shapley: a row for each part, order and step."""
    k, all_of = len(filters), (1 << len(filters)) - 1
    per_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", *[f"n{i}" for i in range(len(labels))])))).alias("alive"))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[x] for x in order), "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    orders = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>")  # k! * k rows
    at = lambda subset, name="n": F.col("alive")[subset][name]
    removed = lambda before, after, name="n": at(before, name) - at(after, name)
    # An order's prefix before f is S in |S|! (k - 1 - |S|)! of the k! orders.
    shapley = F.lit(0).cast("long")
    for f in range(k):
        sets = [s for s in range(1 << k) if not s >> f & 1]
        total = sum((removed(F.lit(s), F.lit(s | 1 << f)) * (math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())) for s in sets), F.lit(0).cast("long"))
        shapley = F.when(F.col("f") == f, total).otherwise(shapley)
    one = F.expr("shiftleft(1, f)")
    return per_part.select("*", F.inline(orders)).select(
        "part", "filter_order", "step", at(F.col("after")).alias("kept"), removed(F.col("before"), F.col("after")).alias("removed"),
        (removed(F.lit(0), one) - removed(F.col("before"), F.col("after"))).alias("redundant"),
        removed(F.lit(all_of).bitwiseXOR(one), F.lit(all_of)).alias("unique_fails"),
        *[removed(F.col("before"), F.col("after"), f"n{i}").alias(f"{name}_lost") for i, name in enumerate(labels)], shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each filter removes at each step of every order, by part."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    bits = F.coalesce("quality", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    rows = quality_flags(docs, part).join(marks, "doc", "left").select("part", "flags", bits.alias("labels"))
    return interactions(subset_counts(rows, len(FILTERS), 2), FILTERS, ("good", "toxic"))
