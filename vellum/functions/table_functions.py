"""Table functions that SQL can call: markup to segments, OCR rows to blocks, boxes to slices.

`register(spark)` makes them known by name:

* `markup_parts(TABLE(SELECT id, text ...))`: a row a segment. Arrow batches in and out, any partitioning.
* `ocr_page(TABLE(...) PARTITION BY page ORDER BY (level, word_num))`: a row a block of each page. Level 1 gives the
  page's size and comes first; sums go on from batch to batch, so a page is never held. A call a page costs more
  than a short page's words: rows that already lie by page in each task, level 1 first, need no PARTITION BY.
* `box_slices(height, slice, overlap)`: for LATERAL, which takes no Arrow function in this Spark; eight rows at most.

Edge cases: a null text has no segments, a null height no slices; a page without a level 1 row has null places; null or
empty tokens and confidences under 40 count into a block's mean where they have a confidence, but aren't kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

#: Bullets and inline markup of an answer. Fixed values.
BULLET = re.compile(r"[ \t\r\f\v]*[-*•][ \t\r\f\v]+")
INLINE = re.compile(r"\[\[(co-[0-9]+)\]\]|\*\*([^*]+)\*\*")
#: Least confidence of a word that is kept. Fixed value.
LEAST = 40.0

_BLANK = " \t\r\f\v"


def segments(text: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(line, pos, bullet, kind, text) of an answer; lines of blanks count but have no segments."""
    for n, raw in enumerate(text.split("\n")):
        line = raw.rstrip(_BLANK)
        if not line:
            continue
        mark = BULLET.match(line)
        body, bullet = line[mark.end() :] if mark else line, mark is not None
        at = pos = 0
        for m in INLINE.finditer(body):
            if m.start() > at:
                yield n, pos, bullet, "text", body[at : m.start()]
                pos += 1
            yield n, pos, bullet, *(("cite", m[1]) if m[1] else ("bold", m[2]))
            pos, at = pos + 1, m.end()
        if at < len(body):
            yield n, pos, bullet, "text", body[at:]


@arrow_udtf(returnType="id bigint, line int, pos int, bullet boolean, kind string, text string")
class MarkupParts:
    _names = ("id", "line", "pos", "bullet", "kind", "text")
    _types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        held: list[tuple] = []
        size = 0
        for i, text in zip(rows.column("id"), rows.column("text"), strict=True):
            for s in segments(text.as_py() or ""):
                held.append((i.as_py(), *s))
                size += len(s[4])
                if size > 1 << 22 or len(held) > 1 << 16:  # long texts go on in parts
                    yield self._pack(held)
                    held, size = [], 0
        if held:
            yield self._pack(held)

    def _pack(self, held: list[tuple]) -> pa.Table:
        return pa.table({n: pa.array(c, t) for n, t, c in zip(self._names, self._types, zip(*held, strict=True), strict=True)})


@arrow_udtf(returnType="page bigint, block int, words bigint, kept bigint, conf double, right double, characters bigint")
class OcrPage:
    _types = {"page": pa.int64(), "block": pa.int32(), "words": pa.int64(), "kept": pa.int64(), "conf": pa.float64(), "right": pa.float64(), "characters": pa.int64()}

    def __init__(self) -> None:
        self.widths: dict[int | None, int | None] = {}
        self.blocks: dict[tuple[int | None, int | None], list] = {}

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        head = rows.filter(pc.fill_null(pc.equal(rows.column("level"), 1), False))
        self.widths.update(zip(head.column("page").to_pylist(), head.column("width").to_pylist(), strict=True))
        words = rows.filter(pc.fill_null(pc.equal(rows.column("level"), 5), False))
        token = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(words.column("text"), "")), "[^a-z0-9]", "")
        conf = words.column("conf")
        keep = pc.and_(pc.not_equal(token, ""), pc.fill_null(pc.greater_equal(conf, LEAST), False))
        right = pc.if_else(keep, pc.cast(pc.add(words.column("left"), words.column("width")), pa.float64()), None)
        t = pa.table({"page": words.column("page"), "block": words.column("block"), "conf": conf, "keep": pc.cast(keep, pa.int64()), "right": right, "n": pc.if_else(keep, pc.cast(pc.utf8_length(token), pa.int64()), 0)})
        got = t.group_by(["page", "block"], use_threads=False).aggregate([("conf", "sum"), ("conf", "count"), ("keep", "sum"), ("right", "max"), ("n", "sum")])
        for r in got.to_pylist():
            s = self.blocks.setdefault((r["page"], r["block"]), [0.0, 0, 0, None, 0])
            s[0] += r["conf_sum"] or 0.0
            s[1] += r["conf_count"]
            s[2] += r["keep_sum"] or 0
            s[3] = max((x for x in (s[3], r["right_max"]) if x is not None), default=None)
            s[4] += r["n_sum"] or 0
        # Pages before the batch's last are whole.
        last = rows.column("page")[-1].as_py()
        whole = {k: v for k, v in self.blocks.items() if k[0] != last}
        if whole:
            yield self._pack(whole)
        self.blocks = {k: v for k, v in self.blocks.items() if k[0] == last}
        self.widths = {p: w for p, w in self.widths.items() if p == last}

    def terminate(self) -> Iterator[pa.Table]:
        yield self._pack(self.blocks)

    def _pack(self, blocks: dict[tuple[int | None, int | None], list]) -> pa.Table:
        rows = [
            (page, block, n, kept, total / n if n else None, right / width if right is not None and (width := self.widths.get(page)) else None, size)
            for (page, block), (total, n, kept, right, size) in blocks.items()
        ]
        columns = list(zip(*rows, strict=True)) or [()] * len(self._types)
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(self._types.items(), columns, strict=True)})


@udtf(returnType="slice int, top bigint, bottom bigint", useArrow=False)
class BoxSlices:
    def eval(self, height: int, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        if height is None:
            return
        n = 1 if height <= size else min(8, math.ceil((height - overlap) / (size - overlap)))
        step = (height - overlap) / n if n > 1 else float(height)
        for i in range(n):
            yield i, math.floor(i * step + 0.5), min(height, math.floor(i * step + step + overlap + 0.5))


def register(spark: SparkSession) -> None:
    """Make the table functions known to this session's SQL."""
    for name, handler in (("markup_parts", MarkupParts), ("ocr_page", OcrPage), ("box_slices", BoxSlices)):
        spark.udtf.register(name, handler)
