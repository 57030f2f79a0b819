"""A catalog listing read page by page: a Python data source with some pages a task, and a resumed harvest.

A listing answers `{"pager": {"total": n}, "records": [...]}` for a start of 1, 1 + size, 1 + 2 size and so on; the
first answer tells how many there are. `url` holds `{start}` and may name http(s), a local path or a
file system of pyarrow. Filters on page_start and the option `ranges` (inclusive pairs of starts, as
JSON) leave pages out before any task is made: such pages are not asked for. A task takes `pages_per_task` of
those left, over holes, too: a task's start and a stored file cost more than many answers.

Edge cases: a total of 0 gives no rows; an answer that isn't whole JSON or can't be had fails its task, which
Spark tries again; records may lack any field (null); fields not in the schema are passed over.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

LISTING = "page_start bigint, pos int, pointer bigint, title string, sortda string, standa string, filetype string"
_TYPES = pa.schema([("page_start", pa.int64()), ("pos", pa.int32()), ("pointer", pa.int64()), *((c, pa.string()) for c in ("title", "sortda", "standa", "filetype"))])


def _answer(url: str, start: int) -> dict:
    at = url.replace("{start}", str(start))
    if at.startswith(("http://", "https://")):
        with urllib.request.urlopen(at, timeout=60) as answer:
            return json.loads(answer.read())
    at = at if not at.startswith("file:") else "/" + at[5:].lstrip("/")
    fs, path = pyarrow.fs.FileSystem.from_uri(at)
    with fs.open_input_file(path) as f:
        return json.loads(f.read())


class _Pages(InputPartition):
    """Pages of one task: runs of starts, first and last."""

    def __init__(self, runs: list[tuple[int, int]]) -> None:
        super().__init__(runs)
        self.runs = runs


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url = options["url"]
        self.size = int(options.get("size", 1000))
        self.per_task = int(options.get("pages_per_task", 1))
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.first, self.last, self.only = 1, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the interface's name)
        for f in filters:
            if getattr(f, "attribute", None) != ("page_start",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                bound = f.value - isinstance(f, LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
            else:
                yield f

    def _spans(self, total: int) -> Iterator[tuple[int, int]]:
        """Runs of page starts that the filters and ranges leave."""
        top = total if self.last is None else min(total, self.last)
        if self.only is not None:
            yield from ((s, s) for s in sorted(self.only) if s is not None and self.first <= s <= top and s % self.size == 1 % self.size and self._in_ranges(s))
            return
        for lo, hi in self.ranges if self.ranges is not None else [(1, total)]:
            lo, hi = max(lo, self.first), min(hi, top)
            lo += (1 - lo) % self.size  # up to a page's start
            if lo <= hi:
                yield lo, hi - (hi - 1) % self.size

    def _in_ranges(self, start: int) -> bool:
        return self.ranges is None or any(lo <= start <= hi for lo, hi in self.ranges)

    def partitions(self) -> list[_Pages]:
        total = int((_answer(self.url, 1).get("pager") or {}).get("total") or 0)
        tasks: list[list[tuple[int, int]]] = [[]]
        room = self.per_task
        for lo, hi in self._spans(total):
            while lo <= hi:
                if not room:
                    tasks.append([])
                    room = self.per_task
                last = min(hi, lo + (room - 1) * self.size)
                tasks[-1].append((lo, last))
                room -= (last - lo) // self.size + 1
                lo = last + self.size
        return [_Pages(runs) for runs in tasks]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        for start in (s for first, last in partition.runs for s in range(first, last + 1, self.size)):
            text = lambda v: None if v is None else str(v)
            rows = [
                {"page_start": start, "pos": pos, "pointer": None if r.get("pointer") is None else int(r["pointer"])} | {c: text(r.get(c)) for c in _TYPES.names[3:]}
                for pos, r in enumerate(_answer(self.url, start).get("records") or [])
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


class CatalogListing(DataSource):
    """`spark.read.format("catalog_listing").option("url", ".../{start}.json").load()`."""

    @classmethod
    def name(cls) -> str:
        return "catalog_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def listing(spark: SparkSession, url: str, size: int = 1000, pages_per_task: int = 1, ranges: list[list[int]] | None = None) -> DataFrame:
    """The listing as a table; filters on page_start choose the pages that are asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogListing)
    reader = spark.read.format("catalog_listing").option("url", url).option("size", size).option("pages_per_task", pages_per_task)
    return (reader if ranges is None else reader.option("ranges", json.dumps(ranges))).load()


def missing_ranges(stored: DataFrame, total: int, size: int) -> list[list[int]]:
    """Runs [first, last] of page starts that `stored` has no row of, in order: a pair for each hole, not for each page."""
    spark = stored.sparkSession
    starts = spark.range((total + size - 1) // size).select((F.col("id") * size + 1).alias("page_start"))
    gaps = starts.join(stored.select("page_start").distinct(), "page_start", "left_anti")
    beside = lambda by: gaps.select((F.col("page_start") + by).alias("page_start"))
    ends = [gaps.join(beside(by), "page_start", "left_anti").orderBy("page_start") for by in (size, -size)]
    first, last = ([r.page_start for r in e.toLocalIterator()] for e in ends)
    return [list(pair) for pair in zip(first, last, strict=True)]


def harvest(spark: SparkSession, url: str, folder: str, stored: DataFrame | None, size: int = 1000, until: int | None = None, pages_per_task: int = 1) -> list[list[int]]:
    """Append the pages that are not stored yet to the Parquet table in `folder`; the ranges that were asked for.

    A page is read by one task and lies in one file, so it is stored whole or not at all. until: the last start
    of this run. A page without records is never stored, and asked for again.
    """
    total = int((_answer(url, 1).get("pager") or {}).get("total") or 0)
    ranges = [[1, total]] if stored is None else missing_ranges(stored, total, size)
    rows = listing(spark, url, size, pages_per_task, ranges)
    (rows if until is None else rows.where(F.col("page_start") <= until)).write.mode("append").parquet(folder)
    return ranges


def write_listing(rows: DataFrame, folder: str, size: int, total: int) -> str:
    """Rows (page_start, pos, and fields of a record) as answers `<start>.json` in a folder; the url of the listing."""
    fields = [c for c in rows.columns if c not in ("page_start", "pos")]
    pages = rows.groupBy("page_start").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))).alias("rs"))  # `size` rows a page
    body = F.to_json(F.struct(F.struct(F.lit(total).alias("total")).alias("pager"), F.transform("rs", lambda x: x["r"]).alias("records")))
    url = f"{folder}/{{start}}.json"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder if not folder.startswith("file:") else "/" + folder[5:].lstrip("/"))
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for start, text in zip(*(batch.column(c).to_pylist() for c in ("page_start", "body")), strict=True):
                with fs.open_output_stream(f"{path}/{start}.json") as out:  # a repeated task writes the same again
                    out.write(text.encode())
            yield batch.select(["page_start"])

    pages.select("page_start", body.alias("body")).mapInArrow(put, "page_start bigint").agg(F.count("page_start")).collect()
    return url
