"""WARC archives: a writer with revisit records and a splittable reader.

Writer. Every row becomes one record in a gzip member of its own. A task streams
its rows into one archive in the shared folder, under a name of its own attempt;
the manifest of archives is a Spark table, so only archives of tasks whose
commit succeeded are read, however often tasks are retried.

Reader. The archives' bytes are cut into ranges; a task seeks to its range,
searches for the gzip magic, and takes a candidate for a member only if its first
bytes inflate to a WARC version line and a whole header. It owns the records
that start inside its range and reads past the range's end to finish the last.
A chance magic inside compressed data fails to inflate to such a header. (The
magic's second byte can't follow its first in UTF-8, so payloads here can't hold
a stored member either.)

Records with equal payloads of at least `least` bytes are written once: the row
with the largest id is a response, the others are revisits that refer to it.
Equality is by SHA-1 and length. The choice is made on ids and digests alone, so
a payload shared by a third of all rows moves as many small rows, which the join
splits, and its bytes are read where they lie.

Edge cases: a null payload is empty, and written as a response of no bytes; a
null id is written as an absent page number and read back as null; repeated rows
give a record each, all of them responses if they carry the winning id. An empty
table gives no archives and no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import new_dir, staged

MAGIC = b"\x1f\x8b\x08"
_MANIFEST = "archive string, bytes bigint, records bigint"
_RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; refers_to set: a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "sha1", "refers_to")]
            for page_id, url, html, length, sha1, refers in zip(*cols, strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(name, compression=None)
                payload = (html.as_py() or "").encode()
                member = _gzip(_record(page_id.as_py(), url.as_py(), payload, length.as_py(), sha1.as_py(), refers.as_py()))
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [n]})

    return run


def _uri(folder: str) -> str:
    return folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else "file://" + os.path.abspath(folder)


def write_warc(pages: DataFrame, folder: str, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row into archives below folder; returns their manifest."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    # Heads of equal payloads: Spark sums them per task before the shuffle.
    heads = keyed.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Revisits: ids and digests only. They are dealt out by payload, and split where one payload is hot.
    revisits = (
        keyed.select("page_id", "sha1", "payload_bytes").join(heads.select("sha1", "payload_bytes", "head"), ["sha1", "payload_bytes"])
        .where(~F.col("page_id").eqNullSafe(F.col("head")))
        .select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), F.col("head").alias("refers_to")).distinct()
    )
    decided = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    out = decided.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "sha1", "refers_to")
    return staged(out.mapInArrow(_writer(_uri(folder)), _MANIFEST), "warc_manifest")


def _head(data: bytes) -> tuple[bytes, bytes] | None:
    """Header block and rest of a record's first inflated bytes; None if it is none."""
    if not data.startswith(b"WARC/1."):
        return None
    head, end, rest = data.partition(b"\r\n\r\n")
    return (head, rest) if end else None


class _Range:
    """Buffered bytes of one archive from a start on."""

    def __init__(self, f, start: int, chunk: int) -> None:
        self.f, self.at, self.chunk, self.data, self.ended = f, start, chunk, b"", False
        f.seek(start)

    def more(self) -> bool:
        if not self.ended:
            got = self.f.read(self.chunk)
            self.data += got
            self.ended = not got
        return not self.ended

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _candidate(r: _Range) -> bool:
    """Whether the bytes at the front inflate to the start of a WARC record."""
    z, out, used = zlib.decompressobj(31), b"", 0
    while True:
        try:
            out += z.decompress(r.data[used:], 1 << 16)
        except zlib.error:
            return False
        used = len(r.data) - len(z.unconsumed_tail)
        if not b"WARC/1.".startswith(out[:7]):
            return False
        if _head(out):
            return True
        if z.eof or (not z.unconsumed_tail and not r.more()):
            return False


def _inflate(r: _Range) -> bytes:
    """The record at the front, whole; moves past its member."""
    z, out = zlib.decompressobj(31), []
    while True:
        out.append(z.decompress(r.data))
        if z.eof:
            r.skip(len(r.data) - len(z.unused_data))
            return b"".join(out)
        r.skip(len(r.data))
        if not r.more():
            raise ValueError("an archive ends inside a record")


def records_in(f, start: int, end: int, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive whose first byte lies in [start, end)."""
    r = _Range(f, start, chunk)
    while True:
        while (found := r.data.find(MAGIC)) < 0:
            r.skip(max(0, len(r.data) - len(MAGIC) + 1))
            if r.at >= end or not r.more():
                return
        r.skip(found)
        if r.at >= end:
            return
        if _candidate(r):
            yield _inflate(r)
        else:
            r.skip(1)


def parse(record: bytes) -> dict:
    head, rest = _head(record) or (b"", b"")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda name: int(fields[name][10:-1]) if fields.get(name, "<urn:page:>") != "<urn:page:>" else None
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "payload": None if fields["WARC-Type"] == "revisit" else payload.decode("utf-8", "replace"),
    }


def _reader(folder: str, with_payload: bool):
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        rows: list[dict] = []
        held = 0
        pack = lambda: pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in rows], t) for k, t in types.items()})
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "end")), strict=True):
                with fs.open_input_file(path) as f:
                    for record in records_in(f, start, end):
                        row = parse(record)
                        if not with_payload:
                            row["payload"] = None
                        held += len(record) if with_payload else 0
                        rows.append(row)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    return run


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = 4 << 20, with_payload: bool = False, most_tasks: int = 10_000) -> DataFrame:
    """Read the archives of a manifest by byte ranges of split_bytes, a task a range (most_tasks at most).

    The number of tasks is explicit: rows of ranges are a few bytes, and Spark would put them all into one.
    """
    ranges = manifest.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")).select(
        "archive", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end")
    )
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    tasks = int(min(max(count, 1), most_tasks))
    # Rows take turns: a hash would give some tasks several ranges and leave others idle.
    return ranges.repartition(tasks).mapInArrow(_reader(_uri(folder), with_payload), _RECORD)


def warc_round_trip(pages: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    folder = new_dir(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder), folder, split_bytes)
