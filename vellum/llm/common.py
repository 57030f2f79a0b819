"""What the training-data operators share: staging, Arrow text access, tokens.

Stages are cut with Parquet tables in the folder that `spark.checkpoint.dir`
names, so that a lost executor never loses a finished stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words are runs of bytes other than these (space, tab, LF, VT, FF, CR), which
#: are the bytes that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset, a local session gets one of its
    own; on a cluster that is an error, since executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellum/{uuid.uuid4().hex}/{name}"


#: Paths of the tables staged within `scratch`, innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged within, but for those to keep; results that need them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back. keep: also beyond `scratch`."""
    path = new_dir(df.sparkSession, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this library in the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/vellum")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and its n + 1 offsets into them."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased; UTF-8 sequences stay whole."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


#: Rows whose texts are copied out of a batch at once: a task holds little besides the batch.
SLICE = 256


def texts(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[bytes]:
    """Each row's text as bytes, null as empty; lower: A-Z only."""
    yield from array_texts(batch.column(column), (lambda a: a), lower)


def array_texts(array: pa.Array, change: Callable[[pa.Array], pa.Array], lower: bool = False) -> Iterator[bytes]:
    """Each value as bytes, null as empty, slice by slice, after a change to the slice."""
    for lo in range(0, len(array), SLICE):
        data, at = utf8(change(array.slice(lo, SLICE)))
        whole = (lowered(data) if lower else data).tobytes()
        ends = at.tolist()
        for i in range(len(ends) - 1):
            yield whole[ends[i] : ends[i + 1]]


def long_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.int64())


def id_values(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """Ids as int64; a null id counts as the smallest long, before all others."""
    return pc.fill_null(long_column(batch, name), -(2**63)).to_numpy(zero_copy_only=False)


def schema_with(carried: StructField, before: str, after: str) -> StructType:
    """Columns by DDL around a carried struct, whose own columns may have any names."""
    fields = lambda ddl: StructType.fromDDL(ddl).fields if ddl else []
    return StructType([*fields(before), carried, *fields(after)])


def carrying(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(text, carried): the text, and the columns to keep in a struct, so that no name can clash."""
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    return docs.select(F.col("text").cast("string").alias("text"), carried.alias("carried"))


def carried_columns(keep: list[str], made: Iterable[str]) -> list[Column]:
    """The kept columns out of `carried`, but for those that the operator makes itself."""
    return [F.col(f"carried.`{c}`").alias(c) for c in keep if c not in set(made)]
