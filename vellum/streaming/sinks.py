"""What the streams share: a sink that a replayed batch doesn't change, and waves of input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns one folder, named by its number: run again after a failure, it replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def sunk(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(folder).drop("batch")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over the input that is there, from its checkpoint on; rows go to folder/rows by batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch_sink(f"{folder}/rows")).start()
    query.awaitTermination()
    return query


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keep state in RocksDB, on disk beside the task: arbitrary state needs it, and it outgrows memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
