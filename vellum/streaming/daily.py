"""Labelled extension: the ledger's day rollup as a stream; its batch twin is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.folders import new_folder
from vellum.sources.tables import table


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Calls and value by step and day; works on a stream and on a table alike."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("value"))


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read events as a stream to its end; each micro-batch replaces the rollup's table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = new_folder(spark, "stream")

    def replace(batch: DataFrame, number: int) -> None:
        batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "step", "calls", "value").write.mode("overwrite").parquet(f"{folder}/table")

    query = daily(source).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/table")


def batch_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(table(spark, sf_dir, "events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "step", "calls", "value")


QUERIES = {"stream_daily": stream_daily, "batch_daily": batch_daily}
_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS step, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
ORACLE_SQL = {"stream_daily": _SQL, "batch_daily": _SQL}
