"""The ledger as two streams over one feed: every call appended once, and a rollup of days that are over.

Both sinks are keyed by batch number, so a batch that runs again after a failure replaces its own rows and changes
nothing. The rollup is in append mode: a day and step is written when the watermark has passed the day's
end, and its state is deleted then, so state holds the open days only. Calls that come after their day was
closed are in the ledger and not in the rollup: the difference is what came late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.sources.folders import new_folder
from vellum.sources.tables import table
from vellum.streaming.daily import daily
from vellum.streaming.sinks import drained, sunk

CALL = "event_id bigint, ts timestamp, event_type string, value double"
CLOSED = "w struct<start: timestamp, end: timestamp>, step string, calls bigint, value double"
LATE = "2 days"


def run_ledger(spark: SparkSession, folder: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Take what is new in folder/feed into the ledger and the rollup, each from its checkpoint on."""
    feed = spark.readStream.schema(CALL).parquet(f"{folder}/feed")
    return drained(feed, f"{folder}/ledger"), drained(daily(feed, LATE), f"{folder}/rollup")


def closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Closed days by step: calls and value counted in time, and calls that came late."""
    day = lambda at: F.date_format(at, "yyyy-MM-dd").alias("day")
    rollup = sunk(spark, f"{folder}/rollup/rows", CLOSED).select(day(F.col("w.start")), "step", "calls", "value")
    ledger = sunk(spark, f"{folder}/ledger/rows", CALL).groupBy(day(F.col("ts")), F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("all"))
    return rollup.join(ledger, ["day", "step"]).select("day", "step", "calls", "value", (F.col("all") - F.col("calls")).alias("late"))


def delivery(ts: Column, event_id: Column) -> Column:
    """The wave in which a call arrives: ten days a wave, and every fiftieth call a wave late."""
    return F.floor((F.dayofmonth(ts) - 1) / 10) + F.when(event_id % 50 == 0, 1).otherwise(0)


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered in waves, some of them late; both streams stop and resume between waves."""
    folder = new_folder(spark, "ledger")
    calls = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    calls.withColumn("wave", delivery(F.col("ts"), F.col("event_id"))).write.partitionBy("wave").parquet(f"{folder}/waves")
    for number in range(5):
        new = spark.read.schema(f"{CALL}, wave int").parquet(f"{folder}/waves").where(F.col("wave") == number).drop("wave")
        new.write.mode("append").parquet(f"{folder}/feed")
        run_ledger(spark, folder)
    return closed_days(spark, folder)


QUERIES = {"ledger_rollup": ledger_rollup}
ORACLE_SQL = {
    "ledger_rollup": """WITH e AS (SELECT *, ts::DATE AS d, (day(ts) - 1) // 10 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS wave FROM events),
        w AS (SELECT k, (SELECT max(ts) FROM e WHERE wave <= k) - INTERVAL 2 DAY AS mark FROM range(5) r(k)),
        r AS (SELECT e.*, coalesce(d + 1 <= w.mark, false) AS late FROM e LEFT JOIN w ON w.k = e.wave - 1)
      SELECT strftime(d, '%Y-%m-%d') AS day, event_type AS step, count(*) FILTER (WHERE NOT late) AS calls, round(sum(value) FILTER (WHERE NOT late), 4) AS value, count(*) FILTER (WHERE late) AS late
      FROM r WHERE d + 1 <= (SELECT max(mark) FROM w) GROUP BY 1, 2""",
}
