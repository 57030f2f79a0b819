"""Readers over the Parquet tables, and the archive-shaped views of them.

Timestamps are stored without a zone; they are cast once, here, to session-zone
timestamps so that every query sees one type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-call ledger: one row per call; cost is NULL where unpriced.

    `events` stands in for it: step is the event type, page the user, tokens the
    integer in `props`; one step ('signup') has no price, so its cost is NULL.
    """
    ev = table(spark, sf_dir, "events")
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"), F.lit(0).cast("long"))
    return ev.select(
        F.col("event_id").alias("call_id"),
        F.col("ts").alias("called_at"),
        F.col("event_type").alias("step"),
        F.col("user_id").alias("page_record"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        (F.col("user_id") % 20).alias("issue_pointer"),
        k.alias("input_tokens"),
        (k * 2).alias("output_tokens"),
        F.when(F.col("event_type") != "signup", F.round(F.col("value"), 6)).alias("cost_usd"),
    )


LEDGER_SQL = """
  SELECT event_id AS call_id, ts AS called_at, event_type AS step, user_id AS page_record,
         'm' || (user_id % 3) AS model, user_id % 20 AS issue_pointer,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 2 AS output_tokens,
         CASE WHEN event_type <> 'signup' THEN round(value, 6) END AS cost_usd
  FROM events
"""
