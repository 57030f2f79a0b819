"""Rows kept one per key in a stored table that is upserted, compacted and upserted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.sources.folders import new_folder
from vellum.sources.tables import table
from vellum.sources.upserts import KeyedTable

LATEST = "user_id bigint, event_type string, ts timestamp, event_id bigint, value double, first_event bigint"


def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of every user and type after four writes, and the event that came with its first one.

    99 of 100 events are there at first and are made the base; the others come in three later writes, one before a
    compaction and two after it. Events without a user or a type have no key and are in no table.
    """
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    e = e.selectExpr("user_id", "event_type", "ts", "event_id", "value", "event_id AS first_event")
    stored = KeyedTable(spark, new_folder(spark, "latest"), LATEST, ["user_id", "event_type"], ["ts", "event_id"], keep=["first_event"], buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored.upsert(e.where("event_id % 100 <> 0"))
    stored.compact()
    stored.upsert(e.where("event_id % 300 = 0"))
    stored.compact()
    stored.upsert(e.where("event_id % 300 = 100"))
    stored.upsert(e.where("event_id % 300 = 200"))
    return stored.read().selectExpr("user_id", "event_type", "event_id", "round(value, 4) AS value", "first_event")


QUERIES = {"stored_upserts": stored_upserts}

ORACLE_SQL = {
    "stored_upserts": """WITH e AS (SELECT *, CASE WHEN event_id % 100 <> 0 THEN 0 ELSE 1 + event_id % 300 // 100 END AS written FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
        l AS (SELECT user_id, event_type, event_id, round(value, 4) AS value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY written DESC, ts DESC NULLS LAST, event_id DESC) = 1),
        f AS (SELECT user_id, event_type, event_id AS first_event FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY written, ts NULLS FIRST, event_id) = 1)
      SELECT l.*, f.first_event FROM l JOIN f USING (user_id, event_type)""",
}
