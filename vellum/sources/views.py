"""Archive-shaped views over the driver's tables, with their DuckDB twins.

| archive table   | stands on            |
|-----------------|----------------------|
| content objects | documents + labels   |
| page ingests    | orders               |
| issues          | customer             |
| object topics   | lineitem (part mod 12) |
| object entities | lineitem + supplier  |
| object events   | events               |

An object's issue is its source and a run of 500 ids. Every view selects its columns first, so that scans read no more than a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.vocabulary import OBJECT_CLASSES, TOPICS
from vellum.sources.tables import table


def pick(index: Column, values: list[str] | tuple[str, ...]) -> Column:
    """values[index] as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Objects an issue holds at most: issues are of bounded size, and their number grows with the table.
ISSUE_SIZE = 500


def bare_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content objects with machine text and human overlay, without the publication gate: no join."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat_ws("-", F.col("source"), F.floor(i / ISSUE_SIZE).cast("string")).alias("issue_id"),
        i.alias("page_record"),
        (i % 40).alias("seq"),
        pick(i % len(OBJECT_CLASSES), OBJECT_CLASSES).alias("object_class"),
        F.when(i % 5 == 0, "cartoon panel").when(i % 5 == 1, "street map").otherwise(F.col("lang")).alias("role"),
        F.col("text"),
        F.when(i % 17 == 0, F.concat(F.lit("Read again: "), "text")).alias("text_human"),
        F.when(i % 13 == 0, F.concat(F.lit("Title "), i)).alias("display_title"),
        F.when(i % 26 == 0, "drafter-1").alias("display_title_model"),
        F.when(i % 7 != 0, (F.col("n_chars") % 100) / 100.0).alias("confidence"),
        F.when(i % 3 == 0, "reviewed").when(i % 3 == 1, "flagged").alias("curation_status"),
        (i % 29 == 0).alias("is_advertorial"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content objects with their publication gate; unlabelled ones are unpublished."""
    gate = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    return bare_objects(spark, sf_dir).join(gate, "id", "left").withColumn("is_published", F.coalesce(F.col("quality") == 1, F.lit(False))).drop("quality")


OBJECTS_SQL = f"""
  SELECT d.doc_id AS id, d.source || '-' || d.doc_id // {ISSUE_SIZE} AS issue_id, d.doc_id AS page_record, d.doc_id % 40 AS seq,
    ({sql_list(OBJECT_CLASSES)})[d.doc_id % {len(OBJECT_CLASSES)} + 1] AS object_class,
    CASE WHEN d.doc_id % 5 = 0 THEN 'cartoon panel' WHEN d.doc_id % 5 = 1 THEN 'street map' ELSE d.lang END AS role,
    d.text, CASE WHEN d.doc_id % 17 = 0 THEN 'Read again: ' || d.text END AS text_human,
    CASE WHEN d.doc_id % 13 = 0 THEN 'Title ' || d.doc_id END AS display_title,
    CASE WHEN d.doc_id % 26 = 0 THEN 'drafter-1' END AS display_title_model,
    coalesce(l.quality = 1, false) AS is_published,
    CASE WHEN d.doc_id % 7 <> 0 THEN (d.n_chars % 100) / 100.0 END AS confidence,
    CASE WHEN d.doc_id % 3 = 0 THEN 'reviewed' WHEN d.doc_id % 3 = 1 THEN 'flagged' END AS curation_status,
    d.doc_id % 29 = 0 AS is_advertorial
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
"""


def published_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids behind the publication gate."""
    gate = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    return gate.where("quality = 1").select("id")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects behind the publication gate: a semi join."""
    return bare_objects(spark, sf_dir).join(published_ids(spark, sf_dir), "id", "left_semi").withColumn("is_published", F.lit(True))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ingests, one per order; the page's record is the order's key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("page_record"),
        F.when(k % 11 != 0, F.col("o_custkey")).alias("issue_pointer"),
        F.when(k % 9 != 0, k % 8 + 1).alias("page_number"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (k % 30).cast("int").alias("object_count"),
    )


PAGES_SQL = """
  SELECT o_orderkey AS page_record, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS issue_pointer,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 8 + 1 END AS page_number,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
    o_orderdate AS created_at, CAST(o_orderkey % 30 AS INTEGER) AS object_count
  FROM orders
"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of issues, one per customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("pointer"),
        F.concat_ws(", ", F.initcap(F.lower("c_mktsegment")), "c_name").alias("title"),
        F.when(k % 4 != 0, F.initcap(F.lower("c_mktsegment"))).alias("serial"),
        F.when(k % 10 != 0, F.format_string("19%02d-%02d-%02d", k % 40 + 10, k % 12 + 1, k % 28 + 1)).alias("sort_date"),
        pick(F.col("c_nationkey") % 5, ("http://rights/InC/1.0/", "http://rights/NoC-US/1.0/", "http://rights/NKC/1.0/", "", "https://creativecommons.org/publicdomain/mark/1.0/")).alias("rights_uri"),
        F.when(k % 6 != 0, (k % 6).cast("int")).alias("pages"),
        pick(k % 3, ("cpd", "jp2", "url")).alias("filetype"),
    )


ISSUES_SQL = """
  SELECT c_custkey AS pointer, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ', ' || c_name AS title,
    CASE WHEN c_custkey % 4 <> 0 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS serial,
    CASE WHEN c_custkey % 10 <> 0 THEN printf('19%02d-%02d-%02d', c_custkey % 40 + 10, c_custkey % 12 + 1, c_custkey % 28 + 1) END AS sort_date,
    (['http://rights/InC/1.0/', 'http://rights/NoC-US/1.0/', 'http://rights/NKC/1.0/', '', 'https://creativecommons.org/publicdomain/mark/1.0/'])[c_nationkey % 5 + 1] AS rights_uri,
    CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 6 AS INTEGER) END AS pages,
    (['cpd', 'jp2', 'url'])[c_custkey % 3 + 1] AS filetype
  FROM customer
"""


def object_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge of objects to the closed topic vocabulary; repeats of a topic keep their first rank."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.select(F.col("l_orderkey").alias("object_id"), (F.col("l_partkey") % len(TOPICS)).cast("int").alias("topic_id"), "l_linenumber")
        .groupBy("object_id", "topic_id").agg(F.min("l_linenumber").alias("rank"))
    )


OBJECT_TOPICS_SQL = f"""
  SELECT l_orderkey AS object_id, CAST(l_partkey % {len(TOPICS)} AS INTEGER) AS topic_id, min(l_linenumber) AS rank
  FROM lineitem GROUP BY 1, 2
"""


def topics(spark: SparkSession) -> DataFrame:
    """The closed vocabulary: twelve rows, broadcast by size."""
    return spark.createDataFrame(list(enumerate(TOPICS)), "topic_id int, name string")


TOPICS_SQL = f"SELECT CAST(i AS INTEGER) AS topic_id, ({sql_list(TOPICS)})[i + 1] AS name FROM range({len(TOPICS)}) r(i)"

ENTITY_TYPES = ("person", "organization", "place", "work", "product", "other")


def object_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge of objects to named entities, with name and type."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    ents = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), pick(F.col("s_suppkey") % 6, ENTITY_TYPES).alias("entity_type"))
    return li.select(F.col("l_orderkey").alias("object_id"), F.col("l_suppkey").alias("entity_id")).distinct().join(ents, "entity_id")


OBJECT_ENTITIES_SQL = f"""
  SELECT DISTINCT l_orderkey AS object_id, s_suppkey AS entity_id, s_name AS name, ({sql_list(ENTITY_TYPES)})[s_suppkey % 6 + 1] AS entity_type
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
"""

#: Events an object has at most: objects with events grow in number with the table.
EVENTS_OF_ONE = 10

EVENT_KINDS = ("concert", "film", "race", "civic", "club_engagement", "exhibition", "unheard_of")


def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar rows extracted from objects, ten an object at most; dates stay printed text."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return ev.select(
        k.alias("event_id"),
        F.floor(k / EVENTS_OF_ONE).alias("source_object_id"),
        pick(F.col("user_id") % 7, EVENT_KINDS).alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd").alias("start_text"),
        F.when(k % 4 == 0, F.concat(F.lit("$"), (k % 90 + 1))).alias("price_text"),
    )


OBJECT_EVENTS_SQL = f"""
  SELECT event_id, event_id // {EVENTS_OF_ONE} AS source_object_id, ({sql_list(EVENT_KINDS)})[user_id % 7 + 1] AS event_type,
    strftime(ts, '%Y-%m-%d') AS start_text, CASE WHEN event_id % 4 = 0 THEN '$' || (event_id % 90 + 1) END AS price_text
  FROM events
"""
