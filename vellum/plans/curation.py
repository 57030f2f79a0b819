"""Curation read models and transitions over the archive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import transitions as X
from vellum.sources.tables import table
from vellum.sources.views import OBJECT_ENTITIES_SQL, OBJECT_EVENTS_SQL, OBJECT_TOPICS_SQL, OBJECTS_SQL, PAGES_SQL, bare_objects, object_entities, object_events, object_topics, objects, pages

_O, _P = f"o AS ({OBJECTS_SQL})", f"p AS ({PAGES_SQL})"


def publish_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).select("id", "is_published", F.when(F.col("is_published"), F.lit("1999-01-01")).alias("published_at"))
    batch = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("publish"))
    return X.publish_batch(rows, batch, F.lit("2024-02-01"))


def publish_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a batch that don't exist."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return asked.join(bare_objects(spark, sf_dir).select("id"), "id", "left_anti")


def clear_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every page after a clear: by its objects left and whether it has a proposal."""
    left = objects(spark, sf_dir).where("is_published").groupBy("page_record").agg(F.count(F.lit(1)).alias("left"))
    p = pages(spark, sf_dir).join(left, "page_record", "left")
    status = X.cleared_status(F.coalesce("left", F.lit(0)), F.col("page_record") % 3 == 0, F.col("status") == "running")
    return p.select("page_record", status.alias("status"), F.greatest(F.lit(0), F.col("object_count") - F.coalesce("left", F.lit(0)).cast("int")).alias("object_count"))


def cascade_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deletion of each object would take with it."""
    count = lambda df, k, n: df.groupBy(F.col(k).alias("id")).agg(F.count(F.lit(1)).alias(n))
    o = bare_objects(spark, sf_dir).select("id")
    for df, k, n in ((object_topics(spark, sf_dir), "object_id", "topics"), (object_entities(spark, sf_dir), "object_id", "entities"), (object_events(spark, sf_dir), "source_object_id", "events")):
        o = o.join(count(df, k, n), "id", "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))
    return o


def cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each child table that survive the deletion of every advertorial."""
    gone = bare_objects(spark, sf_dir).where("is_advertorial").select("id")
    kept = X.cascade_delete({"topics": (object_topics(spark, sf_dir), "object_id"), "entities": (object_entities(spark, sf_dir), "object_id"), "events": (object_events(spark, sf_dir), "source_object_id")}, gone)
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 4).alias("value"))
    return X.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    old = e.where("event_id % 4 = 0").select("user_id", "day").distinct()
    return X.insert_ignore(old, e.where("event_id % 4 <> 0"), ["user_id", "day"], [F.asc("event_id")])


def review_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    patch = table(spark, sf_dir, "labels").select(i.alias("id"), F.when(i % 4 == 0, "approved").alias("curation_status"), (i % 2 == 0).alias("has_curation_status"), F.concat(F.lit("T"), i).alias("display_title"), (i % 3 == 0).alias("has_display_title"))
    return X.patched(bare_objects(spark, sf_dir).select("id", "curation_status", "display_title"), patch, "id", ["curation_status", "display_title"])


def page_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects per page after new runs have replaced whole pages, one of ten; a page has eight orders' lines."""
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("page_record"), F.col("l_suppkey").alias("maker"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 80 < 3").select(F.floor(F.col("o_orderkey") / 8).alias("page_record"), F.lit(-1).cast("long").alias("maker"))
    return X.replace_pages(li, new).groupBy("page_record").agg(F.count(F.lit(1)).alias("objects"), F.min("maker").alias("first_maker"))


def propose_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages proposed again: in review, their boxes reset but for discarded ones; used and superseded drafts."""
    p = pages(spark, sf_dir).where("status <> 'running'")
    detector = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("page_record") % 3 + 1).cast("int"))
    boxes = F.transform(F.sequence(F.lit(1), (F.col("page_record") % 4 + 2).cast("int")), lambda i: F.struct(i.alias("id"), (i % 2 == 0).alias("discarded")))
    r = p.select("page_record", F.when(detector == "a", "used").otherwise("superseded").alias("draft"), F.when(F.col("status") == "done", "done").otherwise("review").alias("status"), boxes.alias("boxes"))
    return r.select("page_record", "draft", "status", F.size(F.filter("boxes", lambda b: b["discarded"])).alias("kept_discards"), F.size("boxes").alias("boxes"))


def proposal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a proposal that a detector made and nobody touched, that moved, that were drawn."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), (F.col("vec_id") % 10).alias("state"), F.floor(F.col("vec_id") / 20).alias("page"))
    return e.groupBy("page").agg(F.count_if(F.col("state") < 6).alias("kept"), F.count_if(F.col("state").between(6, 7)).alias("moved"), F.count_if(F.col("state") > 7).alias("drawn"), F.countDistinct("label").alias("groups"))


def status_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside the vocabulary become its default, as a check on write would demand."""
    return bare_objects(spark, sf_dir).select("id", X.normalised(F.col("curation_status"), ("reviewed", "approved"), "unreviewed").alias("curation_status"))


def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of copied objects under their new surrogate ids."""
    ids = bare_objects(spark, sf_dir).select(F.col("id").alias("old_id"), (F.col("id") + 100_000).alias("new_id"))
    return X.remapped(object_topics(spark, sf_dir).select("object_id", "topic_id"), ids, "object_id")


def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached sections that may be served: every reference still is published."""
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("section"), F.col("l_orderkey").alias("id")).distinct()
    live = objects(spark, sf_dir).where("is_published").select("id", F.lit(1).alias("live"))
    return refs.join(live, "id", "left").groupBy("section").agg(F.count(F.lit(1)).alias("refs"), F.count("live").alias("live"), (F.count("live") == F.count(F.lit(1))).alias("valid"))


def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers within a day's quotas: four sections, six calls, two regenerations."""
    c = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("sections"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "click").alias("regenerated"))
    return c.withColumn("allowed", (F.col("sections") < 4) & (F.col("calls") < 6) & (F.col("regenerated") < 2))


QUERIES = {
    f.__name__: f
    for f in (
        publish_batch, publish_missing, clear_page, cascade_preview, cascade_rows, upsert_latest, insert_ignore, review_patch, page_replace, propose_reset, proposal_summary, status_backfill, id_remap,
        cache_valid, quota_check,
    )
}

ORACLE_SQL = {
    "publish_batch": f"""WITH {_O}, b AS (SELECT DISTINCT doc_id AS id, doc_id % 2 = 0 AS publish FROM labels)
      SELECT o.id, publish <> is_published AS changed, publish AS is_published, CASE WHEN publish = is_published THEN CASE WHEN is_published THEN '1999-01-01' END WHEN publish THEN '2024-02-01' END AS published_at FROM o JOIN b USING (id)""",
    "publish_missing": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)",
    "clear_page": f"""WITH {_O}, {_P}, l AS (SELECT page_record, count(*) AS left_n FROM o WHERE is_published GROUP BY 1)
      SELECT p.page_record, CASE WHEN status = 'running' THEN 'refused' WHEN coalesce(left_n, 0) > 0 THEN 'done' WHEN p.page_record % 3 = 0 THEN 'review' ELSE 'pending' END AS status,
        CAST(greatest(0, object_count - coalesce(left_n, 0)) AS INTEGER) AS object_count FROM p LEFT JOIN l ON l.page_record = p.page_record""",
    "cascade_preview": f"""WITH {_O}, ot AS ({OBJECT_TOPICS_SQL}), e AS ({OBJECT_ENTITIES_SQL}), v AS ({OBJECT_EVENTS_SQL})
      SELECT id, (SELECT count(*) FROM ot WHERE object_id = o.id) AS topics, (SELECT count(*) FROM e WHERE object_id = o.id) AS entities, (SELECT count(*) FROM v WHERE source_object_id = o.id) AS events FROM o""",
    "cascade_rows": f"""WITH g AS (SELECT doc_id AS id FROM documents WHERE doc_id % 29 = 0), ot AS ({OBJECT_TOPICS_SQL}), e AS ({OBJECT_ENTITIES_SQL}), v AS ({OBJECT_EVENTS_SQL})
      SELECT 'topics' AS child, count(*) AS n FROM ot WHERE object_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'entities', count(*) FROM e WHERE object_id NOT IN (SELECT id FROM g)
      UNION ALL SELECT 'events', count(*) FROM v WHERE source_object_id NOT IN (SELECT id FROM g)""",
    "upsert_latest": "SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1",
    "insert_ignore": """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events)
      SELECT user_id, day, min(event_id) AS event_id FROM e WHERE event_id % 4 <> 0 AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE event_id % 4 = 0) GROUP BY 1, 2""",
    "review_patch": f"""WITH {_O}, b AS (SELECT doc_id AS id FROM labels)
      SELECT o.id, CASE WHEN b.id IS NOT NULL AND o.id % 2 = 0 THEN CASE WHEN o.id % 4 = 0 THEN 'approved' END ELSE curation_status END AS curation_status,
        CASE WHEN b.id IS NOT NULL AND o.id % 3 = 0 THEN 'T' || o.id ELSE display_title END AS display_title FROM o LEFT JOIN b ON b.id = o.id""",
    "page_replace": """WITH n AS (SELECT o_orderkey // 8 AS page_record, -1 AS maker FROM orders WHERE o_orderkey % 80 < 3),
        a AS (SELECT l_orderkey // 8 AS page_record, l_suppkey AS maker FROM lineitem WHERE l_orderkey // 8 NOT IN (SELECT page_record FROM n) UNION ALL SELECT * FROM n)
      SELECT page_record, count(*) AS objects, min(maker)::BIGINT AS first_maker FROM a GROUP BY 1""",
    "propose_reset": f"""WITH {_P} SELECT page_record, CASE WHEN page_record % 3 = 0 THEN 'used' ELSE 'superseded' END AS draft, CASE WHEN status = 'done' THEN 'done' ELSE 'review' END AS status,
      CAST((page_record % 4 + 2) // 2 AS INTEGER) AS kept_discards, CAST(page_record % 4 + 2 AS INTEGER) AS boxes FROM p WHERE status <> 'running'""",
    "proposal_summary": """SELECT vec_id // 20 AS page, count(*) FILTER (WHERE vec_id % 10 < 6) AS kept, count(*) FILTER (WHERE vec_id % 10 BETWEEN 6 AND 7) AS moved, count(*) FILTER (WHERE vec_id % 10 > 7) AS drawn,
      count(DISTINCT label) AS groups FROM embeddings GROUP BY 1""",
    "status_backfill": f"WITH {_O} SELECT id, CASE WHEN curation_status = 'reviewed' THEN 'reviewed' ELSE 'unreviewed' END AS curation_status FROM o",
    "id_remap": f"WITH ot AS ({OBJECT_TOPICS_SQL}) SELECT object_id + 100000 AS object_id, topic_id FROM ot WHERE object_id IN (SELECT doc_id FROM documents)",
    "cache_valid": f"""WITH {_O}, r AS (SELECT DISTINCT l_suppkey AS section, l_orderkey AS id FROM lineitem)
      SELECT section, count(*) AS refs, count(o.id) AS live, count(o.id) = count(*) AS valid FROM r LEFT JOIN o ON o.id = r.id AND o.is_published GROUP BY 1""",
    "quota_check": """WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS sections, count(*) AS calls, count(*) FILTER (WHERE event_type = 'click') AS regenerated FROM events GROUP BY 1, 2)
      SELECT *, sections < 4 AND calls < 6 AND regenerated < 2 AS allowed FROM c""",
}
