"""Read models and writes that go beyond one scan: indexed search, versioned ingest, stored bitmaps, as-of and spatial joins, long folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import bitmaps, folds, grid, trigrams
from vellum.operators.asof import asof_join
from vellum.plans import ordered, texts
from vellum.sources.folders import new_folder, staged
from vellum.sources.tables import table
from vellum.sources.versions import Store
from vellum.sources.views import OBJECT_ENTITIES_SQL, OBJECT_TOPICS_SQL, OBJECTS_SQL, TOPICS_SQL, bare_objects, object_entities, object_topics, published, topics

_O, _OT = f"o AS ({OBJECTS_SQL})", f"ot AS ({OBJECT_TOPICS_SQL})"

# ── search by the postings of a query's trigrams ──────────────────────────────────────────

QUERY = 'the "src1" an'


def ranked_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked search over an index: built once, then only the query's postings and the items left are read."""
    folder = new_folder(spark, "search")
    trigrams.build_index(texts._search_items(spark, sf_dir), list(texts.WEIGHTS), folder)
    found = trigrams.indexed_items(spark, folder, texts.query_terms(QUERY))
    return texts.ranked(found, QUERY).select("id", "title", "score", "fields").orderBy(F.desc("score"), F.asc_nulls_last("title"), "id")


# ── pages replaced in several tables at once ──────────────────────────────────────────────

#: Objects on a page of the ingest.
PAGE_OBJECTS = 8

INGEST = {
    "objects": "page bigint, object_id bigint, run int, words int",
    "object_topics": "page bigint, object_id bigint, topic_id int",
    "page_ingests": "page bigint, run int, object_count bigint, status string",
}


class Interrupted(Exception):
    """An ingest that ends before it is published."""


def ingest(store: Store, objects: DataFrame, tags: DataFrame, pages: DataFrame, fail_after: str | None = None) -> None:
    """Replace the given pages by these objects (page, object_id, run, words), their tags and a row a page."""

    def written(name: str) -> None:
        if name == fail_after:
            raise Interrupted(name)

    count = objects.groupBy("page").agg(F.count(F.lit(1)).alias("object_count"))
    done = pages.join(count, "page", "left").select("page", "run", F.coalesce("object_count", F.lit(0).cast("long")).alias("object_count"), F.lit("done").alias("status"))
    children = tags.join(objects.select("page", "object_id"), "object_id").select("page", "object_id", "topic_id")
    store.replace({"objects": objects, "object_topics": children, "page_ingests": done}, pages, written)


def page_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages ingested, a third of them once more, and a fifth by a run that fails half-way: what readers see."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / PAGE_OBJECTS).alias("page"), F.col("doc_id").alias("object_id"), F.size(F.split("text", " ")).alias("words"))
    tags = object_topics(spark, sf_dir).select("object_id", "topic_id")
    store = Store(spark, new_folder(spark, "ingest"), "page", INGEST)
    for run, every, kept, fail_after in ((1, 1, F.lit(True), None), (2, 3, F.col("object_id") % 2 == 1, None), (3, 5, F.lit(True), "object_topics")):
        mine = d.where(F.col("page") % every == 0).withColumn("run", F.lit(run))
        try:
            ingest(store, mine.where(kept).select("page", "object_id", "run", "words"), tags, mine.select("page", "run").distinct(), fail_after)
        except Interrupted:
            continue
    o = store.read("objects").groupBy("page").agg(F.count(F.lit(1)).alias("objects"), F.sum("words").alias("words"))
    t = store.read("object_topics").groupBy("page").agg(F.count(F.lit(1)).alias("topics"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return store.read("page_ingests").join(o, "page", "left").join(t, "page", "left").select("page", "run", "object_count", "status", zero("objects"), zero("words"), zero("topics"), F.lit(store.version()).alias("version"))


# ── facets from stored bitmaps ────────────────────────────────────────────────────────────


def _by_issue(spark: SparkSession, sf_dir: str, bridge: DataFrame) -> DataFrame:
    shown = published(spark, sf_dir).select(F.col("id").alias("object_id"), "issue_id")
    return bridge.join(shown, "object_id")


def topic_facet_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published objects by topic, from bitmaps stored by issue."""
    stored = staged(bitmaps.id_bitmaps(_by_issue(spark, sf_dir, object_topics(spark, sf_dir)), ["issue_id", "topic_id"], "object_id"), "bitmaps")
    return bitmaps.distinct_ids(stored, ["topic_id"]).join(F.broadcast(topics(spark)), "topic_id").select("topic_id", "name", "n")  # twelve rows


def name_facet_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 names that most published objects carry, two at least, from bitmaps stored by issue."""
    keys = ["entity_id", "name", "entity_type"]
    stored = staged(bitmaps.id_bitmaps(_by_issue(spark, sf_dir, object_entities(spark, sf_dir)), ["issue_id", *keys], "object_id"), "bitmaps")
    return bitmaps.distinct_ids(stored, keys).where("n >= 2").orderBy(F.desc("n"), "name", "entity_id").limit(15)


def daily_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by day, and from each day's stored bitmaps those of the seven days up to it."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    stored = staged(bitmaps.id_bitmaps(e, ["day"], "user_id"), "bitmaps")
    week = stored.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("ahead"), "day", "bucket", "bits").select(F.date_add("day", F.col("ahead")).alias("day"), "bucket", "bits")
    daily, weekly = bitmaps.distinct_ids(stored, ["day"], "readers"), bitmaps.distinct_ids(week, ["day"], "readers_in_week")
    return daily.join(weekly, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "readers", "readers_in_week")


# ── joins without an equality that bounds them ────────────────────────────────────────────


def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event that is no purchase, with its user's latest purchase up to then."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.round("value", 6).alias("value"))
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return asof_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["event_id", "value"]).select("event_id", "asof_event_id", "asof_value")


#: Pages lie on a plane, so many in a row; boxes reach over into the pages beside theirs.
PLANE = 64
CELL = 0.25
MARGIN = 0.002


def _plane_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ordered._boxes(spark, sf_dir)
    x0, y0 = F.col("x") + F.col("page") % PLANE, F.col("y") + F.floor(F.col("page") / PLANE)
    return b.select("vec_id", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("w")).alias("x1"), (y0 + F.col("h")).alias("y1"))


_PLANE_BOXES = f"{ordered._BOXES}, pb AS (SELECT vec_id, x + page % {PLANE} AS x0, y + page // {PLANE} AS y0, x + page % {PLANE} + w AS x1, y + page // {PLANE} + h AS y1 FROM bx)"


def uncovered_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word centres that no box holds, of whatever page."""
    k = F.col("event_id")
    page = F.floor(k / 100)
    words = table(spark, sf_dir, "events").select("event_id", ((k * 37) % 1000 / 1000.0 + page % PLANE).alias("px"), ((k * 91) % 1000 / 1000.0 + F.floor(page / PLANE)).alias("py"))
    held = grid.points_in_boxes(words, _plane_boxes(spark, sf_dir).drop("vec_id"), CELL, MARGIN).select("event_id").distinct()
    return words.join(held, "event_id", "left_anti").select("event_id")


def best_overlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd box with the even box of most overlap, of whatever page; ties go to the smaller id."""
    b = _plane_boxes(spark, sf_dir)
    pairs = grid.overlapping(b.where("vec_id % 2 = 1"), b.where("vec_id % 2 = 0"), CELL)
    inter = (F.least("x1", "other_x1") - F.greatest("x0", "other_x0")) * (F.least("y1", "other_y1") - F.greatest("y0", "other_y0"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    scored = pairs.withColumn("iou", F.round(inter / (area("") + area("other_") - inter), 6))
    best = F.max(F.struct("iou", (-F.col("other_vec_id")).alias("less"))).alias("best")
    return scored.groupBy("vec_id").agg(best, F.count(F.lit(1)).alias("meets")).select("vec_id", (-F.col("best.less")).alias("other_id"), F.col("best.iou").alias("iou"), "meets")


# ── folds over one group that holds the whole table ───────────────────────────────────────


def pack_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids, packed into one budget: who fits."""
    d = bare_objects(spark, sf_dir).select(F.lit(0).alias("corpus"), "id", F.length("text").alias("n"))
    return folds.packed(d, "corpus", "id", "n", 1_000_000).select("id", (F.col("result") == 1).alias("kept"))


def chunk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids cut into chunks of 20,000 characters at most."""
    d = bare_objects(spark, sf_dir).select(F.lit(0).alias("corpus"), "id", F.length("text").alias("n"))
    return folds.chunked(d, "corpus", "id", "n", 20_000).groupBy(F.col("result").alias("chunk")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (ranked_search_indexed, page_ingest, topic_facet_bitmaps, name_facet_bitmaps, daily_readers, asof_purchase, uncovered_grid, best_overlap_grid, pack_all, chunk_all)
}

ORACLE_SQL = {
    "ranked_search_indexed": texts.ORACLE_SQL["ranked_search"],
    "page_ingest": f"""WITH {_OT}, d AS (SELECT doc_id // {PAGE_OBJECTS} AS page, doc_id AS object_id, len(string_split(text, ' ')) AS words FROM documents),
        k AS (SELECT * FROM d WHERE page % 3 <> 0 OR object_id % 2 = 1),
        t AS (SELECT page, count(*) AS topics FROM k JOIN ot USING (object_id) GROUP BY 1),
        n AS (SELECT page, count(*) AS objects, sum(words)::BIGINT AS words FROM k GROUP BY 1)
      SELECT p.page, CASE WHEN p.page % 3 = 0 THEN 2 ELSE 1 END AS run, coalesce(objects, 0) AS object_count, 'done' AS status, coalesce(objects, 0) AS objects, coalesce(words, 0) AS words,
        coalesce(topics, 0) AS topics, 2 AS version
      FROM (SELECT DISTINCT page FROM d) p LEFT JOIN n ON n.page = p.page LEFT JOIN t ON t.page = p.page""",
    "topic_facet_bitmaps": f"WITH {_O}, {_OT}, t AS ({TOPICS_SQL}) SELECT t.topic_id, t.name, count(DISTINCT o.id) AS n FROM t JOIN ot USING (topic_id) JOIN o ON o.id = ot.object_id AND o.is_published GROUP BY 1, 2",
    "name_facet_bitmaps": f"""WITH {_O}, e AS ({OBJECT_ENTITIES_SQL}) SELECT entity_id, name, entity_type, count(DISTINCT o.id) AS n FROM e JOIN o ON o.id = e.object_id AND o.is_published
      GROUP BY ALL HAVING count(DISTINCT o.id) >= 2 ORDER BY n DESC, name, entity_id LIMIT 15""",
    "daily_readers": """WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events)
      SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT e.user_id) FILTER (WHERE e.day = d.day) AS readers, count(DISTINCT e.user_id) AS readers_in_week
      FROM (SELECT DISTINCT day FROM e) d JOIN e ON e.day BETWEEN d.day - 6 AND d.day GROUP BY d.day""",
    "asof_purchase": """WITH r AS (SELECT user_id, ts, max({'event_id': event_id, 'value': round(value, 6)}) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
      SELECT l.event_id, r.v.event_id AS asof_event_id, r.v.value AS asof_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "uncovered_grid": f"""WITH {_PLANE_BOXES}, w AS (SELECT event_id, (event_id * 37) % 1000 / 1000.0::DOUBLE + event_id // 100 % {PLANE} AS px, (event_id * 91) % 1000 / 1000.0::DOUBLE + event_id // 100 // {PLANE} AS py FROM events)
      SELECT event_id FROM w WHERE NOT EXISTS (SELECT 1 FROM pb WHERE x0 <= x1 AND y0 <= y1 AND px >= x0 - {MARGIN}::DOUBLE AND px <= x1 + {MARGIN}::DOUBLE AND py >= y0 - {MARGIN}::DOUBLE AND py <= y1 + {MARGIN}::DOUBLE)""",
    "best_overlap_grid": f"""WITH {_PLANE_BOXES}, p AS (
        SELECT a.vec_id, b.vec_id AS other_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
          (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas
        FROM pb a JOIN pb b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1))
      SELECT vec_id, arg_max(other_id, (round(inter / (areas - inter), 6), -other_id)) AS other_id, max(round(inter / (areas - inter), 6)) AS iou, count(*) AS meets FROM p GROUP BY 1""",
    "pack_all": """WITH RECURSIVE d AS (SELECT doc_id AS id, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
        f AS (SELECT id, rn, n <= 1000000 AS kept, CASE WHEN n <= 1000000 THEN n ELSE 0 END AS used FROM d WHERE rn = 1
          UNION ALL SELECT d.id, d.rn, used + n <= 1000000, CASE WHEN used + n <= 1000000 THEN used + n ELSE used END FROM f JOIN d ON d.rn = f.rn + 1)
      SELECT id, kept FROM f""",
    "chunk_all": """WITH RECURSIVE d AS (SELECT doc_id AS id, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
        f AS (SELECT id, rn, n, n AS used, 0::BIGINT AS chunk FROM d WHERE rn = 1
          UNION ALL SELECT d.id, d.rn, d.n, CASE WHEN used > 0 AND used + d.n > 20000 THEN d.n ELSE used + d.n END, CASE WHEN used > 0 AND used + d.n > 20000 THEN chunk + 1 ELSE chunk END FROM f JOIN d ON d.rn = f.rn + 1)
      SELECT chunk, min(id) AS first_id, count(*) AS documents, sum(n)::BIGINT AS n FROM f GROUP BY 1""",
}
