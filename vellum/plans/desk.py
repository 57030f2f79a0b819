"""The desk's read models: run summary, clearing audit, deletion preview, folio line, usage shapes, partial answers, shelves by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans.browse import NON_PUBLICATION
from vellum.plans.texts import ORACLE_SQL as TEXT_SQL
from vellum.plans.texts import tier_router
from vellum.sources.tables import table
from vellum.sources.views import OBJECT_ENTITIES_SQL, OBJECT_EVENTS_SQL, OBJECT_TOPICS_SQL, OBJECTS_SQL, PAGES_SQL, bare_objects, object_entities, object_events, object_topics, objects, pages

_O, _P, _T, _E, _V = f"o AS ({OBJECTS_SQL})", f"p AS ({PAGES_SQL})", f"ot AS ({OBJECT_TOPICS_SQL})", f"e AS ({OBJECT_ENTITIES_SQL})", f"v AS ({OBJECT_EVENTS_SQL})"
_NON = "(" + ", ".join(f"'{c}'" for c in NON_PUBLICATION) + ")"

# ── a run as the dashboard shows it ───────────────────────────────────────────────────────

#: Columns of the summary and the classes that they count; tiers in the order shown.
CLASS_COUNTS = {"articles": "article", "ads": "advertisement", "illustrations": "illustration", "unknown_shapes": "unknown"}
TIERS = ("heavy", "light", "structured", "capture_only")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, class counts, four tiers (zero where a tier has none), review progress, events, names and topics."""
    kind, said = F.col("object_class"), lambda s: F.count_if(F.col("curation_status") == s)
    content = F.count_if(~kind.isin(*NON_PUBLICATION))
    o = bare_objects(spark, sf_dir).select("object_class", "curation_status", "confidence").agg(
        F.count(F.lit(1)).alias("objects"), content.alias("publication"), *[F.count_if(kind == c).alias(n) for n, c in CLASS_COUNTS.items()],
        said("reviewed").alias("reviewed"), said("flagged").alias("flagged"), (content - said("reviewed") - said("flagged")).alias("unreviewed"), F.count_if(F.col("confidence") < 0.6).alias("low_confidence"),
    )
    tiers = tier_router(spark, sf_dir).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    v = object_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"))
    e = object_entities(spark, sf_dir).agg(F.countDistinct("entity_id").alias("entities"))
    t = object_topics(spark, sf_dir).agg(F.countDistinct("topic_id").alias("topics"))
    one = o.withColumn("k", F.lit(1))
    for row in (tiers, v, e, t):
        one = one.join(row.withColumn("k", F.lit(1)), "k")
    return one.drop("k")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by class, most first."""
    return bare_objects(spark, sf_dir).groupBy("object_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "object_class")


# ── curators' work that clearing a page would lose ────────────────────────────────────────

#: (label one, label many, condition): fixed values of the audit.
WORK = (
    ("corrected text", "corrected texts", "text_human IS NOT NULL"),
    ("reviewed", "reviewed", "(reviewed_at IS NOT NULL OR curation_status <> 'unreviewed')"),
    ("review note", "review notes", "review_note IS NOT NULL"),
    ("title", "titles", "display_title_at IS NOT NULL"),
    ("published", "published", "is_published"),
    ("accepted re-read", "accepted re-reads", "text_reread_model IS NOT NULL"),
    ("replaced summary", "replaced summaries", "summary_at IS NOT NULL"),
    ("region corrected by hand", "regions corrected by hand", "get_json_object(region_bbox, '$.editedAt') IS NOT NULL"),
)

#: Objects on a page of the desk.
PAGE = 8


def desk_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with the marks of curators' work."""
    i = F.col("id")
    mark = lambda every, text: F.when(i % every == 0, text)
    region = F.when(i % 3 == 1, '{"boxes":[[0,0,1,1]],"editedAt":"2024-01-02"}').when(i % 3 == 2, "[[0,0,1,1]]")
    return objects(spark, sf_dir).select(
        F.floor(i / PAGE).alias("page"), "id", "text_human", "curation_status", "is_published", mark(6, "2024").alias("reviewed_at"), mark(19, "note").alias("review_note"),
        mark(13, "2024").alias("display_title_at"), mark(23, "m1").alias("text_reread_model"), mark(31, "2024").alias("summary_at"), region.alias("region_bbox"),
    )


def clear_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clearing each page would lose, one row a kind of work; kinds without any are left out."""
    counted = desk_objects(spark, sf_dir).groupBy("page").agg(*[F.count_if(F.expr(c)).alias(f"n{k}") for k, (*_, c) in enumerate(WORK)])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"n{k}").alias("n"), F.when(F.col(f"n{k}") == 1, one).otherwise(many).alias("label")) for k, (one, many, _) in enumerate(WORK)]))
    return counted.select("page", rows).where("n > 0")


# ── what the deletion of an object takes with it ──────────────────────────────────────────


def _children(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six child tables by (id): topics, names, proposed topics, events, provenance, edits."""
    li = table(spark, sf_dir, "lineitem")
    return {
        "topics": object_topics(spark, sf_dir).select(F.col("object_id").alias("id")),
        "entities": object_entities(spark, sf_dir).select(F.col("object_id").alias("id")),
        "proposed_topics": li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")),
        "events": object_events(spark, sf_dir).select(F.col("source_object_id").alias("id")),
        "provenance": li.select(F.col("l_orderkey").alias("id")),
        "edits": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")),
    }


_CHILDREN_SQL = f"""{_T}, {_E}, {_V}, c AS (SELECT 'topics' AS child, object_id AS id FROM ot UNION ALL SELECT 'entities', object_id FROM e UNION ALL SELECT 'proposed_topics', l_orderkey FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'events', source_object_id FROM v UNION ALL SELECT 'provenance', l_orderkey FROM lineitem UNION ALL SELECT 'edits', conv_id FROM conversations)"""

#: Counts that the preview names.
PREVIEW = ("topics", "entities", "proposed_topics", "events", "provenance")


def deletion_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each object's deletion would take, with the first 120 characters of its text as read."""
    o = objects(spark, sf_dir).select("id", "object_class", "is_published", F.substring(F.coalesce("text_human", "text"), 1, 120).alias("preview"))
    children = _children(spark, sf_dir)
    for name in PREVIEW:
        n = children[name].groupBy("id").agg(F.count(F.lit(1)).alias(name))
        o = o.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return o


def deletion_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After every advertorial is deleted: the rows left and lost in each of six child tables."""
    gone = bare_objects(spark, sf_dir).where("is_advertorial").select("id", F.lit(True).alias("gone"))
    out = None
    for name, df in _children(spark, sf_dir).items():
        one = df.join(gone, "id", "left").agg(F.count_if(F.col("gone").isNull()).alias("left"), F.count("gone").alias("lost")).select(F.lit(name).alias("child"), "left", "lost")
        out = one if out is None else out.unionAll(one)
    return out


def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's count of objects once every advertorial is deleted: never below zero."""
    gone = bare_objects(spark, sf_dir).where("is_advertorial").groupBy("page_record").agg(F.count(F.lit(1)).cast("int").alias("deleted"))
    p = pages(spark, sf_dir).select("page_record", "object_count").join(gone, "page_record", "left")
    return p.select("page_record", F.greatest(F.lit(0), F.col("object_count") - F.coalesce("deleted", F.lit(0))).alias("object_count"))


# ── the folio line ────────────────────────────────────────────────────────────────────────


def folio_text(title: Column, sort_date: Column, date_label: Column, page: Column, page_count: Column) -> Column:
    """VOL. n · NO. n · WEEKDAY, MONTH D, YYYY · PAGE x OF y; what the title or the date doesn't state is left out or stands as given."""
    number = lambda word: F.nullif(F.regexp_extract(title, rf"(?i){word}\s+(\d+)", 1), F.lit(""))
    day = F.when(sort_date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.upper(F.date_format(F.try_to_date(sort_date, "yyyy-MM-dd"), "EEEE, MMMM d, yyyy")))
    return F.concat_ws(" · ", F.concat(F.lit("VOL. "), number("Volume")), F.concat(F.lit("NO. "), number("Issue")), F.nullif(F.coalesce(day, F.upper(date_label)), F.lit("")), F.format_string("PAGE %d OF %d", page, page_count))


def folio_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folio of every numbered page of a catalogued issue."""
    k = F.col("c_custkey")
    title = F.concat_ws(", ", "c_name", F.when(k % 3 != 0, F.concat(F.when(k % 2 == 0, "VOLUME ").otherwise("Volume  "), k % 30 + 1)), F.when(k % 4 != 0, F.concat(F.lit("Issue "), k % 12 + 1)), F.when(k % 5 == 0, "[Numbered Volume 99]"))
    date = F.when(k % 10 == 0, "").when(k % 7 == 0, F.concat(F.lit("19"), k % 40 + 10)).otherwise(F.format_string("19%02d-%02d-%02d", k % 40 + 10, k % 12 + 1, k % 28 + 1))
    issue = table(spark, sf_dir, "customer").select(k.alias("issue_pointer"), title.alias("title"), date.alias("sort_date"), F.when(k % 10 == 0, "undated").when(k % 7 == 0, F.concat(F.lit("about 19"), k % 40 + 10)).otherwise("").alias("date_label"))
    p = pages(spark, sf_dir).where("page_number IS NOT NULL").select("page_record", "issue_pointer", "page_number")
    return p.join(issue, "issue_pointer").select("page_record", folio_text(F.col("title"), F.col("sort_date"), F.col("date_label"), F.col("page_number"), F.lit(8)).alias("folio"))


# ── usage in the shapes of the services called ────────────────────────────────────────────


def normal_usage(usage: Column, provider: Column) -> list[Column]:
    """input, output, cache_write, cache_read of a usage object; what is absent or no number is 0.

    `messages` counts cached input apart; `content` counts it within the prompt, and thoughts apart
    from candidates; `completion` counts it within the prompt, without a floor; `audio` reports no tokens.
    """
    of = lambda name: F.coalesce(F.expr(f"try_cast(get_json_object(usage, '$.{name}') AS BIGINT)"), F.lit(0).cast("long"))
    zero, inner = F.lit(0).cast("long"), of("prompt_tokens_details.cached_tokens")
    messages, content, completion, cached = provider == "messages", provider == "content", provider == "completion", of("cachedContentTokenCount")
    return [
        F.when(messages, of("input_tokens")).when(content, F.greatest(zero, of("promptTokenCount") - cached)).when(completion, of("prompt_tokens") - inner).otherwise(zero).alias("input"),
        F.when(messages, of("output_tokens")).when(content, of("candidatesTokenCount") + of("thoughtsTokenCount")).when(completion, of("completion_tokens")).otherwise(zero).alias("output"),
        F.when(messages, of("cache_creation_input_tokens")).otherwise(zero).alias("cache_write"),
        F.when(messages, of("cache_read_input_tokens")).when(content, cached).when(completion, inner).otherwise(zero).alias("cache_read"),
    ]


def usage_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call's usage, read in its service's shape."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")).alias("k"))
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    usage = (
        F.when(i % 4 == 0, text('{"input_tokens":', F.col("k"), ',"output_tokens":', u, ',"cache_read_input_tokens":', F.when(i % 8 == 0, (u % 9).cast("string")).otherwise("null"), "}"))
        .when(i % 4 == 1, text('{"promptTokenCount":', F.col("k"), ',"cachedContentTokenCount":', u, ',"candidatesTokenCount":"', u % 7, '"', F.when(i % 8 == 1, ',"thoughtsTokenCount":5').otherwise(""), "}"))
        .when(i % 4 == 2, text('{"prompt_tokens":', F.col("k"), ',"completion_tokens":', u, F.when(i % 8 == 2, text(',"prompt_tokens_details":{"cached_tokens":', u % 11, "}")).otherwise(""), "}"))
        .when(i % 8 == 3, "{}")
    )
    provider = F.when(i % 4 == 0, "messages").when(i % 4 == 1, "content").when(i % 4 == 2, "completion").otherwise("audio")
    return e.select("event_id", usage.alias("usage"), provider.alias("provider")).select("event_id", "provider", *normal_usage(F.col("usage"), F.col("provider")))


# ── fields of an answer that is still being written ───────────────────────────────────────


def partial_field(raw: Column, name: str) -> Column:
    """A string field of JSON that may be cut off within it; null before it begins."""
    held = F.regexp_extract(raw, rf'"{name}"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*)', 1)
    begun = F.regexp_extract(raw, rf'"{name}"\s*:\s*"', 0) != ""
    whole = F.get_json_object(F.concat(F.lit('{"v":"'), held, F.lit('"}')), "$.v")
    return F.when(begun, F.coalesce(whole, held))


def partial_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut off at odd places: what of headline and body can be shown by then."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("headline"), F.col("text").alias("body"))).alias("json"))
    cut = F.floor(F.length("json") * ((F.col("conv_id") * 7 + F.col("turn") * 13) % 101) / 100).cast("int")
    raw = c.select("conv_id", "turn", F.substring("json", F.lit(1), cut).alias("raw"))
    return raw.select("conv_id", "turn", partial_field(F.col("raw"), "headline").alias("headline"), partial_field(F.col("raw"), "body").alias("body"))


# ── prices in texts, shelves by page ──────────────────────────────────────────────────────

#: Ways in which a notice may print its price, and ways that are none.
_PRINTED = ("$ {0}", "{0}c", "{0} cents", "{0}¢", "{0}cent", "a{0}c", "{0}cm", "{0} centers")


def price_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose notice prints a price."""
    forms = F.array(*[F.concat(F.lit(f.split("{0}")[0]), F.col("p_size").cast("string"), F.lit(f.split("{0}")[1])) for f in _PRINTED])
    notice = F.concat_ws(" ", "p_name", F.get(forms, (F.col("p_partkey") % len(_PRINTED)).cast("int")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", notice.rlike(T.SAYS_PRICE).alias("priced"))


def shelf_of_forty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue's published objects by pages of forty: page, its first object, and how many show once it is opened."""
    w = Window.partitionBy("issue_id").orderBy("id")  # an issue has a bounded number of objects
    n = objects(spark, sf_dir).where("is_published").select("issue_id", "id", F.row_number().over(w).alias("place"))
    g = n.groupBy("issue_id", F.floor((F.col("place") - 1) / 40).alias("page")).agg(F.min("id").alias("first_id"), F.max("place").cast("long").alias("shown"))
    return g.select("issue_id", F.col("page") + 1, "first_id", "shown").toDF("issue_id", "page", "first_id", "shown")


QUERIES = {
    f.__name__: f
    for f in (run_summary, class_counts, clear_audit, deletion_preview, deletion_effect, page_counters, folio_line, usage_shapes, partial_answers, price_mentions, shelf_of_forty)
}

_MARKS = "id % 6 = 0 AS reviewed_at, id % 19 = 0 AS review_note, id % 13 = 0 AS title_at, id % 23 = 0 AS reread, id % 31 = 0 AS summary_at, id % 3 = 1 AS edited"
_WORK_SQL = ("text_human IS NOT NULL", "(reviewed_at OR curation_status <> 'unreviewed')", "review_note", "title_at", "is_published", "reread", "summary_at", "edited")
_FIELD = lambda name: rf"""CASE WHEN regexp_matches(raw, '"{name}"\s*:\s*"') THEN regexp_extract(raw, '"{name}"\s*:\s*"((?:[^"\\]|\\.)*)', 1) END"""
_SHOWN = lambda x: f"""CASE WHEN json_valid('{{"v":"' || {x} || '"}}') THEN json_extract_string('{{"v":"' || {x} || '"}}', '$.v') ELSE {x} END"""

ORACLE_SQL = {
    "run_summary": f"""WITH {_O}, {_E}, {_T}, t AS ({TEXT_SQL["tier_router"]}),
        s AS (SELECT count(*) AS objects, count(*) FILTER (WHERE object_class NOT IN {_NON}) AS publication, {", ".join(f"count(*) FILTER (WHERE object_class = '{c}') AS {n}" for n, c in CLASS_COUNTS.items())},
          count(*) FILTER (WHERE curation_status = 'reviewed') AS reviewed, count(*) FILTER (WHERE curation_status = 'flagged') AS flagged, count(*) FILTER (WHERE confidence < 0.6) AS low_confidence FROM o)
      SELECT s.*, publication - reviewed - flagged AS unreviewed, {", ".join(f"(SELECT count(*) FROM t WHERE tier = '{t}') AS {t}" for t in TIERS)},
        (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT entity_id) FROM e) AS entities, (SELECT count(DISTINCT topic_id) FROM ot) AS topics FROM s""",
    "class_counts": f"WITH {_O} SELECT object_class, count(*) AS n FROM o GROUP BY 1",
    "clear_audit": f"""WITH {_O}, d AS (SELECT id // {PAGE} AS page, text_human, curation_status, is_published, {_MARKS} FROM o),
        w AS ({" UNION ALL ".join(f"SELECT page, {k} AS place, count(*) AS n, '{one}' AS one, '{many}' AS many FROM d WHERE {c} GROUP BY 1" for k, ((one, many, _), c) in enumerate(zip(WORK, _WORK_SQL, strict=True)))})
      SELECT page, place, n, CASE WHEN n = 1 THEN one ELSE many END AS label FROM w""",
    "deletion_preview": f"""WITH {_O}, {_CHILDREN_SQL}, g AS (SELECT id, {", ".join(f"count(*) FILTER (WHERE child = '{n}') AS {n}" for n in PREVIEW)} FROM c GROUP BY 1)
      SELECT o.id, object_class, is_published, left(coalesce(text_human, text), 120) AS preview, {", ".join(f"coalesce(g.{n}, 0) AS {n}" for n in PREVIEW)} FROM o LEFT JOIN g ON g.id = o.id""",
    "deletion_effect": f"""WITH {_CHILDREN_SQL} SELECT child, count(*) FILTER (WHERE d.doc_id IS NULL) AS left, count(d.doc_id) AS lost
      FROM c LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 29 = 0) d ON d.doc_id = c.id GROUP BY 1""",
    "page_counters": f"""WITH {_P} SELECT page_record, CAST(greatest(0, object_count - (SELECT count(*) FROM documents d WHERE d.doc_id = p.page_record AND d.doc_id % 29 = 0)) AS INTEGER) AS object_count FROM p""",
    "folio_line": rf"""WITH {_P}, i AS (SELECT c_custkey AS k, c_name || CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN ', VOLUME ' ELSE ', Volume  ' END || (c_custkey % 30 + 1) ELSE '' END
          || CASE WHEN c_custkey % 4 <> 0 THEN ', Issue ' || (c_custkey % 12 + 1) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ', [Numbered Volume 99]' ELSE '' END AS title,
          CASE WHEN c_custkey % 10 = 0 THEN 'UNDATED' WHEN c_custkey % 7 = 0 THEN 'ABOUT 19' || (c_custkey % 40 + 10) ELSE
            upper(strftime(make_date(1910 + c_custkey % 40, c_custkey % 12 + 1, c_custkey % 28 + 1), '%A, %B %-d, %Y')) END AS day FROM customer)
      SELECT page_record, concat_ws(' · ', 'VOL. ' || nullif(regexp_extract(title, '(?i)volume\s+(\d+)', 1), ''), 'NO. ' || nullif(regexp_extract(title, '(?i)issue\s+(\d+)', 1), ''), day, 'PAGE ' || page_number || ' OF 8') AS folio
      FROM p JOIN i ON i.k = p.issue_pointer WHERE page_number IS NOT NULL""",
    "usage_shapes": f"""WITH e AS (SELECT event_id AS i, user_id AS u, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
      SELECT i AS event_id, CASE i % 4 WHEN 0 THEN 'messages' WHEN 1 THEN 'content' WHEN 2 THEN 'completion' ELSE 'audio' END AS provider,
        CASE i % 4 WHEN 0 THEN k WHEN 1 THEN greatest(0, k - u) WHEN 2 THEN k - CASE WHEN i % 8 = 2 THEN u % 11 ELSE 0 END ELSE 0 END AS input,
        CASE i % 4 WHEN 0 THEN u WHEN 1 THEN u % 7 + CASE WHEN i % 8 = 1 THEN 5 ELSE 0 END WHEN 2 THEN u ELSE 0 END AS output, 0::BIGINT AS cache_write,
        CASE i % 4 WHEN 0 THEN CASE WHEN i % 8 = 0 THEN u % 9 ELSE 0 END WHEN 1 THEN u WHEN 2 THEN CASE WHEN i % 8 = 2 THEN u % 11 ELSE 0 END ELSE 0 END AS cache_read FROM e""",
    "partial_answers": rf"""WITH j AS (SELECT conv_id, turn, json_object('headline', role, 'body', text)::VARCHAR AS json FROM conversations),
        r AS (SELECT conv_id, turn, left(json, CAST(floor(length(json) * ((conv_id * 7 + turn * 13) % 101) / 100.0) AS INTEGER)) AS raw FROM j),
        f AS (SELECT conv_id, turn, {_FIELD("headline")} AS h, {_FIELD("body")} AS b FROM r)
      SELECT conv_id, turn, {_SHOWN("h")} AS headline, {_SHOWN("b")} AS body FROM f""",
    "price_mentions": f"""SELECT p_partkey, regexp_matches(p_name || ' ' || CASE p_partkey % {len(_PRINTED)} {" ".join(f"WHEN {k} THEN '" + f.split("{0}")[0] + "' || p_size || '" + f.split("{0}")[1] + "'" for k, f in enumerate(_PRINTED))} END || ' ' || p_type, '{T.SAYS_PRICE_RE2}') AS priced FROM part""",
    "shelf_of_forty": f"""WITH {_O}, n AS (SELECT issue_id, id, row_number() OVER (PARTITION BY issue_id ORDER BY id) AS place FROM o WHERE is_published)
      SELECT issue_id, (place - 1) // 40 + 1 AS page, min(id) AS first_id, max(place) AS shown FROM n GROUP BY 1, 2""",
}
