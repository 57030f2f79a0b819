"""The remaining read models: rights, event index, issue corpus, stored regions, topic cards, round two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.plans.browse import ORACLE_SQL as BROWSE_SQL
from vellum.plans.browse import RIGHTS_SQL, rights_status, type_facet
from vellum.plans.edition import _DEAL, _DEALT, _F, _dealing, _features, dealt
from vellum.plans.ordered import _BOXES, _boxes, pack
from vellum.sources.views import ISSUES_SQL, OBJECT_EVENTS_SQL, OBJECTS_SQL, PAGES_SQL, bare_objects, issues, object_events, pages, published

_O, _P, _I, _V = f"o AS ({OBJECTS_SQL})", f"p AS ({PAGES_SQL})", f"i AS ({ISSUES_SQL})", f"v AS ({OBJECT_EVENTS_SQL})"


def rights_label(uri: Column) -> Column:
    """What a rights statement says, in words."""
    short = F.regexp_replace(F.regexp_replace(uri, r"^https?://[^/]+/(vocab/)?", ""), r"/1\.0/?$", "")
    status = rights_status(uri)
    return (
        F.when((status == "in_copyright") & (short != "InC") & F.startswith(short, F.lit("InC")), F.concat(F.lit("In Copyright ("), short, F.lit(")")))
        .when(status == "in_copyright", "In Copyright")
        .when((status == "open") & F.startswith(short, F.lit("NoC")), F.concat(F.lit("No Copyright ("), short, F.lit(")")))
        .when(status == "open", "Public Domain")
        .when(uri.rlike("(?i)/CNE"), "Copyright Not Evaluated")
        .when(uri == "", "Rights unspecified")
        .otherwise("Rights not evaluated")
    )


def rights_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).select("pointer", rights_status(F.col("rights_uri")).alias("status"), rights_label(F.col("rights_uri")).alias("label"))


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of published objects with page, issue and a phrase for their source."""
    o = published(spark, sf_dir).select(F.col("id").alias("source_object_id"), "object_class", "page_record")
    e = object_events(spark, sf_dir).join(o, "source_object_id").join(pages(spark, sf_dir).select("page_record", "issue_pointer", "page_number"), "page_record", "left")
    j = e.join(issues(spark, sf_dir).select(F.col("pointer").alias("issue_pointer"), "serial"), "issue_pointer", "left")
    phrase = F.when(F.col("object_class") == "article", "ARTICLES").when(F.col("object_class") == "advertisement", "PERIOD ADVERTISING").when(F.col("object_class").isin("listing", "classified_section"), "LISTINGS").otherwise("ARTICLES & ADVERTISING")
    return j.select(F.concat(F.lit("ev-"), "event_id").alias("id"), "event_type", "start_text", F.coalesce("page_number", F.lit(1)).alias("page"), "serial", phrase.alias("source_phrase"))


def issue_corpus(spark: SparkSession, sf_dir: str, cap: int = 60_000) -> DataFrame:
    """An issue's published objects as text blocks, packed into a budget: sizes, ids and the header.

    An issue has some hundreds of objects, whose blocks are capped at 6,000 characters each.
    """
    o = published(spark, sf_dir)
    body = F.substring(T.strip(F.regexp_replace(F.coalesce("text_human", "text"), r"[ \t]+\n", "\n")), 1, 6000)
    head = F.concat(F.lit("[[co-"), "id", F.lit("]] p."), (F.col("id") % 8).cast("string"), F.lit(" · "), "object_class", F.lit(" ("), "role", F.lit(")"))
    block = F.concat_ws("\n", head, F.concat(F.lit("TITLE: "), "display_title"), F.concat(F.lit("TEXT: "), body))
    b = o.select("issue_id", F.struct((F.col("seq") * 100_000_000 + F.col("id")).alias("pos"), "id", F.length(block).cast("long").alias("n")).alias("b"))
    p = b.groupBy("issue_id").agg(F.collect_list("b").alias("blocks"), F.count(F.lit(1)).alias("published")).withColumn("p", pack(F.col("blocks"), cap))
    return p.select("issue_id", "published", "p.used", "p.skipped", F.array_join("p.kept", ",").alias("ids"), F.format_string("PUBLISHED ITEMS IN THIS CONTEXT: %d", F.size("p.kept")).alias("coverage"))


def enriched_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with a page in the store: children to parents, each once."""
    have = bare_objects(spark, sf_dir).select("page_record").distinct()
    return pages(spark, sf_dir).where("issue_pointer IS NOT NULL").join(have, "page_record", "left_semi").select("issue_pointer").distinct()


def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over an issue's read pages, folded over its nested pages."""
    p = pages(spark, sf_dir).where("issue_pointer IS NOT NULL").groupBy("issue_pointer").agg(F.collect_list(F.struct("status", "object_count")).alias("pages"))
    read = F.filter("pages", lambda x: x["status"] == "done")
    return p.select("issue_pointer", F.size("pages").alias("pages"), F.size(read).alias("read"), F.aggregate(read, F.lit(0), lambda a, x: a + x["object_count"]).alias("objects"))


def selection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facet labels in display order, and whether the visual mode is on."""
    chosen = type_facet(spark, sf_dir).where(F.col("value").isin("v-all", "y-map", "y-ad", "y-unknown"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: F.upper(x["value"]))
    return chosen.agg(F.array_join(labels, ", ").alias("labels"), F.max(F.startswith("value", F.lit("v-"))).alias("visual"), F.count(F.lit(1)).alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as stored: bare rectangles, objects with rectangles, some edited, some malformed."""
    b = _boxes(spark, sf_dir)
    n = lambda c: F.format_string("%.4f", c)
    one = F.concat(F.lit("["), F.concat_ws(",", n("x"), n("y"), n("w"), n("h")), F.lit("]"))
    edited = F.when(F.col("vec_id") % 4 == 1, ',"editedAt":"2024"').otherwise("")
    obj = F.concat(F.lit('{"rects":['), one, F.lit(",[0.1,0.1,0.2,0.2],[2,0,1,1]],\"order\":[1,0,2]"), edited, F.lit("}"))
    return b.select("vec_id", "x", "y", "w", "h", F.when(F.col("vec_id") % 2 == 0, one).otherwise(obj).alias("region"))


def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of stored regions as one: usable rectangles and their area; and which ones a curator edited."""
    r = _stored(spark, sf_dir).withColumn("rects", G.normal_region(G.stored_rects(F.col("region"))))
    area = F.aggregate("rects", F.lit(0.0), lambda a, x: a + G.area(x))
    return r.select("vec_id", F.coalesce(F.size("rects"), F.lit(0)).alias("n"), F.round(F.coalesce(area, F.lit(0.0)), 6).alias("area"), F.get_json_object("region", "$.editedAt").isNotNull().alias("edited"))


def reading_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges of a page's rectangles in reading order: stored order where valid, else by bands."""
    b = _boxes(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list("rect")).alias("rects"))
    order = F.when(F.col("page") % 2 == 0, F.reverse(F.sequence(F.lit(0), F.size("rects") - 1))).otherwise(F.array(F.lit(0)))
    return b.select("page", F.array_join(F.transform(G.reading_rects(F.col("rects"), order), lambda r: F.format_string("%.4f", F.get(r, F.lit(0)))), ",").alias("lefts"))


def region_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curators' regions as they would be stored: largest first, NULL where one lies off the page."""
    b = _boxes(spark, sf_dir)
    r = b.select("vec_id", G.edited_region(F.array(F.array((F.col("x") / 2), (F.col("y") / 2), F.col("w") / 4 + 0.001, F.col("h") / 4 + 0.001), F.array(F.col("x"), F.lit(0.0), F.lit(0.5), F.lit(0.5)))).alias("rects"))
    return r.select("vec_id", F.col("rects").isNotNull().alias("fit"), F.round(F.coalesce(G.area(F.get("rects", F.lit(0))), F.lit(0.0)), 6).alias("first_area"))


def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector pixels as page coordinates."""
    return _boxes(spark, sf_dir).select("vec_id", G.from_letterbox(F.col("x") * 1280, 16.0, 0.2, 5332.0).alias("x"), G.from_letterbox(F.col("y") * 1280, 0.0, 0.187, 6845.0).alias("y"))


def topic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card to open each topic of an issue (three objects), and one to go deeper into it (one)."""
    t = _features(spark, sf_dir).select("issue_id", "id", F.explode("topics").alias("topic")).groupBy("issue_id", "topic").agg(F.countDistinct("id").alias("n"))
    slug = T.slug(F.col("topic"), spaced_and=False)
    kinds = F.explode(F.array(F.struct(F.lit("topic:").alias("kind"), F.lit(3).alias("least")), F.struct(F.lit("more:").alias("kind"), F.lit(1).alias("least"))))
    return t.select("issue_id", "topic", "n", kinds.alias("k")).where(F.col("n") >= F.col("k.least")).select("issue_id", F.concat("k.kind", slug).alias("card"), "n")


def deal_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round two: deeper into the topic that the last section cited most, a topic not yet covered, then the best of the rest."""
    f = _features(spark, sf_dir).select("issue_id", "id", F.explode("topics").alias("topic"))
    cited = f.where("id % 6 = 0").groupBy("issue_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen"))
    deep = cited.withColumn("rn", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("n"), "seen", "topic"))).where("rn = 1").select("issue_id", "topic")
    fresh = f.where("id % 4 <> 0").groupBy("issue_id", "topic").agg(F.countDistinct("id").alias("fresh"))
    every = f.groupBy("issue_id", "topic").agg(F.countDistinct("id").alias("n"))
    side = every.where("n >= 3").join(fresh, ["issue_id", "topic"]).join(cited.select("issue_id", "topic"), ["issue_id", "topic"], "left_anti")
    side = side.withColumn("rn", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("fresh"), T.slug(F.col("topic"), spaced_and=False)))).where("rn = 1")
    name = lambda kind: F.concat(F.lit(kind), T.slug(F.col("topic"), spaced_and=False)).alias("card")
    lead = deep.join(fresh, ["issue_id", "topic"]).select("issue_id", name("more:"), "fresh", F.lit(0).alias("for_role"), F.lit(0).alias("lead"))
    lead = lead.unionByName(side.select("issue_id", name("topic:"), "fresh", F.lit(0).alias("for_role"), F.lit(1).alias("lead")))
    rest = _dealing(spark, sf_dir).select("issue_id", "card", "fresh", "for_role", F.lit(2).alias("lead"))
    return dealt(lead.unionByName(rest), [F.asc("lead")])


QUERIES = {f.__name__: f for f in (rights_labels, event_index, issue_corpus, enriched_issues, book_totals, selection_labels, region_shapes, reading_rects, region_edit, letterbox, topic_cards, deal_r2)}

_SLUG = "regexp_replace(regexp_replace(replace(lower(topic), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_TOPIC_ROWS = "u AS (SELECT issue_id, id, unnest(topics) AS topic FROM f)"
_ST = RIGHTS_SQL.format("rights_uri")

ORACLE_SQL = {
    "rights_labels": rf"""WITH {_I}, s AS (SELECT pointer, rights_uri AS u, {_ST} AS status, regexp_replace(regexp_replace(rights_uri, '^https?://[^/]+/(vocab/)?', ''), '/1\.0/?$', '') AS short FROM i)
      SELECT pointer, status, CASE WHEN status = 'in_copyright' AND short <> 'InC' AND starts_with(short, 'InC') THEN 'In Copyright (' || short || ')' WHEN status = 'in_copyright' THEN 'In Copyright'
        WHEN status = 'open' AND starts_with(short, 'NoC') THEN 'No Copyright (' || short || ')' WHEN status = 'open' THEN 'Public Domain' WHEN contains(u, '/CNE') THEN 'Copyright Not Evaluated'
        WHEN u = '' THEN 'Rights unspecified' ELSE 'Rights not evaluated' END AS label FROM s""",
    "event_index": f"""WITH {_O}, {_P}, {_I}, {_V} SELECT 'ev-' || event_id AS id, event_type, start_text, coalesce(p.page_number, 1) AS page, i.serial,
        CASE WHEN object_class = 'article' THEN 'ARTICLES' WHEN object_class = 'advertisement' THEN 'PERIOD ADVERTISING' WHEN object_class IN ('listing', 'classified_section') THEN 'LISTINGS' ELSE 'ARTICLES & ADVERTISING' END AS source_phrase
      FROM v JOIN o ON o.id = v.source_object_id AND o.is_published LEFT JOIN p ON p.page_record = o.page_record LEFT JOIN i ON i.pointer = p.issue_pointer""",
    "issue_corpus": rf"""WITH {_O}, b AS (SELECT issue_id, id, seq, length('[[co-' || id || ']] p.' || (id % 8) || ' · ' || object_class || ' (' || role || ')' || coalesce(chr(10) || 'TITLE: ' || display_title, '') || chr(10) || 'TEXT: '
          || left(regexp_replace(regexp_replace(coalesce(text_human, text), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g'), 6000)) AS n FROM o WHERE is_published),
        g AS (SELECT issue_id, count(*) AS published, list({{'id': id, 'n': n}} ORDER BY seq, id) AS bs FROM b GROUP BY 1),
        p AS (SELECT issue_id, published, list_reduce(list_prepend({{'used': 0::BIGINT, 'ids': []::BIGINT[], 'skipped': 0, 'id': 0::BIGINT, 'n': 0::BIGINT}},
              list_transform(bs, lambda b: {{'used': 0::BIGINT, 'ids': []::BIGINT[], 'skipped': 0, 'id': b.id, 'n': b.n::BIGINT}})),
            lambda a, b: {{'used': CASE WHEN a.used + b.n <= 60000 THEN a.used + b.n ELSE a.used END, 'ids': CASE WHEN a.used + b.n <= 60000 THEN list_append(a.ids, b.id) ELSE a.ids END,
              'skipped': CASE WHEN a.used + b.n <= 60000 THEN a.skipped ELSE a.skipped + 1 END, 'id': 0::BIGINT, 'n': 0::BIGINT}}) AS r FROM g)
      SELECT issue_id, published, r.used AS used, r.skipped AS skipped, array_to_string(r.ids, ',') AS ids, 'PUBLISHED ITEMS IN THIS CONTEXT: ' || len(r.ids) AS coverage FROM p""",
    "enriched_issues": f"WITH {_P} SELECT DISTINCT issue_pointer FROM p WHERE issue_pointer IS NOT NULL AND page_record IN (SELECT doc_id FROM documents)",
    "book_totals": f"""WITH {_P} SELECT issue_pointer, CAST(count(*) AS INTEGER) AS pages, CAST(count(*) FILTER (WHERE status = 'done') AS INTEGER) AS "read",
      CAST(coalesce(sum(object_count) FILTER (WHERE status = 'done'), 0) AS INTEGER) AS objects FROM p WHERE issue_pointer IS NOT NULL GROUP BY 1""",
    "selection_labels": f"""WITH f AS ({BROWSE_SQL["type_facet"]})
      SELECT string_agg(upper(value), ', ' ORDER BY position) AS labels, bool_or(starts_with(value, 'v-')) AS visual, count(*) AS n FROM f WHERE value IN ('v-all', 'y-map', 'y-ad', 'y-unknown')""",
    "region_shapes": f"""WITH {_BOXES}, c AS (SELECT vec_id, w > 0 AND h > 0 AS ok, least(w, 1 - x) * least(h, 1 - y) AS a FROM bx)
      SELECT vec_id, CAST(ok::INTEGER + CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n, round(CASE WHEN ok THEN a ELSE 0 END + CASE WHEN vec_id % 2 = 1 THEN 0.2::DOUBLE * 0.2::DOUBLE ELSE 0 END, 6) AS area, vec_id % 4 = 1 AS edited FROM c""",
    "reading_rects": f"""WITH RECURSIVE {_BOXES}, q AS (SELECT page, x, y, row_number() OVER (PARTITION BY page ORDER BY x, y, w, h) AS rn FROM bx),
        f AS (SELECT page, x, y, rn, x AS lft, 0 AS band FROM q WHERE rn = 1
          UNION ALL SELECT q.page, q.x, q.y, q.rn, CASE WHEN q.x - f.lft > 0.02 THEN q.x ELSE f.lft END, CASE WHEN q.x - f.lft > 0.02 THEN f.band + 1 ELSE f.band END FROM f JOIN q ON q.page = f.page AND q.rn = f.rn + 1)
      SELECT page, CASE WHEN page % 2 = 0 THEN string_agg(printf('%.4f', x), ',' ORDER BY rn DESC) ELSE string_agg(printf('%.4f', x), ',' ORDER BY band, y, rn) END AS lefts FROM f GROUP BY page""",
    "region_edit": f"""WITH {_BOXES}, r AS (SELECT vec_id, x + 0.5 <= 1.001 AS fit, (floor((w / 4 + 0.001) * 1e4 + 0.5) / 1e4) * (floor((h / 4 + 0.001) * 1e4 + 0.5) / 1e4) AS a FROM bx)
      SELECT vec_id, fit, round(CASE WHEN fit THEN greatest(a, 0.25) ELSE 0.0 END, 6)::DOUBLE AS first_area FROM r""",
    "letterbox": f"""WITH {_BOXES} SELECT vec_id, floor(least(greatest((x * 1280 - 16.0) / 0.2::DOUBLE / 5332.0, 0.0), 1.0) * 1e4 + 0.5) / 1e4 AS x, floor(least(greatest((y * 1280) / 0.187::DOUBLE / 6845.0, 0.0), 1.0) * 1e4 + 0.5) / 1e4 AS y FROM bx""",
    "topic_cards": f"""WITH {_F}, {_TOPIC_ROWS}, g AS (SELECT issue_id, topic, count(DISTINCT id) AS n FROM u GROUP BY 1, 2)
      SELECT issue_id, 'topic:' || {_SLUG} AS card, n FROM g WHERE n >= 3 UNION ALL SELECT issue_id, 'more:' || {_SLUG}, n FROM g""",
    "deal_r2": f"""{_DEAL}, {_TOPIC_ROWS}, ci AS (SELECT issue_id, topic, count(*) AS n, min(id) AS seen FROM u WHERE id % 6 = 0 GROUP BY 1, 2),
        dp AS (SELECT issue_id, topic FROM ci QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY n DESC, seen, topic) = 1),
        fr AS (SELECT issue_id, topic, count(DISTINCT id) AS fresh FROM u WHERE id % 4 <> 0 GROUP BY 1, 2), ev AS (SELECT issue_id, topic, count(DISTINCT id) AS n FROM u GROUP BY 1, 2),
        sd AS (SELECT issue_id, topic, fresh FROM ev JOIN fr USING (issue_id, topic) WHERE n >= 3 AND (issue_id, topic) NOT IN (SELECT (issue_id, topic) FROM ci)
               QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY fresh DESC, {_SLUG}) = 1),
        w AS (SELECT issue_id, 'more:' || {_SLUG} AS card, fresh, 0 AS for_role, 0 AS lead_by FROM dp JOIN fr USING (issue_id, topic)
              UNION ALL SELECT issue_id, 'topic:' || {_SLUG}, fresh, 0, 1 FROM sd UNION ALL SELECT issue_id, card, fresh, for_role, 2 FROM c) """
    + _DEALT.format("lead_by, for_role DESC, fresh DESC, card", "w"),
}
