"""Browsing: object index, tags, facets, shelf, catalogue, calendar, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import serial_of, year_of
from vellum.functions.vocabulary import EVENT_GROUPS, NON_PUBLICATION, TYPE_ORDER, VISUAL_ORDER
from vellum.sources.tables import table
from vellum.sources.views import (
    bare_objects,
    ISSUES_SQL,
    OBJECT_ENTITIES_SQL,
    OBJECT_EVENTS_SQL,
    OBJECT_TOPICS_SQL,
    OBJECTS_SQL,
    PAGES_SQL,
    TOPICS_SQL,
    issues,
    object_entities,
    object_events,
    object_topics,
    objects,
    pages,
    published,
    topics,
)

_O, _P, _I = f"o AS ({OBJECTS_SQL})", f"p AS ({PAGES_SQL})", f"i AS ({ISSUES_SQL})"
_T = f"ot AS ({OBJECT_TOPICS_SQL}), t AS ({TOPICS_SQL})"
_E, _V = f"e AS ({OBJECT_ENTITIES_SQL})", f"v AS ({OBJECT_EVENTS_SQL})"
_NON = "(" + ", ".join(f"'{c}'" for c in NON_PUBLICATION) + ")"


def open_rights(uri: Column) -> Column:
    return rights_status(uri) == "open"


def rights_status(uri: Column) -> Column:
    """in_copyright, open or unknown, by the rights statement's code."""
    return F.when(uri.rlike("(?i)/InC"), "in_copyright").when(uri.rlike("(?i)/(NoC|NKC)") | uri.rlike("(?i)PDM|publicdomain"), "open").otherwise("unknown")


RIGHTS_SQL = """CASE WHEN regexp_matches({0}, '(?i)/InC') THEN 'in_copyright'
  WHEN regexp_matches({0}, '(?i)/(NoC|NKC)') OR regexp_matches({0}, '(?i)PDM|publicdomain') THEN 'open' ELSE 'unknown' END"""


def object_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published objects with resolved text, page and issue, in reading order; pixels only where rights are open."""
    o, p, i = published(spark, sf_dir), pages(spark, sf_dir), issues(spark, sf_dir)
    joined = o.join(p.select("page_record", "issue_pointer", "page_number"), "page_record", "left").join(i.select(F.col("pointer").alias("issue_pointer"), "serial", "sort_date", "rights_uri"), "issue_pointer", "left")
    return joined.select(
        F.concat(F.lit("co-"), "id").alias("id"),
        F.length(F.coalesce("text_human", "text")).cast("long").alias("text_length"),
        F.coalesce("page_number", F.lit(1)).alias("printed_page"),
        F.coalesce("serial", F.lit("(unknown)")).alias("serial"),
        F.coalesce("sort_date", F.lit("UNDATED")).alias("date"),
        F.when(open_rights(F.col("rights_uri")), F.concat(F.lit("/image/"), "page_record")).alias("page_image"),
        (~F.col("object_class").isin(*NON_PUBLICATION)).alias("is_publication_content"),
    )


def nested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by rank and names by id under each published object, empty lists where there are none."""
    ids = published(spark, sf_dir).select("id")
    ranked = object_topics(spark, sf_dir).join(F.broadcast(topics(spark)), "topic_id")  # twelve rows
    tags = ranked.groupBy(F.col("object_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("tags"))
    names = object_entities(spark, sf_dir).groupBy(F.col("object_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("entity_id", "name"))).alias("names"))
    list_of = lambda c: F.array_join(F.coalesce(F.transform(c, lambda x: x["name"]), F.array().cast("array<string>")), "|")
    return ids.join(tags, "id", "left").join(names, "id", "left").select("id", list_of("tags").alias("topics"), list_of("names").alias("names"))


def issue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of people, organisations and events, and whether an event is priced, per published object."""
    ents = object_entities(spark, sf_dir).groupBy(F.col("object_id").alias("id")).agg(F.count_if(F.col("entity_type") == "person").alias("people"), F.count_if(F.col("entity_type") == "organization").alias("orgs"))
    evs = object_events(spark, sf_dir).groupBy(F.col("source_object_id").alias("id")).agg(F.count(F.lit(1)).alias("events"), F.max(F.col("price_text").isNotNull()).alias("event_price"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = published(spark, sf_dir).select("id", "object_class").join(ents, "id", "left").join(evs, "id", "left")
    return joined.select("id", "object_class", zero("people"), zero("orgs"), zero("events"), F.coalesce("event_price", F.lit(False)).alias("event_price"))


def topic_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = object_topics(spark, sf_dir).join(published(spark, sf_dir).select(F.col("id").alias("object_id")), "object_id", "left_semi")
    return tagged.groupBy("topic_id").agg(F.countDistinct("object_id").alias("n")).join(F.broadcast(topics(spark)), "topic_id").select("topic_id", "name", "n")  # twelve rows


def name_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 names that most published objects carry, two at least."""
    named = object_entities(spark, sf_dir).join(published(spark, sf_dir).select(F.col("id").alias("object_id")), "object_id", "left_semi")
    counted = named.groupBy("entity_id", "name", "entity_type").agg(F.countDistinct("object_id").alias("n")).where("n >= 2")
    return counted.orderBy(F.desc("n"), "name", "entity_id").limit(15)


def facet_type(object_class: Column, role: Column) -> Column:
    role = F.lower(F.coalesce(role, F.lit("")))
    return (
        F.when(object_class == "advertisement", "y-ad")
        .when((object_class == "illustration") & role.contains("cartoon"), "y-cartoon")
        .when((object_class == "illustration") & role.contains("map"), "y-map")
        .when(object_class == "illustration", "y-photo")
        .when(object_class == "legal_notice", "y-legal")
        .when(object_class == "classified_section", "y-classified")
        .when(object_class == "coupon", "y-coupon")
        .when(object_class == "masthead", "y-masthead")
        .otherwise("y-article")
    )


FACET_TYPE_SQL = """CASE WHEN object_class = 'advertisement' THEN 'y-ad'
  WHEN object_class = 'illustration' AND contains(lower(role), 'cartoon') THEN 'y-cartoon'
  WHEN object_class = 'illustration' AND contains(lower(role), 'map') THEN 'y-map'
  WHEN object_class = 'illustration' THEN 'y-photo' WHEN object_class = 'legal_notice' THEN 'y-legal'
  WHEN object_class = 'classified_section' THEN 'y-classified' WHEN object_class = 'coupon' THEN 'y-coupon'
  WHEN object_class = 'masthead' THEN 'y-masthead' ELSE 'y-article' END"""


def visual_type(kind: Column) -> Column:
    return F.when(kind == "y-ad", "v-ad").when(kind == "y-cartoon", "v-cartoon").when(kind == "y-map", "v-map").when(kind == "y-photo", "v-photo")


VISUAL_SQL = "CASE kind WHEN 'y-ad' THEN 'v-ad' WHEN 'y-cartoon' THEN 'v-cartoon' WHEN 'y-map' THEN 'v-map' WHEN 'y-photo' THEN 'v-photo' END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = facet_type(F.col("object_class"), F.col("role"))
    o = objects(spark, sf_dir).where(~F.col("object_class").isin(*NON_PUBLICATION))
    return o.select("id", "issue_id", kind.alias("kind")).withColumn("visual", visual_type(F.col("kind")))


_ITEMS = f"{_O}, it0 AS (SELECT id, issue_id, {FACET_TYPE_SQL} AS kind FROM o WHERE object_class NOT IN {_NON}), it AS (SELECT *, {VISUAL_SQL} AS visual FROM it0)"


def type_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and visual facets in display order, without empty buckets; v-all counts every visual item."""
    values = F.array(F.col("kind"), F.col("visual"), F.when(F.col("visual").isNotNull(), "v-all"))
    counted = _items(spark, sf_dir).select(F.explode(values).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    order = F.array(*[F.lit(v) for v in (*TYPE_ORDER, "v-all", *VISUAL_ORDER)])
    return counted.withColumn("position", F.array_position(order, F.col("value")))


def facet_match(spark: SparkSession, sf_dir: str, selected_types: tuple[str, ...] = ("y-ad", "y-photo", "y-map"), selected_topics: tuple[int, ...] = (1, 3, 5), visual: tuple[str, ...] = ("v-all",)) -> DataFrame:
    """Items that match the selection: any value within a group, every group with a value."""
    tagged = object_topics(spark, sf_dir).where(F.col("topic_id").isin(*selected_topics)).select(F.col("object_id").alias("id"))
    it = _items(spark, sf_dir).where(F.col("kind").isin(*selected_types) & F.col("visual").isNotNull())
    if "v-all" not in visual:
        it = it.where(F.col("visual").isin(*visual))
    return it.join(tagged, "id", "left_semi").select("id", "kind", "visual")


def type_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types in the order of their first item, with counts; item numbers are given before any are hidden."""
    w = Window.partitionBy("issue_id").orderBy("id")
    numbered = _items(spark, sf_dir).withColumn("number", F.row_number().over(w))
    return numbered.groupBy("issue_id", "kind").agg(F.min("number").alias("first_number"), F.count(F.lit(1)).alias("n")).where("kind <> 'y-masthead'")


def semi_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that the corpus holds."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return refs.join(published(spark, sf_dir).select("id"), "id", "left_semi")


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ids that don't exist."""
    asked = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("id")).distinct()
    return asked.join(bare_objects(spark, sf_dir).select("id"), "id", "left_anti")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read, published and withheld per issue: union, difference and intersection of page sets."""
    o = objects(spark, sf_dir).select("issue_id", (F.col("id") % 8).alias("page"), "is_published")
    per = o.groupBy("issue_id").agg(F.collect_set("page").alias("read"), F.collect_set(F.when(F.col("is_published"), F.col("page"))).alias("shown"))
    text = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    low = F.array(*[F.lit(x).cast("long") for x in (0, 1, 2, 99)])
    return per.select("issue_id", text(F.array_except("read", "shown")).alias("withheld"), text(F.array_intersect(F.col("shown"), low)).alias("low_shown"), text(F.array_union(F.col("shown"), low)).alias("with_low"))


def distinct_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages and issues of published objects, and the issues' list: distinct first, so that only their names meet in its row."""
    o = published(spark, sf_dir).select("page_record", "issue_id")
    listed = F.when(F.count(F.lit(1)) > 0, F.array_join(F.array_sort(F.collect_list("issue_id")), ","))
    issues = o.select("issue_id").distinct().agg(F.count("issue_id").alias("issues"), listed.alias("issue_list"))
    return o.agg(F.countDistinct("page_record").alias("pages")).crossJoin(issues)


def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues that have a published object, a row each."""
    return published(spark, sf_dir).select("issue_id").distinct().orderBy("issue_id")


def done_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("issue_pointer IS NOT NULL").groupBy("issue_pointer").agg(F.count_if(F.col("status") == "done").alias("done"))


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_objects(spark, sf_dir).groupBy("issue_id", "object_class").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("occurrences"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"articles": "article", "ads": "advertisement", "illustrations": "illustration"}
    return objects(spark, sf_dir).groupBy("seq").agg(*[F.count_if(F.col("object_class") == c).alias(n) for n, c in kinds.items()], F.count(F.lit(1)).alias("objects"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run in one pass over the objects, and one over each bridge."""
    content = ~F.col("object_class").isin(*NON_PUBLICATION)
    said = lambda s: F.count_if(F.col("curation_status") == s)
    o = objects(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(content).alias("publication"),
        said("reviewed").alias("reviewed"),
        said("flagged").alias("flagged"),
        (F.count_if(content) - said("reviewed") - said("flagged")).alias("unreviewed"),
        F.count_if(F.col("confidence") < 0.6).alias("low_confidence"),
    )
    e = object_entities(spark, sf_dir).agg(F.countDistinct("entity_id").alias("entities"))
    t = object_topics(spark, sf_dir).agg(F.countDistinct("topic_id").alias("topics"))
    return o.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").join(t.withColumn("k", F.lit(1)), "k").drop("k")


#: A curator's marks that a page's clearing would lose: (label one, label many, condition).
AUDITS = (
    ("edited text", "edited texts", "text_human IS NOT NULL"),
    ("title", "titles", "display_title IS NOT NULL"),
    ("drafted title", "drafted titles", "display_title_model IS NOT NULL"),
    ("published object", "published objects", "is_published"),
    ("review", "reviews", "curation_status IS NOT NULL"),
    ("advertorial", "advertorials", "is_advertorial"),
)


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of curators' work per issue, from one list of conditions; zeros are left out."""
    counted = objects(spark, sf_dir).groupBy("issue_id").agg(*[F.count_if(F.expr(c)).alias(many) for _, many, c in AUDITS])
    rows = F.explode(F.array(*[F.struct(F.col(many).alias("n"), F.when(F.col(many) == 1, one).otherwise(many).alias("label")) for one, many, _ in AUDITS]))
    return counted.select("issue_id", rows.alias("r")).select("issue_id", "r.n", "r.label").where("n > 0")


def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of a run: its first row in reading order, per issue."""
    row = F.min_by(F.struct("id", "role"), F.struct("seq", "id"))
    return bare_objects(spark, sf_dir).groupBy("issue_id").agg(row.alias("r")).select("issue_id", "r.id", "r.role")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of each issue; the larger key wins a tie."""
    w = Window.partitionBy("issue_pointer").orderBy(F.desc("created_at"), F.desc("page_record"))
    return pages(spark, sf_dir).where("issue_pointer IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("issue_pointer", "page_record", "status")


def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with one content hash are one job: its statuses, and the issue it belongs to."""
    p = pages(spark, sf_dir).withColumn("content_hash", F.sha2(F.concat_ws("|", F.coalesce(F.col("issue_pointer").cast("string"), F.lit("-")), F.coalesce(F.col("page_number").cast("string"), F.lit("-"))), 256))
    return p.groupBy("content_hash").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "done").alias("done"), F.min("page_record").alias("first_page"))


def shelf_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on the shelf: keyed by pointer, else by page; sums over pages, head page first in order."""
    key = F.coalesce(F.concat(F.lit("p"), "issue_pointer"), F.concat(F.lit("i"), "page_record"))
    order = F.struct(F.coalesce("page_number", F.lit(1 << 40)), F.col("page_record"))
    g = pages(spark, sf_dir).withColumn("key", key).groupBy("key").agg(F.first("issue_pointer").alias("issue_pointer"), F.count(F.lit(1)).alias("pages_read"), F.sum("object_count").alias("objects"), F.min_by("page_record", order).alias("head_page"))
    i = issues(spark, sf_dir).select(F.col("pointer").alias("issue_pointer"), "serial", "sort_date")
    return g.join(i, "issue_pointer", "left").select("key", "pages_read", "objects", "head_page", F.coalesce("serial", F.lit("(untitled)")).alias("serial"), "sort_date")


def shelf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every printed page of an issue's structure, read or not; of pages with one number the last counts."""
    structure = issues(spark, sf_dir).where("pages IS NOT NULL").select("pointer", "rights_uri", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page_number"))
    w = Window.partitionBy("issue_pointer", "page_number").orderBy(F.desc("page_record"))
    read = pages(spark, sf_dir).where("issue_pointer IS NOT NULL").withColumn("page_number", F.coalesce("page_number", F.lit(0).cast("long"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    joined = structure.join(read.select(F.col("issue_pointer").alias("pointer"), "page_number", "page_record", "status", "object_count"), ["pointer", "page_number"], "left")
    image = F.when(open_rights(F.col("rights_uri")), F.concat(F.lit("/image/"), "page_record"))
    return joined.select("pointer", "page_number", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("object_count", F.lit(0)).alias("objects"), image.alias("image"))


def serial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by serial, largest groups first."""
    g = issues(spark, sf_dir).groupBy(F.coalesce("serial", F.lit("(untitled)")).alias("serial")).agg(F.count(F.lit(1)).alias("issues"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("issues"), "serial")))


def derived_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shelf from objects alone: issues, pages within them, counts."""
    per_page = published(spark, sf_dir).groupBy("issue_id", (F.col("id") % 8).alias("page")).agg(F.count(F.lit(1)).alias("n"))
    per = per_page.groupBy("issue_id").agg(F.sum("n").alias("objects"), F.sort_array(F.collect_list(F.struct("page", "n"))).alias("pages"))
    return per.select("issue_id", "objects", F.array_join(F.transform("pages", lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["n"].cast("string"))), ",").alias("pages"))


def reader_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page a reader opens at: the first with something published, else the first, else 1."""
    o = objects(spark, sf_dir).withColumn("page", F.col("id") % 8)
    return o.groupBy("issue_id").agg(F.coalesce(F.min(F.when(F.col("is_published"), F.col("page"))), F.min("page"), F.lit(1).cast("long")).alias("page"))


def issue_status(status: Column, done: Column, planned: Column, is_url: Column) -> Column:
    return (
        F.when(is_url, "inert")
        .when(status == "in_copyright", "rights_locked")
        .when((done > 0) & (done >= F.coalesce(planned, F.lit(0))), "full")
        .when(done > 0, "partial")
        .otherwise("uningested")
    )


STATUS_SQL = """CASE WHEN filetype = 'url' THEN 'inert' WHEN rights = 'in_copyright' THEN 'rights_locked'
  WHEN done > 0 AND done >= coalesce(pages, 0) THEN 'full' WHEN done > 0 THEN 'partial' ELSE 'uningested' END"""
_CATALOG = f"""{_P}, {_I}, d AS (SELECT issue_pointer, count(*) FILTER (WHERE status = 'done') AS done FROM p WHERE issue_pointer IS NOT NULL GROUP BY 1),
  c0 AS (SELECT i.*, {RIGHTS_SQL.format('i.rights_uri')} AS rights, coalesce(d.done, 0) AS done FROM i LEFT JOIN d ON d.issue_pointer = i.pointer),
  c AS (SELECT *, {STATUS_SQL} AS state FROM c0)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = done_pages(spark, sf_dir).withColumnRenamed("issue_pointer", "pointer")
    i = issues(spark, sf_dir).join(done, "pointer", "left").withColumns({"rights": rights_status(F.col("rights_uri")), "done": F.coalesce("done", F.lit(0).cast("long"))})
    return i.withColumn("state", issue_status(F.col("rights"), F.col("done"), F.col("pages"), F.col("filetype") == "url"))


def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every issue whose title and serial hold the search text."""
    hay = F.lower(F.concat_ws(" ", "title", "serial"))
    return _catalog(spark, sf_dir).where(hay.contains("b") & (F.col("state") != "inert")).select("pointer", "rights", "done", "state", serial_of(F.col("title")).alias("serial"), year_of(F.col("sort_date"), F.col("title")).alias("year"))


def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serials: issues by state, years, whether anything is ingested, and their order on the dashboard."""
    states = ("full", "partial", "uningested", "rights_locked", "inert")
    year = year_of(F.col("sort_date"), F.lit(None).cast("string"))
    g = _catalog(spark, sf_dir).groupBy(serial_of(F.col("title")).alias("serial")).agg(
        F.count(F.lit(1)).alias("issues"), *[F.count_if(F.col("state") == s).alias(s) for s in states], F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.max(F.col("done") > 0).alias("has_ingested")
    )
    w = Window.orderBy(F.desc("has_ingested"), F.desc("issues"), "serial")
    return g.withColumn("position", F.row_number().over(w)).withColumn("full_percent", F.round(100.0 * F.col("full") / F.col("issues"), 2))


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by file type and rights, with the number of serials."""
    return _catalog(spark, sf_dir).groupBy("filetype", "rights").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct(serial_of(F.col("title"))).alias("serials"))


def _group_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in EVENT_GROUPS.items()], "event_type string, display string, kind string, position int")


def _grouped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = object_events(spark, sf_dir).join(published(spark, sf_dir).select(F.col("id").alias("source_object_id"), "object_class", "issue_id"), "source_object_id")
    g = ev.join(F.broadcast(_group_table(spark)), "event_type", "left")  # nine rows
    other = EVENT_GROUPS["other"]
    return g.withColumns({"display": F.coalesce("display", F.lit(other[0])), "kind": F.coalesce("kind", F.lit(other[1])), "position": F.coalesce("position", F.lit(other[2]))})


_GROUP_ROWS = ", ".join(f"('{k}', '{g}', '{kind}', {n})" for k, (g, kind, n) in EVENT_GROUPS.items())
_EVENTS = f"""{_O}, {_V}, gt(event_type, display, kind, position) AS (VALUES {_GROUP_ROWS}),
  ge AS (SELECT v.event_id, o.object_class, o.issue_id, coalesce(gt.display, 'Other') AS display, coalesce(gt.kind, 'civic') AS kind, coalesce(gt.position, 8) AS position
         FROM v JOIN o ON o.id = v.source_object_id AND o.is_published LEFT JOIN gt ON gt.event_type = v.event_type)"""


def calendar_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display groups with their events, largest first, then in fixed order; and their sources."""
    source = F.when(F.col("object_class") == "advertisement", "ad").when(F.col("object_class") == "article", "article").when(F.col("object_class").isin("listing", "classified_section"), "listing").otherwise("mixed")
    g = _grouped_events(spark, sf_dir).withColumn("source", source).groupBy("display", "position").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.select("display", "events", "first_event", "sources", F.row_number().over(Window.orderBy(F.desc("events"), "position")).alias("place"))


def deck_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nightlife if it has strictly more events than civic life, per issue."""
    n, c = F.count_if(F.col("kind") == "nightlife"), F.count_if(F.col("kind") == "civic")
    return _grouped_events(spark, sf_dir).groupBy("issue_id").agg(n.alias("nightlife"), c.alias("civic"), F.when(n > c, "nightlife").otherwise("civic").alias("deck"))


_OPEN_I = f"{RIGHTS_SQL.format('i.rights_uri')} = 'open'"
QUERIES = {
    f.__name__: f
    for f in (
        object_index, nested_tags, issue_features, topic_facet, name_facet, type_facet, facet_match, type_first_seen, semi_refs, anti_missing, set_ops, distinct_cardinalities, issue_list, done_pages,
        class_distribution, page_counts, run_stats, audit_counts, first_run, latest_per_key, job_rollup, shelf_issues, shelf_pages, serial_groups, derived_shelf, reader_start, catalog_status,
        catalog_rollup, catalog_summary, calendar_sections, deck_kind,
    )
}

ORACLE_SQL = {
    "object_index": f"""WITH {_O}, {_P}, {_I} SELECT 'co-' || o.id AS id, length(coalesce(text_human, text)) AS text_length, coalesce(p.page_number, 1) AS printed_page,
        coalesce(i.serial, '(unknown)') AS serial, coalesce(i.sort_date, 'UNDATED') AS date, CASE WHEN {_OPEN_I} THEN '/image/' || o.page_record END AS page_image,
        object_class NOT IN {_NON} AS is_publication_content
      FROM o LEFT JOIN p ON p.page_record = o.page_record LEFT JOIN i ON i.pointer = p.issue_pointer WHERE o.is_published""",
    "nested_tags": f"""WITH {_O}, {_T}, {_E},
        a AS (SELECT object_id, string_agg(t.name, '|' ORDER BY ot.rank, t.name) AS topics FROM ot JOIN t USING (topic_id) GROUP BY 1),
        b AS (SELECT object_id, string_agg(name, '|' ORDER BY entity_id) AS names FROM e GROUP BY 1)
      SELECT o.id, coalesce(a.topics, '') AS topics, coalesce(b.names, '') AS names FROM o LEFT JOIN a ON a.object_id = o.id LEFT JOIN b ON b.object_id = o.id WHERE o.is_published""",
    "issue_features": f"""WITH {_O}, {_E}, {_V} SELECT o.id, o.object_class,
        (SELECT count(*) FROM e WHERE e.object_id = o.id AND entity_type = 'person') AS people, (SELECT count(*) FROM e WHERE e.object_id = o.id AND entity_type = 'organization') AS orgs,
        (SELECT count(*) FROM v WHERE v.source_object_id = o.id) AS events, EXISTS (SELECT 1 FROM v WHERE v.source_object_id = o.id AND price_text IS NOT NULL) AS event_price
      FROM o WHERE o.is_published""",
    "topic_facet": f"WITH {_O}, {_T} SELECT t.topic_id, t.name, count(DISTINCT o.id) AS n FROM t JOIN ot USING (topic_id) JOIN o ON o.id = ot.object_id AND o.is_published GROUP BY 1, 2",
    "name_facet": f"""WITH {_O}, {_E} SELECT entity_id, name, entity_type, count(DISTINCT o.id) AS n FROM e JOIN o ON o.id = e.object_id AND o.is_published
      GROUP BY ALL HAVING count(DISTINCT o.id) >= 2 ORDER BY n DESC, name, entity_id LIMIT 15""",
    "type_facet": f"""WITH {_ITEMS}, x AS (SELECT kind AS value FROM it UNION ALL SELECT visual FROM it WHERE visual IS NOT NULL UNION ALL SELECT 'v-all' FROM it WHERE visual IS NOT NULL)
      SELECT value, count(*) AS n, list_position({list((*TYPE_ORDER, 'v-all', *VISUAL_ORDER))}, value)::BIGINT AS position FROM x GROUP BY value""",
    "facet_match": f"WITH {_ITEMS}, {_T} SELECT id, kind, visual FROM it WHERE kind IN ('y-ad', 'y-photo', 'y-map') AND visual IS NOT NULL AND id IN (SELECT object_id FROM ot WHERE topic_id IN (1, 3, 5))",
    "type_first_seen": f"""WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY id) AS number FROM it)
      SELECT issue_id, kind, CAST(min(number) AS INTEGER) AS first_number, count(*) AS n FROM n WHERE kind <> 'y-masthead' GROUP BY 1, 2""",
    "semi_refs": f"WITH {_O} SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM o WHERE is_published)",
    "anti_missing": "SELECT DISTINCT doc_id * 2 AS id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "set_ops": f"""WITH {_O}, g AS (SELECT issue_id, list(DISTINCT id % 8) AS rd, coalesce(list(DISTINCT id % 8) FILTER (WHERE is_published), []) AS sh FROM o GROUP BY 1)
      SELECT issue_id, array_to_string(list_sort(list_filter(rd, lambda x: NOT list_contains(sh, x))), ',') AS withheld,
        array_to_string(list_sort(list_intersect(sh, [0, 1, 2, 99])), ',') AS low_shown, array_to_string(list_sort(list_distinct(list_concat(sh, [0, 1, 2, 99]))), ',') AS with_low FROM g""",
    "distinct_cardinalities": f"WITH {_O} SELECT count(DISTINCT page_record) AS pages, count(DISTINCT issue_id) AS issues, array_to_string(list_sort(list(DISTINCT issue_id)), ',') AS issue_list FROM o WHERE is_published",
    "issue_list": f"WITH {_O} SELECT DISTINCT issue_id FROM o WHERE is_published",
    "done_pages": f"WITH {_P} SELECT issue_pointer, count(*) FILTER (WHERE status = 'done') AS done FROM p WHERE issue_pointer IS NOT NULL GROUP BY 1",
    "class_distribution": f"WITH {_O} SELECT issue_id, object_class, count(*) AS n, CAST(sum(seq) AS BIGINT) AS occurrences FROM o GROUP BY 1, 2",
    "page_counts": f"""WITH {_O} SELECT seq, count(*) FILTER (WHERE object_class = 'article') AS articles, count(*) FILTER (WHERE object_class = 'advertisement') AS ads,
      count(*) FILTER (WHERE object_class = 'illustration') AS illustrations, count(*) AS objects FROM o GROUP BY 1""",
    "run_stats": f"""WITH {_O}, {_E}, {_T}, s AS (SELECT count(*) AS objects, count(*) FILTER (WHERE object_class NOT IN {_NON}) AS publication,
        count(*) FILTER (WHERE curation_status = 'reviewed') AS reviewed, count(*) FILTER (WHERE curation_status = 'flagged') AS flagged, count(*) FILTER (WHERE confidence < 0.6) AS low_confidence FROM o)
      SELECT objects, publication, reviewed, flagged, publication - reviewed - flagged AS unreviewed, low_confidence,
        (SELECT count(DISTINCT entity_id) FROM e) AS entities, (SELECT count(DISTINCT topic_id) FROM ot) AS topics FROM s""",
    "audit_counts": f"WITH {_O} "
    + " UNION ALL ".join(f"SELECT issue_id, count(*) AS n, CASE WHEN count(*) = 1 THEN '{one}' ELSE '{many}' END AS label FROM o WHERE {c} GROUP BY 1" for one, many, c in AUDITS),
    "first_run": f"WITH {_O} SELECT issue_id, id, role FROM o QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY seq, id) = 1",
    "latest_per_key": f"WITH {_P} SELECT issue_pointer, page_record, status FROM p WHERE issue_pointer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue_pointer ORDER BY created_at DESC, page_record DESC) = 1",
    "job_rollup": f"""WITH {_P} SELECT sha256(coalesce(issue_pointer::VARCHAR, '-') || '|' || coalesce(page_number::VARCHAR, '-')) AS content_hash, count(*) AS requests,
      count(*) FILTER (WHERE status = 'done') AS done, min(page_record) AS first_page FROM p GROUP BY 1""",
    "shelf_issues": f"""WITH {_P}, {_I}, k AS (SELECT *, coalesce('p' || issue_pointer, 'i' || page_record) AS key FROM p),
        g AS (SELECT key, any_value(issue_pointer) AS ip, count(*) AS pages_read, CAST(sum(object_count) AS BIGINT) AS objects, arg_min(page_record, (coalesce(page_number, 1099511627776), page_record)) AS head_page FROM k GROUP BY key)
      SELECT key, pages_read, objects, head_page, coalesce(i.serial, '(untitled)') AS serial, i.sort_date FROM g LEFT JOIN i ON i.pointer = g.ip""",
    "shelf_pages": f"""WITH {_P}, {_I}, s AS (SELECT pointer, rights_uri, unnest(range(1, pages + 1)) AS page_number FROM i WHERE pages IS NOT NULL),
        r AS (SELECT issue_pointer, coalesce(page_number, 0) AS page_number, page_record, status, object_count FROM p WHERE issue_pointer IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY issue_pointer, coalesce(page_number, 0) ORDER BY page_record DESC) = 1)
      SELECT s.pointer, s.page_number, coalesce(r.status, 'pending') AS status, coalesce(r.object_count, 0) AS objects,
        CASE WHEN {RIGHTS_SQL.format('s.rights_uri')} = 'open' THEN '/image/' || r.page_record END AS image
      FROM s LEFT JOIN r ON r.issue_pointer = s.pointer AND r.page_number = s.page_number""",
    "serial_groups": f"""WITH {_I}, g AS (SELECT coalesce(serial, '(untitled)') AS serial, count(*) AS issues, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS pages FROM i GROUP BY 1)
      SELECT *, CAST(row_number() OVER (ORDER BY issues DESC, serial) AS INTEGER) AS position FROM g""",
    "derived_shelf": f"""WITH {_O}, g AS (SELECT issue_id, id % 8 AS page, count(*) AS n FROM o WHERE is_published GROUP BY 1, 2)
      SELECT issue_id, CAST(sum(n) AS BIGINT) AS objects, string_agg(page || ':' || n, ',' ORDER BY page) AS pages FROM g GROUP BY 1""",
    "reader_start": f"WITH {_O} SELECT issue_id, coalesce(min(id % 8) FILTER (WHERE is_published), min(id % 8), 1) AS page FROM o GROUP BY 1",
    "catalog_status": f"""WITH {_CATALOG} SELECT pointer, rights, done, state, trim(split_part(title, ',', 1)) AS serial,
      CAST(nullif(regexp_extract(coalesce(nullif(regexp_extract(sort_date, '\\d{{4}}'), ''), title), '\\d{{4}}'), '') AS INTEGER) AS year
      FROM c WHERE contains(lower(concat_ws(' ', title, serial)), 'b') AND state <> 'inert'""",
    "catalog_rollup": f"""WITH {_CATALOG}, g AS (SELECT trim(split_part(title, ',', 1)) AS serial, count(*) AS issues,
        count(*) FILTER (WHERE state = 'full') AS "full", count(*) FILTER (WHERE state = 'partial') AS partial, count(*) FILTER (WHERE state = 'uningested') AS uningested,
        count(*) FILTER (WHERE state = 'rights_locked') AS rights_locked, count(*) FILTER (WHERE state = 'inert') AS inert,
        CAST(min(left(sort_date, 4)) AS INTEGER) AS first_year, CAST(max(left(sort_date, 4)) AS INTEGER) AS last_year, bool_or(done > 0) AS has_ingested FROM c GROUP BY 1)
      SELECT *, CAST(row_number() OVER (ORDER BY has_ingested DESC, issues DESC, serial) AS INTEGER) AS position, round(100.0 * "full" / issues, 2)::DOUBLE AS full_percent FROM g""",
    "catalog_summary": f"WITH {_CATALOG} SELECT filetype, rights, count(*) AS issues, count(DISTINCT trim(split_part(title, ',', 1))) AS serials FROM c GROUP BY 1, 2",
    "calendar_sections": f"""WITH {_EVENTS}, s AS (SELECT *, CASE WHEN object_class = 'advertisement' THEN 'ad' WHEN object_class = 'article' THEN 'article'
          WHEN object_class IN ('listing', 'classified_section') THEN 'listing' ELSE 'mixed' END AS source FROM ge),
        g AS (SELECT display, position, count(*) AS events, min(event_id) AS first_event, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM s GROUP BY 1, 2)
      SELECT display, events, first_event, sources, CAST(row_number() OVER (ORDER BY events DESC, position) AS INTEGER) AS place FROM g""",
    "deck_kind": f"""WITH {_EVENTS} SELECT issue_id, count(*) FILTER (WHERE kind = 'nightlife') AS nightlife, count(*) FILTER (WHERE kind = 'civic') AS civic,
      CASE WHEN count(*) FILTER (WHERE kind = 'nightlife') > count(*) FILTER (WHERE kind = 'civic') THEN 'nightlife' ELSE 'civic' END AS deck FROM ge GROUP BY 1""",
}
