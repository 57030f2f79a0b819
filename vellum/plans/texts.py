"""Text read models: titles, snippets, slugs, fields of notices, ranked search, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import dates
from vellum.functions import text as T
from vellum.functions.vocabulary import ABBREVIATIONS, CAPTURE_ONLY, LABEL_CLASSES, TOPICS
from vellum.plans.browse import FACET_TYPE_SQL, facet_type
from vellum.sources.tables import table
from vellum.sources.views import EVENTS_OF_ONE, ISSUES_SQL, OBJECTS_SQL, bare_objects, issues, objects, published, pick, sql_list

_O, _I = f"o AS ({OBJECTS_SQL})", f"i AS ({ISSUES_SQL})"

# ── SQL twins of the text functions (RE2: \s is ASCII there, as in Java) ──────────────────


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squash(x: str) -> str:
    inner = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return _strip(inner)


def _lines(x: str) -> str:
    return rf"list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(regexp_replace(l, '\[[^\]]*\]', '', 'g'), '^\s+|\s+$', '', 'g'))"


def _first_line(x: str) -> str:
    return f"coalesce(list_filter({_lines(x)}, lambda l: l <> '')[1], '')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _headline(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"
    long = f"list_filter({words}, lambda w: len(regexp_extract_all(w, '[A-Za-z]')) >= 4)"
    last = f"replace({words}[-1], '.', '')"
    abbr = ", ".join(f"'{a}'" for a in ABBREVIATIONS)
    return f"""CASE WHEN {_count(x, '[A-Za-z]')} = 0 THEN false
      WHEN {_count(x, '[A-Z]')} / {_count(x, '[A-Za-z]')} >= 0.8 THEN len({words}) <= 16 AND length({x}) <= 120
      WHEN len({words}) > 12 OR length({x}) > 110 OR regexp_matches({x}, '[,;:]$')
        OR (suffix({x}, '.') AND len({words}) > 4 AND NOT (lower({last}) IN ({abbr}) OR length({last}) <= 2)) THEN false
      WHEN len({long}) = 0 THEN false
      ELSE len(list_filter({long}, lambda w: regexp_matches(w, '^[^A-Za-z]*[A-Z]'))) / len({long}) >= 0.6 END"""


def _titled(rows: DataFrame) -> DataFrame:
    o = T.once(rows, head=T.first_line(F.col("text")))
    return T.once(o, r=T.resolved_title(F.col("head"), F.col("display_title"), F.col("display_title_model")))


_TITLED = f"""{_O}, h AS (SELECT *, {_first_line('text')} AS head FROM o),
  ti AS (SELECT *, CASE WHEN display_title IS NOT NULL THEN display_title WHEN {_headline('head')} THEN head END AS title,
    CASE WHEN display_title_model IS NOT NULL THEN 'machine' WHEN display_title IS NOT NULL THEN 'human' WHEN {_headline('head')} THEN 'machine' END AS title_source FROM h)"""


def resolved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(bare_objects(spark, sf_dir)).select("id", "r.title", "r.title_source", "r.title_model")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(bare_objects(spark, sf_dir)).select("id", T.snippet(F.col("text"), F.col("r.title")).alias("snippet"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_objects(spark, sf_dir).select("id", T.excerpt(F.col("text")).alias("excerpt"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body under a title: its length and hash."""
    body = T.body_after_title(F.col("text"), F.col("r.title"))
    return _titled(bare_objects(spark, sf_dir)).select("id", F.length(body).cast("long").alias("n"), F.sha2(body, 256).alias("sha"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curators' text and title edits as they are stored: NULL where they say nothing new."""
    o = bare_objects(spark, sf_dir)
    text = T.edited_text(F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" \t\n"))).when(F.col("id") % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("x"), "text")), T.strip(F.regexp_replace("text", r"(?m)[ \t]+$", "")), 500)
    return o.select("id", F.sha2(F.coalesce(text, F.lit("none")), 256).alias("text_sha"), T.edited_title(F.concat(F.lit("  a  "), F.col("role"), F.lit("\n b "))).alias("title"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both slugs, the filler key, the token norm and the cleaned name of every page's host and path."""
    raw = F.regexp_replace(F.col("url"), "^[a-z]+://", "")
    amp = F.concat(raw, F.lit(" & A&B"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.slug(amp).alias("slug"), T.slug(amp, spaced_and=False).alias("tight_slug"), T.filler_key(raw).alias("filler_key"), T.token_norm(raw).alias("token"),
        T.clean_name(raw).alias("name"), T.html_escape(F.col("html")).alias("escaped"),
    )


def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with their prefix, and back; the provider from a run's id."""
    o = bare_objects(spark, sf_dir).select("id", F.concat(F.lit("co-"), "id").alias("public_id"), F.concat(F.lit("run_"), pick(F.col("id") % 3, ("a", "b", "z")), F.lit("_7")).alias("run_id"))
    provider = F.coalesce(F.nullif(F.regexp_extract("run_id", "_(a|b|c)_", 1), F.lit("")), F.lit("unknown"))
    return o.select("public_id", F.regexp_replace("public_id", "^(co|t|n|ev)-", "").cast("long").alias("id"), provider.alias("provider"))


def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" O'BRIEN"))).otherwise(F.col("p_name")).alias("t"))
    return p.select("p_partkey", T.title_case(F.col("t")).alias("title"))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir).withColumn("label", dates.date_label(F.col("sort_date")))
    return i.select("pointer", "label", dates.spoken_date(F.col("label")).alias("spoken"))


def folio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line under a masthead: serial, spelled day, initials, year."""
    day = dates.spelled_day(F.to_date("sort_date"))
    return issues(spark, sf_dir).where("sort_date IS NOT NULL").select("pointer", F.concat_ws(" · ", F.upper("serial"), F.upper(day)).alias("folio"), T.initials(T.serial_of(F.col("title"))).alias("initials"), T.year_of(F.col("sort_date"), F.col("title")).alias("year"))


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.clock(F.col("value") * 10 - 20).alias("clock"))


# ── notices and advertisements: whole documents, each with a phrase at its start, inside or at its end ──

#: What notices say here, with words and prices that only look like what is searched.
PHRASES = (
    "bonds of $1,000 at 25c a week", "a vagabond and his dog", "FINANCIAL STATEMENT of the 5th ward", "financial  statement", "Assets and acres — the mayor", "rewarded; a foundling",
    "LOST, strayed or stolen", "At the theatre, children free: $.50 or $2.50, $2.50", "Call LINC. 555-J, 1234 West Broadview Rd.", "lincoln 37-12K now, 12 Main St", "", "25 cents, 10c, 10c, 1234c, x5c, $1,250.75 and 5c.",
    "councilman. Lots for sale", "Lincoln 555-Jx or linc 4J", "Schools - movies and films", "1c 2c 3c 4c 5c 6c 7c 8c 9c", "LINCOLN 9, 99999 Ann St. Clair Mc. Dee Street", "misassets",
)


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text; a null text counts as empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), pick(F.col("doc_id") % len(PHRASES), PHRASES).alias("phrase"))
    at = F.instr("body", "\n")
    inside = F.concat(F.expr("left(body, instr(body, '\\n'))"), "phrase", F.expr("substring(body, instr(body, '\\n') + 1)"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("phrase", F.lit(" "), "body")).when((F.col("doc_id") % 3 == 1) | (at == 0), F.concat("body", F.lit("\n "), "phrase")).otherwise(inside)
    return d.select("doc_id", text.alias("text"))


_NOTICES = f"""d AS (SELECT doc_id, coalesce(text, '') AS body, ({sql_list(PHRASES)})[doc_id % {len(PHRASES)} + 1] AS phrase FROM documents),
  notices AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN phrase || ' ' || body WHEN doc_id % 3 = 1 OR NOT contains(body, chr(10)) THEN body || chr(10) || ' ' || phrase
    ELSE string_split(body, chr(10))[1] || chr(10) || phrase || array_to_string(string_split(body, chr(10))[2:], chr(10)) END AS text FROM d)"""


#: Patterns of an advertisement's fields. Fixed values.
ADVERTISER_END = " — |[.:]| - "
CENTS = r"(?<![A-Za-z0-9_])\d{1,3}c(?![A-Za-z0-9_])"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PHONE = r"(?i)(?<![A-Za-z0-9_])(?:Lincoln|LINC\.?)\s*\d[\d-]*[A-Z]?" + _EDGE
ADDRESS = r"(?<![A-Za-z0-9_])\d{3,5}\s+[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+){0,3}\s+(?:Rd|Road|Ave|Avenue|St|Street|Blvd)(?![A-Za-z0-9_])"


def ad_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertiser, phone, address and up to eight distinct prices of an advertisement."""
    c = F.col("text")
    some = lambda x: F.nullif(x, F.lit(""))
    name = F.substring(T.strip(F.get(F.split(T.first_line(c), ADVERTISER_END), F.lit(0))), 1, 80)
    prices = F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(f"{T.PRICE}|{CENTS}"), 0)), 1, 8)
    return _notices(spark, sf_dir).select(
        "doc_id",
        some(name).alias("advertiser"),
        some(F.regexp_extract(c, PHONE, 0)).alias("phone"),
        some(F.regexp_extract(c, ADDRESS, 0)).alias("address"),
        F.array_join(F.array_sort(prices), "|").alias("prices"),
    )


def legal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a legal notice by keyword precedence, and the subjects that its words show."""
    c, low = F.col("text"), F.lower("text")
    kind = F.when(low.contains("bond"), "bond_schedule").when(low.contains("financial statement") | low.contains("assets"), "financial_statement").otherwise("resolution")
    return _notices(spark, sf_dir).select("doc_id", kind.alias("kind"), T.about(c, T.LOST).alias("lost"), T.about(c, T.SHOWS).alias("shows"), T.about(c, T.KIDS).alias("kids"), T.about(c, T.CIVIC).alias("civic"), T.about(c, T.PROPERTY).alias("property"))


def classified_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banner and categories of a classified section: what stands between its first line and the next blank one, split at semicolons.

    The sections are whole documents with semicolons for commas, some of them doubled, and blank lines before some of their lines.
    """
    text = F.coalesce("text", F.lit(""))
    for old, new in ((", a", ";; a"), (", ", ";"), (".\nA", ".\n \t\nA"), (".\nE", ".\n\n\nE"), (".\nT", ".\n\nT")):
        text = F.replace(text, F.lit(old), F.lit(new))
    block = F.regexp_extract("text", r"\n([\s\S]*?)\n\s*\n", 1)
    cats = F.filter(F.transform(F.split(block, ";"), T.strip), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", T.strip(F.substring_index("text", "\n", 1)).alias("banner"), F.array_join(cats, "|").alias("categories"), F.size(cats).alias("n"))


def tier_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which enrichment an object gets; an advertisement gets the heavy one only if it bears an event."""
    bearing = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.floor(F.col("event_id") / EVENTS_OF_ONE).alias("id")).distinct().withColumn("bearing", F.lit(True))
    c = F.col("object_class")
    tier = (
        F.when(c.isin(*CAPTURE_ONLY), "capture_only").when(c == "article", "heavy").when((c == "advertisement") & F.col("bearing"), "heavy")
        .when(c.isin("advertisement", "coupon"), "light").when(c.isin("classified_section", "legal_notice"), "structured").otherwise("capture_only")
    )
    return bare_objects(spark, sf_dir).select("id", "object_class").join(bearing, "id", "left").select("id", "object_class", tier.alias("tier"))


def enrichment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichments whose topics are all in the vocabulary, three at most, booleans taken strictly."""
    named = pick(F.col("doc_id") % 13, (*TOPICS, "Unheard Of"))
    e = table(spark, sf_dir, "documents").select("doc_id", F.array(named, pick((F.col("doc_id") + 5) % 12, TOPICS), pick(F.col("doc_id") % 12, TOPICS), F.lit(TOPICS[0])).alias("topics"), F.when(F.col("doc_id") % 2 == 0, "true").when(F.col("doc_id") % 3 == 0, "yes").alias("flag"))
    known = F.forall("topics", lambda t: t.isin(*TOPICS))
    return e.select("doc_id", known.alias("valid"), F.array_join(F.array_distinct(F.slice("topics", 1, 3)), "|").alias("topics"), F.coalesce(F.col("flag") == "true", F.lit(False)).alias("advertorial"))


def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected labels with the object class that each stands for."""
    labels = ("text", "seal", "table", "masthead", "footnote", "chart", "nothing")
    to_class = F.create_map(*[F.lit(x) for kv in LABEL_CLASSES.items() for x in kv])
    e = table(spark, sf_dir, "events").select(pick(F.col("user_id") % 7, labels).alias("label"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("object_class", F.coalesce(F.try_element_at(to_class, F.col("label")), F.lit("article")))


# ── ranked search ─────────────────────────────────────────────────────────────────────────


def query_terms(query: str) -> list[str]:
    """Lower-cased terms of a query; quoted phrases stay whole."""
    return [t for quoted, word in re.findall(r'"([^"]+)"|(\S+)', query) if (t := (quoted or word).strip().lower())]


#: Field weights: fixed values of the ranking.
WEIGHTS = {"title": 10, "summary": 6, "subject": 5, "type": 2, "date": 2, "body": 3}


def ranked(items: DataFrame, query: str) -> DataFrame:
    """Items that hold every term in some field: score, fields matched, in the order of rank.

    A term scores its best field's weight, three more at the field's very start.
    """
    terms = query_terms(query)
    if not terms or len(query.strip()) < 2:
        return items.limit(0).select("*", F.lit(0).alias("score"), F.lit("").alias("fields"))
    low = F.struct(*[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in WEIGHTS])
    places = lambda t: F.struct(*[F.instr(F.col(f"_low.{f}"), t).alias(f) for f in WEIGHTS])
    found = T.once(items, _low=low)
    found = T.once(found, _at=F.array(*[places(t) for t in terms])).drop("_low")
    best = F.transform("_at", lambda p: F.greatest(*[F.when(p[f] == 1, w + 3).when(p[f] > 0, w).otherwise(0) for f, w in WEIGHTS.items()]))
    found = T.once(found, _best=best).where(F.forall("_best", lambda b: b > 0))
    inside = lambda f: F.exists("_at", lambda p: p[f] > 0)
    fields = F.concat_ws(",", *[F.when(inside(f), f) for f in WEIGHTS])
    return found.select(*items.columns, F.aggregate("_best", F.lit(0), lambda a, b: a + b).alias("score"), fields.alias("fields"))


def keyword_in_context(text: Column, term: str, pad: int = 90) -> Column:
    """The first hit with its surroundings, cut at spaces, ellipses where text is left out."""
    n, k = F.length(text), len(term)
    i = F.instr(F.lower(text), term) - 1
    s0, e0 = F.greatest(i - pad, F.lit(0)), F.least(n, i + k + pad)
    before, after = F.substring(text, (s0 + 1).cast("int"), (i - s0).cast("int")), F.substring(text, (i + k + 1).cast("int"), (e0 - i - k).cast("int"))
    gap = F.instr(before, " ")
    before = F.when((s0 > 0) & (gap > 0), F.substring(before, (gap + 1).cast("int"), F.length(before))).otherwise(before)
    back = F.instr(F.reverse(after), " ")
    after = F.when((e0 < n) & (back > 0) & (F.length(after) - back > 0), F.substring(after, F.lit(1), (F.length(after) - back).cast("int"))).otherwise(after)
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    return F.when(i >= 0, F.concat(F.when(s0 > 0, "… ").otherwise(""), flat(before), F.lit("["), F.substring(text, (i + 1).cast("int"), F.lit(k)), F.lit("]"), flat(after), F.when(e0 < n, " …").otherwise("")))


def _search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = facet_type(F.col("object_class"), F.col("role"))
    return _titled(published(spark, sf_dir)).select("id", F.col("r.title").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("issue_id").alias("subject"), kind.alias("type"), F.col("role").alias("date"), F.col("text").alias("body"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_search_items(spark, sf_dir), 'the "src1" an').select("id", "title", "score", "fields").orderBy(F.desc("score"), F.asc_nulls_last("title"), "id")


def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword in context for a term, over published objects that have it."""
    o = objects(spark, sf_dir).where("is_published").where(F.lower("text").contains("ing")).select("id", "text")
    return T.once(o, excerpt=keyword_in_context(F.col("text"), "ing")).select("id", "excerpt")


# ── model answers made safe ───────────────────────────────────────────────────────────────


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON answers whose prose is the whole text of a turn; its commonest words give way to references, some of them to no object."""
    k, t = F.col("conv_id"), F.col("turn")
    body = F.coalesce("text", F.lit(""))
    co = lambda n: F.concat(F.lit("co-"), n.cast("string"))
    for word, by in ((" la ", F.concat(F.lit(" [[co-"), k, F.lit("]] "))), (" the ", F.concat(F.lit(" ("), co(k * 3 + t), F.lit(", "), co(t), F.lit(") "))), (" of ", F.concat(F.lit(" "), co(k * 50), F.lit(" ."))), (" le ", F.lit(" xco-5 [[co-6 co-7a "))):
        body = F.replace(body, F.lit(word), by)
    references = F.array(co(k + 1), F.concat(F.lit("[["), co(k), F.lit("]]")), F.lit("x"), F.lit("co-"))
    answer = F.to_json(F.struct(F.concat(F.lit(' "'), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit('" \\ ')).alias("headline"), body.alias("body"), references.alias("references")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("raw"))


def loose_json(raw: Column) -> Column:
    """The text from the first brace to the last, without a code fence."""
    s = T.strip(F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"```\s*$", ""))
    return F.when(F.instr(s, "{") > 0, F.regexp_extract(s, r"(?s)(\{.*\})", 1)).otherwise(s)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a model's answer that exist, eight at most, first seen first; ids leave the prose."""
    key = ["conv_id", "turn"]
    parsed = F.from_json(loose_json(F.col("raw")), "headline string, body string, `references` array<string>")
    a = _answers(spark, sf_dir).select(*key, parsed.alias("a")).select(*key, "a.*")
    inline = F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z0-9_])co-(\d+)(?![A-Za-z0-9_])"), 1)
    given = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.regexp_extract(r, r"^\[*(?:co-)?(\d+)\]*$", 1))
    refs = a.select(*key, F.posexplode(F.concat(given, inline)).alias("pos", "ref")).where("ref <> ''").groupBy(*key, F.col("ref").cast("long").alias("id")).agg(F.min("pos").alias("pos"))
    real = refs.join(bare_objects(spark, sf_dir).select("id"), "id", "left_semi")
    kept = real.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "id"))), 1, 8).alias("r"))
    prose = F.col("body")
    for pattern, by in ((r"\s*\[\[co-\d+\]\]", ""), (r"\s*\((?:\s*co-\d+\s*[,;]?)+\)", ""), (r"\s*(?<![A-Za-z0-9_])co-\d+(?![A-Za-z0-9_])", ""), (r"\s+([.,;:!?])", "$1")):
        prose = F.regexp_replace(prose, pattern, by)
    ids = F.array_join(F.transform("r", lambda x: F.concat(F.lit("co-"), x["id"])), ",")
    return a.join(kept, key, "left").select(*key, T.strip(F.col("headline")).alias("headline"), T.squash(prose).alias("body"), F.coalesce(ids, F.lit("")).alias("refs"))


def script_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts need an intro, a middle and an outro; lines lose ids, tags, cues and stars, and are numbered."""
    part = F.when(F.col("turn") == 0, "intro").when(F.col("turn") < 4, "section").otherwise("outro")
    line = F.col("text")
    for pattern in (r"\[[^\]]*\]", r"<[^>]*>", r"\([^)]*\)", r"\*", r"(?<![A-Za-z0-9_])co-\d+(?![A-Za-z0-9_])"):
        line = F.regexp_replace(line, pattern, "")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"), T.squash(line).alias("line")).where("line <> ''")
    g = c.groupBy("conv_id").agg(F.count_if(F.col("part") == "intro").alias("intro"), F.count_if(F.col("part") == "section").alias("sections"), F.count_if(F.col("part") == "outro").alias("outro"), F.sum(F.length("line")).alias("characters"))
    return g.withColumn("valid", (F.col("intro") > 0) & (F.col("sections") > 0) & (F.col("outro") > 0))


#: Blanks at a line's ends, bullets, and inline marks or what lies between two of them. Fixed values but for the last.
BLANK = r"[ \t\r\f\x0B]"
BULLET = rf"^{BLANK}*[-*•]{BLANK}+"
CITE, BOLD = r"\[\[co-[0-9]+\]\]", r"\*\*[^*]+\*\*"
BETWEEN = r"(?:[^\[*]++|\[(?!\[co-[0-9]+\]\])|\*(?!\*[^*]+\*\*))++"


def markup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline markup of whole turns as rows: bold, cite or text, in order, line by line.

    Common words give way to marks, some of them not closed; lines of blanks count but have no segments, nor has a null text.
    """
    text = F.col("text")
    for old, new in ((" la ", F.lit(" **la** ")), (" the ", F.concat(F.lit(" [[co-"), F.col("conv_id"), F.lit("]]"))), ("\nE", F.lit("\n * E")), ("\nT", F.lit("\n \t\n•\tT")), (" de ", F.lit(" ***de** ")), (" of ", F.lit(" [[co-x]] [**"))):
        text = F.replace(text, F.lit(old), new)
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", rf"{BLANK}+$", "")).where("raw <> ''")
    parts = F.regexp_extract_all(F.regexp_replace("raw", BULLET, ""), F.lit(f"{CITE}|{BOLD}|{BETWEEN}"), 0)
    seg = lines.select("conv_id", "turn", "line", F.col("raw").rlike(BULLET).alias("bullet"), F.posexplode(parts).alias("pos", "part"))
    kind = F.when(F.col("part").rlike(f"^(?:{CITE})$"), "cite").when(F.col("part").rlike(f"^(?:{BOLD})$"), "bold").otherwise("text")
    return seg.withColumn("kind", kind).select("conv_id", "turn", "line", "pos", "bullet", "kind", F.when(F.col("kind") == "text", F.col("part")).otherwise(F.expr("substring(part, 3, length(part) - 4)")).alias("text"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values through JSON and back with defaults, a log appended to, and a field read early."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("event_id") % 3 == 0, '[{"op":"move","at":"a"}]').alias("log"))
    old = F.coalesce(F.from_json("log", "array<struct<op:string,at:string>>"), F.array().cast("array<struct<op:string,at:string>>"))
    new = F.concat(old, F.array(F.struct(F.lit("undo").alias("op"), F.lit("b").alias("at"))))
    early = F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1)
    return e.select("event_id", F.size(new).alias("ops"), F.element_at(new, -1)["op"].alias("last_op"), F.get_json_object(F.to_json(F.struct(new.alias("log"))), "$.log[0].op").alias("first_op"), early.cast("long").alias("k"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamp, credit and note of an object, and a suggestion without its quotes."""
    o = bare_objects(spark, sf_dir)
    return o.select(
        "id",
        F.concat_ws(" · ", F.upper("issue_id"), F.lit("UNDATED"), F.concat(F.lit("P."), (F.col("id") % 8 + 1).cast("string"))).alias("stamp"),
        F.format_string("SOURCE: %s · SEQ %d", F.upper("issue_id"), F.col("seq")).alias("credit"),
        F.concat_ws(" · ", F.coalesce("role", F.regexp_replace("object_class", "_", " ")), F.when(F.col("is_advertorial"), "flagged advertorial")).alias("note"),
        T.unquoted(F.concat(F.lit('"'), F.col("role"), F.lit('."'))).alias("suggestion"),
    )


def labels_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First prefix of a list that a value starts with, and its label."""
    prefixes = ("ST", "S", "PR", "P", "")
    at = F.array_position(F.transform(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.upper("p_type"), p)), True)
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p) for p in prefixes]), at.cast("int")).alias("prefix"), at.alias("position"))


QUERIES = {
    f.__name__: f
    for f in (
        resolved_titles, snippets, excerpts, bodies, edited_texts, slugs, prefixed_ids, title_cases, date_labels, folio, clock, ad_fields, legal_types, classified_payload, tier_router, enrichment_check, label_mix,
        ranked_search, kwic, citations, script_shape, markup_segments, json_roundtrip, stamps, labels_first,
    )
}

_AT = lambda f, t: f"instr(lower(coalesce({f}, '')), '{t}')"
_BEST = lambda t: "greatest(" + ", ".join(f"CASE WHEN {_AT(f, t)} = 1 THEN {w + 3} WHEN {_AT(f, t)} > 0 THEN {w} ELSE 0 END" for f, w in WEIGHTS.items()) + ")"
_TERMS = query_terms('the "src1" an')
_ABOUT = lambda a: f"regexp_matches(text, '(?i)\\b({a})\\b')"
_LABEL_CASE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_CLASSES.items()) + " ELSE 'article' END"

ORACLE_SQL = {
    "resolved_titles": f"WITH {_TITLED} SELECT id, title, title_source, display_title_model AS title_model FROM ti",
    "snippets": rf"""WITH {_TITLED}, l AS (SELECT id, title, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ln FROM ti),
        m AS (SELECT id, ln, title IS NOT NULL AND len(ln) > 0 AND lower({_squash("regexp_replace(ln[1], '\\[[^\\]]*\\]', '', 'g')")}) = lower({_squash("regexp_replace(title, '\\[[^\\]]*\\]', '', 'g')")}) AS promoted FROM l),
        f AS (SELECT id, coalesce(nullif(array_to_string(CASE WHEN promoted THEN ln[2:] ELSE ln END, ' '), ''), ln[1], '') AS full_text FROM m)
      SELECT id, CASE WHEN length(full_text) > 180 THEN regexp_replace(left(full_text, 177), '\s+$', '') || '…' ELSE full_text END AS snippet FROM f""",
    "excerpts": f"""WITH f AS (SELECT doc_id AS id, {_squash('text')} AS flat FROM documents), c AS (SELECT *, left(flat, 260) AS cut FROM f),
        s AS (SELECT *, CASE WHEN instr(cut, ' ') > 0 THEN length(cut) - instr(reverse(cut), ' ') ELSE -1 END AS space FROM c)
      SELECT id, CASE WHEN length(flat) <= 260 THEN flat ELSE CASE WHEN space > 156 THEN left(cut, space) ELSE cut END || '…' END AS excerpt FROM s""",
    "bodies": rf"""WITH {_TITLED}, l AS (SELECT id, title, string_split(text, chr(10)) AS ln, {_lines('text')} AS cl FROM ti),
        a AS (SELECT *, list_position(list_transform(cl, lambda x: x <> ''), true) AS pos FROM l),
        b AS (SELECT id, {_strip("array_to_string(CASE WHEN pos > 0 AND title IS NOT NULL AND lower(" + _squash('cl[pos]') + ") = lower(" + _squash('title') + ") THEN ln[pos + 1:] ELSE ln END, chr(10))")} AS body FROM a)
      SELECT id, length(body) AS n, sha256(body) AS sha FROM b""",
    "edited_texts": rf"""WITH {_O}, e AS (SELECT id, role, {_strip("regexp_replace(text, '(?m)[ \\t]+$', '', 'g')")} AS machine,
          left({_strip("regexp_replace(CASE id % 3 WHEN 0 THEN text || ' ' || chr(9) || chr(10) WHEN 1 THEN ' ' ELSE 'x' || text END, '(?m)[ \\t]+$', '', 'g')")}, 500) AS kept FROM o)
      SELECT id, sha256(CASE WHEN kept <> '' AND kept IS DISTINCT FROM machine THEN kept ELSE 'none' END) AS text_sha, 'a ' || role || ' b' AS title FROM e""",
    "slugs": r"""WITH r AS (SELECT page_id, html, regexp_replace(url, '^[a-z]+://', '') AS raw, regexp_replace(url, '^[a-z]+://', '') || ' & A&B' AS amp FROM pages)
      SELECT page_id, regexp_replace(regexp_replace(replace(lower(amp), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
        regexp_replace(regexp_replace(replace(lower(amp), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS tight_slug,
        trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g')) AS filler_key, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS token,
        trim(left(trim(regexp_replace(raw, '[^\p{L}\p{N} .''-]', '', 'g')), 24)) AS name,
        replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM r""",
    "prefixed_ids": "SELECT 'co-' || doc_id AS public_id, doc_id AS id, (['a', 'b', 'unknown'])[doc_id % 3 + 1] AS provider FROM documents",
    "title_cases": r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || ' O''BRIEN' ELSE p_name END AS t FROM part),
        w AS (SELECT p_partkey, t, regexp_extract_all(lower(t), '[a-z0-9_]+|[^a-z0-9_]+') AS ws FROM t)
      SELECT p_partkey, CASE WHEN length(t) > 4 AND t = upper(t) THEN array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), '') ELSE t END AS title FROM w""",
    "date_labels": f"""WITH {_I} SELECT pointer, CASE WHEN sort_date IS NULL THEN 'UNDATED' ELSE strftime(CAST(sort_date AS DATE), '%b %-d %Y') END AS label,
        CASE WHEN sort_date IS NULL THEN 'UNDATED' ELSE strftime(CAST(sort_date AS DATE), '%B %-d, %Y') END AS spoken FROM i""",
    "folio": f"""WITH {_I} SELECT pointer, concat_ws(' · ', upper(serial), upper(strftime(CAST(sort_date AS DATE), '%A, %B %-d, %Y'))) AS folio, upper(left(title, 1)) AS initials, CAST(left(sort_date, 4) AS INTEGER) AS year
      FROM i WHERE sort_date IS NOT NULL""",
    "clock": "WITH c AS (SELECT event_id, CAST(greatest(floor(value * 10 - 20), 0) AS BIGINT) AS s FROM events) SELECT event_id, printf('%d:%02d', s // 60, s % 60) AS clock FROM c",
    "ad_fields": rf"""WITH {_NOTICES} SELECT doc_id, nullif(left(regexp_replace(regexp_split_to_array({_first_line('text')}, ' — |[.:]| - ')[1], '^\s+|\s+$', '', 'g'), 80), '') AS advertiser,
        nullif(regexp_extract(text, '(?i)\b(?:Lincoln|LINC\.?)\s*\d[\d-]*[A-Z]?\b'), '') AS phone,
        nullif(regexp_extract(text, '\b\d{{3,5}}\s+[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+){{0,3}}\s+(?:Rd|Road|Ave|Avenue|St|Street|Blvd)\b'), '') AS address,
        (SELECT coalesce(string_agg(price, '|' ORDER BY price), '') FROM (SELECT price FROM (SELECT unnest(p) AS price, generate_subscripts(p, 1) AS i FROM (SELECT regexp_extract_all(text, '\$[\d,]+(?:\.\d\d)?|\b\d{{1,3}}c\b') AS p)) GROUP BY price ORDER BY min(i) LIMIT 8)) AS prices FROM notices""",
    "legal_types": f"""WITH {_NOTICES} SELECT doc_id, CASE WHEN contains(lower(text), 'bond') THEN 'bond_schedule' WHEN contains(lower(text), 'financial statement') OR contains(lower(text), 'assets') THEN 'financial_statement' ELSE 'resolution' END AS kind,
        {_ABOUT(T.LOST)} AS lost, {_ABOUT(T.SHOWS)} AS shows, {_ABOUT(T.KIDS)} AS kids, {_ABOUT(T.CIVIC)} AS civic, {_ABOUT(T.PROPERTY)} AS property FROM notices""",
    "classified_payload": rf"""WITH t AS (SELECT doc_id, string_split(replace(replace(replace(replace(replace(coalesce(text, ''), ', a', ';; a'), ', ', ';'), '.' || chr(10) || 'A', '.' || chr(10) || ' ' || chr(9) || chr(10) || 'A'),
          '.' || chr(10) || 'E', '.' || chr(10) || chr(10) || chr(10) || 'E'), '.' || chr(10) || 'T', '.' || chr(10) || chr(10) || 'T'), chr(10)) AS ln FROM documents),
        b AS (SELECT doc_id, ln, list_filter(range(3, len(ln)), lambda j: regexp_matches(ln[j], '^\s*$'))[1] AS blank FROM t),
        c AS (SELECT doc_id, ln, CASE WHEN blank IS NULL THEN [] ELSE list_filter(list_transform(string_split(array_to_string(ln[2:blank - 1], chr(10)), ';'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS cats FROM b)
      SELECT doc_id, regexp_replace(ln[1], '^\s+|\s+$', '', 'g') AS banner, array_to_string(cats, '|') AS categories, CAST(len(cats) AS INTEGER) AS n FROM c""",
    "tier_router": f"""WITH {_O}, b AS (SELECT DISTINCT event_id // {EVENTS_OF_ONE} AS id FROM events WHERE event_type = 'purchase')
      SELECT id, object_class, CASE WHEN object_class = 'article' THEN 'heavy' WHEN object_class = 'advertisement' AND id IN (SELECT id FROM b) THEN 'heavy'
        WHEN object_class IN ('advertisement', 'coupon') THEN 'light' WHEN object_class IN ('classified_section', 'legal_notice') THEN 'structured' ELSE 'capture_only' END AS tier FROM o""",
    "enrichment_check": f"""WITH v AS (SELECT {sql_list((*TOPICS, 'Unheard Of'))} AS v), e AS (SELECT doc_id, [v[doc_id % 13 + 1], v[(doc_id + 5) % 12 + 1], v[doc_id % 12 + 1]] AS t FROM documents, v)
      SELECT doc_id, NOT list_contains(t, 'Unheard Of') AS valid, t[1] || '|' || t[2] || CASE WHEN t[3] IS NULL OR t[3] = t[1] OR t[3] = t[2] THEN '' ELSE '|' || t[3] END AS topics, doc_id % 2 = 0 AS advertorial
      FROM (SELECT doc_id, CASE WHEN t[1] = t[2] THEN [t[1], t[3]] ELSE t END AS t FROM e)""",
    "label_mix": f"WITH l AS (SELECT (['text', 'seal', 'table', 'masthead', 'footnote', 'chart', 'nothing'])[user_id % 7 + 1] AS label FROM events) SELECT label, count(*) AS n, {_LABEL_CASE} AS object_class FROM l GROUP BY label",
    "ranked_search": f"""WITH {_TITLED}, s AS (SELECT id, title, NULL::VARCHAR AS summary, issue_id AS subject, {FACET_TYPE_SQL} AS type, role AS date, text AS body FROM ti WHERE is_published)
      SELECT id, title, {' + '.join(_BEST(t) for t in _TERMS)} AS score, concat_ws(',', {', '.join(f"CASE WHEN {' OR '.join(f'{_AT(f, t)} > 0' for t in _TERMS)} THEN '{f}' END" for f in WEIGHTS)}) AS fields
      FROM s WHERE {' AND '.join(_BEST(t) + ' > 0' for t in _TERMS)}""",
    "kwic": rf"""WITH {_O}, a AS (SELECT id, text, length(text) AS n, instr(lower(text), 'ing') - 1 AS i FROM o WHERE is_published AND contains(lower(text), 'ing')),
        b AS (SELECT *, greatest(i - 90, 0) AS s, least(n, i + 93) AS e FROM a), c AS (SELECT *, substring(text, s + 1, i - s) AS b0, substring(text, i + 4, e - i - 3) AS a0 FROM b),
        d AS (SELECT *, CASE WHEN s > 0 AND instr(b0, ' ') > 0 THEN substring(b0, instr(b0, ' ') + 1) ELSE b0 END AS b1,
          CASE WHEN e < n AND instr(reverse(a0), ' ') > 0 AND length(a0) - instr(reverse(a0), ' ') > 0 THEN left(a0, length(a0) - instr(reverse(a0), ' ')) ELSE a0 END AS a1 FROM c)
      SELECT id, CASE WHEN s > 0 THEN '… ' ELSE '' END || regexp_replace(b1, '\s+', ' ', 'g') || '[' || substring(text, i + 1, 3) || ']' || regexp_replace(a1, '\s+', ' ', 'g') || CASE WHEN e < n THEN ' …' ELSE '' END AS excerpt FROM d""",
    "citations": rf"""WITH a AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10))[1] AS head, replace(replace(replace(replace(coalesce(text, ''), ' la ', ' [[co-' || conv_id || ']] '),
          ' the ', ' (co-' || (conv_id * 3 + turn) || ', co-' || turn || ') '), ' of ', ' co-' || (conv_id * 50) || ' .'), ' le ', ' xco-5 [[co-6 co-7a ') AS body FROM conversations),
        n AS (SELECT conv_id, turn, [CAST(conv_id + 1 AS VARCHAR), CAST(conv_id AS VARCHAR)] || regexp_extract_all(body, '\bco-(\d+)\b', 1) AS refs FROM a),
        r AS (SELECT conv_id, turn, CAST(unnest(refs) AS BIGINT) AS id, generate_subscripts(refs, 1) AS pos FROM n),
        f AS (SELECT conv_id, turn, id, min(pos) AS pos FROM r WHERE id IN (SELECT doc_id FROM documents) GROUP BY ALL),
        g AS (SELECT conv_id, turn, string_agg('co-' || id, ',' ORDER BY pos) AS refs FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) <= 8) GROUP BY ALL)
      SELECT a.conv_id, a.turn, '"' || head || '" ' || chr(92) AS headline, coalesce(g.refs, '') AS refs,
        {_squash(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\s*\[\[co-\d+\]\]', '', 'g'), '\s*\((?:\s*co-\d+\s*[,;]?)+\)', '', 'g'), '\s*\bco-\d+\b', '', 'g'), '\s+([.,;:!?])', '\1', 'g')")} AS body
      FROM a LEFT JOIN g USING (conv_id, turn)""",
    "script_shape": rf"""WITH c AS (SELECT conv_id, CASE WHEN turn = 0 THEN 'intro' WHEN turn < 4 THEN 'section' ELSE 'outro' END AS part,
          {_squash(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '<[^>]*>', '', 'g'), '\([^)]*\)', '', 'g'), '\*', '', 'g'), '\bco-\d+\b', '', 'g')")} AS line FROM conversations),
        g AS (SELECT conv_id, count(*) FILTER (WHERE part = 'intro') AS intro, count(*) FILTER (WHERE part = 'section') AS sections, count(*) FILTER (WHERE part = 'outro') AS outro, CAST(sum(length(line)) AS BIGINT) AS characters
              FROM c WHERE line <> '' GROUP BY 1)
      SELECT *, intro > 0 AND sections > 0 AND outro > 0 AS valid FROM g""",
    "markup_segments": r"""WITH a AS (SELECT conv_id, turn, string_split(replace(replace(replace(replace(replace(replace(text, ' la ', ' **la** '), ' the ', ' [[co-' || conv_id || ']]'), chr(10) || 'E', chr(10) || ' * E'),
          chr(10) || 'T', chr(10) || ' ' || chr(9) || chr(10) || '•' || chr(9) || 'T'), ' de ', ' ***de** '), ' of ', ' [[co-x]] [**'), chr(10)) AS ls FROM conversations WHERE text IS NOT NULL),
        l AS (SELECT conv_id, turn, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM a), s AS (SELECT * REPLACE (regexp_replace(t, '[ \t\r\f\x0B]+$', '') AS t) FROM l),
        b AS (SELECT conv_id, turn, line, ltrim(t, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS u, t FROM s WHERE t <> ''),
        c AS (SELECT *, left(u, 1) IN ('-', '*', '•') AND regexp_matches(u[2:], '^[ \t\r\f\x0B]') AS bullet FROM b),
        d AS (SELECT conv_id, turn, line, bullet, CASE WHEN bullet THEN ltrim(u[2:], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) ELSE t END AS body FROM c),
        p AS (SELECT conv_id, turn, line, bullet, list_filter(string_split(regexp_replace(body, '(\[\[co-[0-9]+\]\]|\*\*[^*]+\*\*)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps FROM d),
        r AS (SELECT conv_id, turn, line, bullet, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS pos FROM p)
      SELECT conv_id, turn, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, bullet, CASE WHEN regexp_full_match(x, '\[\[co-[0-9]+\]\]') THEN 'cite' WHEN regexp_full_match(x, '\*\*[^*]+\*\*') THEN 'bold' ELSE 'text' END AS kind,
        CASE WHEN regexp_full_match(x, '\[\[co-[0-9]+\]\]|\*\*[^*]+\*\*') THEN x[3:-3] ELSE x END AS text FROM r""",
    "json_roundtrip": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS ops, 'undo' AS last_op, CASE WHEN event_id % 3 = 0 THEN 'move' ELSE 'undo' END AS first_op,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "stamps": f"""WITH {_O} SELECT id, upper(issue_id) || ' · UNDATED · P.' || (id % 8 + 1) AS stamp, 'SOURCE: ' || upper(issue_id) || ' · SEQ ' || seq AS credit,
      role || CASE WHEN is_advertorial THEN ' · flagged advertorial' ELSE '' END AS note, role AS suggestion FROM o""",
    "labels_first": """SELECT p_partkey, CASE WHEN starts_with(upper(p_type), 'ST') THEN 'ST' WHEN starts_with(upper(p_type), 'S') THEN 'S' WHEN starts_with(upper(p_type), 'PR') THEN 'PR' WHEN starts_with(upper(p_type), 'P') THEN 'P' ELSE '' END AS prefix,
      CAST(CASE WHEN starts_with(upper(p_type), 'ST') THEN 1 WHEN starts_with(upper(p_type), 'S') THEN 2 WHEN starts_with(upper(p_type), 'PR') THEN 3 WHEN starts_with(upper(p_type), 'P') THEN 4 ELSE 5 END AS BIGINT) AS position FROM part""",
}
