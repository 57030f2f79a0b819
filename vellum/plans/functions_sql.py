"""Queries written in SQL over the registered table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.functions import table_functions
from vellum.plans.ordered import ORACLE_SQL as ORDERED_SQL
from vellum.sources.tables import table

#: Documents' marks as an answer's: citations, bullets and, as they stand, stars.
_ANSWER = "replace(replace(replace(text, '%%%', '[[co-7]] '), '&&&', concat(chr(10), ' - ')), '$$$', ' **strong** ')"
#: Words of an OCR line and of a block.
_LINE, _BLOCK = 8, 40


def markup_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every document's markup."""
    table_functions.register(spark)
    sql = f"SELECT id AS doc_id, line, pos, bullet, kind, text FROM markup_parts(TABLE(SELECT doc_id AS id, {_ANSWER} AS text FROM {{docs}}))"
    return spark.sql(sql, docs=table(spark, sf_dir, "documents").select("doc_id", "text"))


def ocr_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of OCR pages: every document is a page, its words are placed eight to a line.

    Pages are dealt out and sorted while they are a row each, and become rows of words after: a page's rows stay together,
    its level 1 row first, and no word is shuffled. Documents that share an id are one page.
    """
    table_functions.register(spark)
    dealt = "SELECT doc_id AS page, text FROM {docs} DISTRIBUTE BY doc_id SORT BY doc_id"
    words = f"SELECT page, posexplode(concat(array(CAST(NULL AS STRING)), split(coalesce(text, ''), ' '))) AS (pos, word) FROM ({dealt})"
    head = "SELECT page, IF(pos = 0, 1, 5) AS level, pos - 1 AS at, word FROM"
    rows = f"""SELECT page, level, IF(level = 5, CAST(at DIV {_BLOCK} AS INT), NULL) AS block, at AS word_num, IF(level = 5, CAST(at % {_LINE} * 100 AS INT), 0) AS left,
        IF(level = 5, least(length(word), 9) * 10, 1000) AS width, IF(level = 5, CAST(at * 37 % 101 AS DOUBLE), NULL) AS conf, word AS text FROM ({head} ({words}))"""
    sql = f"SELECT page AS doc_id, block, words, kept, round(conf, 6) AS conf, right, characters FROM ocr_page(TABLE({rows}))"
    return spark.sql(sql, docs=table(spark, sf_dir, "documents").select("doc_id", "text"))


def slices_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping slices of every document's height, by LATERAL."""
    table_functions.register(spark)
    sql = "SELECT doc_id, s.slice, s.top, s.bottom FROM {docs}, LATERAL box_slices(n_chars, 900, 90) s"
    return spark.sql(sql, docs=table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(n_chars AS BIGINT) AS n_chars"))


QUERIES = {f.__name__: f for f in (markup_sql, ocr_sql, slices_sql)}

_BLANK = r"[ \t\r\f\x0B]"
ORACLE_SQL = {
    "markup_sql": rf"""WITH a AS (SELECT doc_id, string_split({_ANSWER}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(ls) AS line_text, generate_subscripts(ls, 1) - 1 AS line FROM a), t AS (SELECT doc_id, line, regexp_replace(line_text, '{_BLANK}+$', '') AS s FROM l),
        b AS (SELECT doc_id, line, regexp_matches(s, '^{_BLANK}*[-*•]{_BLANK}+') AS bullet, regexp_replace(s, '^{_BLANK}*[-*•]{_BLANK}+', '') AS body FROM t WHERE s <> ''),
        p AS (SELECT doc_id, line, bullet, list_filter(string_split(regexp_replace(body, '(\[\[co-[0-9]+\]\]|\*\*[^*]+\*\*)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps FROM b),
        r AS (SELECT doc_id, line, bullet, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS pos FROM p)
      SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, bullet, CASE WHEN regexp_full_match(x, '\[\[co-[0-9]+\]\]') THEN 'cite' WHEN regexp_full_match(x, '\*\*[^*]+\*\*') THEN 'bold' ELSE 'text' END AS kind,
        CASE WHEN regexp_full_match(x, '\[\[co-[0-9]+\]\]|\*\*[^*]+\*\*') THEN x[3:-3] ELSE x END AS text FROM r""",
    "ocr_sql": f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM s),
        k AS (SELECT doc_id, pos // {_BLOCK} AS block, (pos * 37 % 101)::DOUBLE AS conf, pos % {_LINE} * 100 + least(length(word), 9) * 10 AS r, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS token FROM w)
      SELECT doc_id, CAST(block AS INTEGER) AS block, count(*) AS words, count(*) FILTER (WHERE conf >= 40 AND token <> '') AS kept, round(avg(conf), 6) AS conf,
        max(r) FILTER (WHERE conf >= 40 AND token <> '') / 1000.0::DOUBLE AS right, CAST(coalesce(sum(length(token)) FILTER (WHERE conf >= 40 AND token <> ''), 0) AS BIGINT) AS characters FROM k GROUP BY 1, 2""",
    "slices_sql": ORDERED_SQL["slices"],
}
