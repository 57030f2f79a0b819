"""License scan by ordered signature rules, in DataFrame expressions only.

1. *Words.* A text becomes its words, two spaces apart, so that neighbouring matches share no
   separator and a place's word number is half the spaces before it.
2. *Prefilter.* A text that has none of `GATES` holds no signature and goes no further. The others
   meet only the rules whose keyword they contain.
3. *Matches.* Splitting the words at a rule's pattern gives the gaps between its matches, and a running
   sum over gaps and matches their places: one row a match.
4. *Suppression.* Sorted by start, longest first, a match lies within another if a running maximum of
   the ends before it reaches its own. It goes if the other's priority is as good or better; of equal
   places the one of better priority, then the earlier rule, stays.
5. *Labels.* Those of a document's matches that stay, besides those of the base phrases, which always stay.

Rows carry a number of their own in a table in the shared folder, so rows that repeat an id are told apart.
Only matches are shuffled, by document: a group is bounded by its document's length, and
Spark's windows hold it on disk where it is long.

score is the confidence of the surest match that stays (by priority: 1.0, 0.95, 0.9, 0.6), 0.5 with base phrases
only, else 0.

Edge cases: null and empty texts and those without words have no places, no labels ('') and score 0;
a null doc_id is kept as it is; repeated rows give repeated results; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, staged
from vellum.llm.license_rules import BASE, CONFIDENCE, GATES, RULES, spaced, whole_words

#: All but digits, letters (A-Z are lower-cased by then) and whatever isn't ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE_SCORE = 0.5


def _words_in(text: Column) -> Column:
    """Words of a stretch in which each has a space on either side."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add norm: the words, each with a space on either side; empty if there is none."""
    bare = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SEPARATORS, " "))
    return docs.withColumn("_bare", bare).withColumn("norm", F.when(F.col("_bare") == "", "").otherwise(F.concat(F.lit(" "), F.replace("_bare", F.lit(" "), F.lit("  ")), F.lit(" ")))).drop("_bare")


def base_columns() -> list[Column]:
    """n_words, n_base, first_word, last_word, base (labels) of norm."""
    norm, n_words = F.col("norm"), _words_in(F.col("norm"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        pattern = f" {spaced(phrase)} "
        there = F.contains(norm, F.lit(pattern))
        counts.append(F.when(there, ((F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")).otherwise(0))
        before = F.expr(f"substring(norm, 1, locate('{pattern}', norm) - 1)")
        after = F.expr(f"substring(reverse(norm), 1, locate('{pattern[::-1]}', reverse(norm)) - 1)")
        firsts.append(F.when(there, _words_in(before)))
        lasts.append(F.when(there, n_words - _words_in(after) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return [n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base")]


def matches(texts: DataFrame) -> DataFrame:
    """texts (row, norm) -> (row, number, label, priority, start, end): every match of every rule, in words."""
    rules = [{"number": r.number, "label": r.label, "priority": r.priority, "keyword": spaced(r.keyword), "pattern": whole_words(r.pattern)} for r in RULES]
    table = F.from_json(F.lit(json.dumps(rules)), "array<struct<number: int, label: string, priority: int, keyword: string, pattern: string>>")
    asked = texts.select("row", "norm", F.explode(F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))).alias("r"))
    hit = asked.select("row", "r.number", "r.label", "r.priority", F.expr("regexp_extract_all(norm, r.pattern, 0)").alias("hits"), F.expr("split(norm, r.pattern, -1)").alias("gaps")).where(F.size("hits") > 0)
    one = F.transform("hits", lambda h, i: F.struct(_words_in(F.get("gaps", i)).alias("gap"), _words_in(h).alias("size")))
    each = hit.select("row", "number", "label", "priority", F.posexplode(one).alias("i", "hit"))
    so_far = Window.partitionBy("row", "number").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("hit.gap") + F.col("hit.size")).over(so_far))
    return ends.select("row", "number", "label", "priority", (F.col("end") - F.col("hit.size")).alias("start"), "end")


def unsuppressed(found: DataFrame) -> DataFrame:
    """Matches that lie in no other of the same or a better priority."""
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "number").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in CONFIDENCE}
    wide = found.select("*", *[c.alias(f"reach{p}") for p, c in reach.items()])
    own = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in reach])
    return wide.where(own.isNull() | (own < F.col("end"))).select(*found.columns)


def license_scan(docs: DataFrame, detections: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row; with
    detections: instead doc_id, label, number (of the rule), priority, start, end (words) per match that stays."""
    rows = with_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    gated = F.lit(False)
    for gate in GATES:
        gated = gated | F.contains("norm", F.lit(spaced(gate)))
    each = staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *base_columns(), F.when(gated, F.col("norm")).alias("norm")), "license_words")
    found = unsuppressed(matches(each.where("norm is not null").select("row", "norm")))
    if detections:
        return each.select("row", "doc_id").join(found, "row").drop("row")
    confidence = F.element_at(F.lit([CONFIDENCE[p] for p in sorted(CONFIDENCE)]), F.col("priority"))
    per_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(confidence).alias("surest"))
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("surest", F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0))
    return each.drop("norm").join(per_row, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same scan in DuckDB: base phrases by comparing words, signatures by the same patterns.
ORACLE_SQL = rf"""
  WITH rules(number, label, priority, keyword, pattern) AS (VALUES {", ".join(f"({r.number}, {_quoted(r.label)}, {r.priority}, {_quoted(spaced(r.keyword))}, {_quoted(whole_words(r.pattern))})" for r in RULES)}),
  t AS (
    SELECT row_number() OVER () AS row, doc_id,
      trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}', ' ', 'g'), ' ') AS bare FROM documents),
  w AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN [] ELSE string_split(bare, ' ') END AS words, CASE WHEN bare = '' THEN '' ELSE ' ' || replace(bare, ' ', '  ') || ' ' END AS norm FROM t),
  b AS (
    SELECT row, doc_id, len(words) AS n_words,
      [i FOR i IN range(len(words)) IF words[i + 1] = 'cc' AND words[i + 2] = 'by'] AS cc,
      [i FOR i IN range(len(words)) IF words[i + 1] = 'general' AND words[i + 2] = 'public' AND words[i + 3] = 'license'] AS gpl,
      [i FOR i IN range(len(words)) IF words[i + 1] = 'all' AND words[i + 2] = 'rights' AND words[i + 3] = 'reserved'] AS reserved
    FROM w),
  h AS (
    SELECT row, number, label, priority, unnest([len(string_split(x, '  ')) FOR x IN hits]) AS size, unnest([(length(x) - length(replace(x, ' ', ''))) // 2 FOR x IN gaps[1:len(hits)]]) AS gap,
      unnest(range(len(hits))) AS i
    FROM (
      SELECT row, number, label, priority, regexp_extract_all(norm, pattern) AS hits, string_split_regex(norm, pattern) AS gaps
      FROM w, rules WHERE contains(norm, keyword) AND regexp_matches(norm, '{"|".join(spaced(g) for g in GATES)}'))),
  e AS (SELECT *, sum(gap + size) OVER (PARTITION BY row, number ORDER BY i) AS stop FROM h),
  m AS (SELECT *, stop - size AS start FROM e),
  k AS (
    SELECT * FROM m WHERE NOT EXISTS (
      SELECT 1 FROM m o WHERE o.row = m.row AND o.start <= m.start AND o.stop >= m.stop AND o.priority <= m.priority
        AND ((o.start, o.stop) <> (m.start, m.stop) OR (o.priority, o.number) < (m.priority, m.number)))),
  l AS (SELECT row, list(DISTINCT label) AS more, max([{", ".join(str(CONFIDENCE[p]) for p in sorted(CONFIDENCE))}][priority]::DOUBLE) AS surest FROM k GROUP BY 1),
  f AS (
    SELECT b.*, list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(reserved) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
      coalesce(more, []) AS more, coalesce(surest, 0) AS surest FROM b LEFT JOIN l ON l.row = b.row)
  SELECT doc_id, n_words, len(cc) + len(gpl) + len(reserved) AS n_base, list_min(cc || gpl || reserved) AS first_word, list_max(cc || gpl || reserved) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
    greatest(surest, CASE WHEN len(base) > 0 THEN {BASE_SCORE} ELSE 0 END)::DOUBLE AS score
  FROM f"""
