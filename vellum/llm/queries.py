"""The operators' registered queries, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.decontamination import decontaminate
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.filter_audit import filter_audit
from vellum.llm.license_scan import ORACLE_SQL as LICENSE_SQL
from vellum.llm.license_scan import license_scan
from vellum.llm.line_dedup import line_dedup
from vellum.llm.mixing import mix
from vellum.llm.simhash import simhash_components
from vellum.llm.spelling_variants import spelling_variants
from vellum.llm.substring_dedup import substring_dedup
from vellum.llm.suffix_dedup import suffix_dedup
from vellum.llm.toxicity import toxicity
from vellum.llm.url_filter import url_filter
from vellum.llm.warc import warc_round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), keep=["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents"), every=True).drop("n_moved", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op3_warc": """
      WITH t AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages),
      m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM t)
      SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
      FROM m""",
    "op5_exact_dedup": """
      WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
        FROM documents),
      g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
      SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
      FROM t JOIN g ON t.norm = g.norm""",
    "op12_filter_audit": r"""
      WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
      t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
      w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
      f AS (
        SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
            len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), first < w.doc_id] AS fail
        FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
      c AS (SELECT part, fail, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
      k AS (SELECT i, substr('ABCDE', i, 1) AS x FROM range(1, 6) r(i)),
      o AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places FROM k a, k b, k c, k d, k e
        WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
      s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, places[step] AS f, places[1:step - 1] AS before FROM o, range(1, 6) r(step)),
      m AS (
        SELECT part, filter_order, step, f, n, good, toxic, fail[f] AS here, list_bool_or([false] || [fail[x] FOR x IN before]) AS earlier,
          fail[f] AND len([1 FOR x IN fail IF x]) = 1 AS alone
        FROM c, s),
      g AS (
        SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT here AND NOT earlier) AS kept, sum(n) FILTER (WHERE here AND NOT earlier) AS removed,
          sum(n) FILTER (WHERE here AND earlier) AS redundant, sum(n) FILTER (WHERE alone) AS unique_fails,
          sum(good) FILTER (WHERE here AND NOT earlier) AS good_lost, sum(toxic) FILTER (WHERE here AND NOT earlier) AS toxic_lost
        FROM m GROUP BY ALL)
      SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
        coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
      FROM g""",
    # The table of the checksum follows from its polynomial; one deletion on either side gives the pairs.
    "op11_spelling_variants": r"""
      WITH RECURSIVE tab AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
      runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents),
      counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
      hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
      hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
        FROM hexed, tab),
      typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
      w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
      d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM w, range(1, length(word) + 1) r(i)),
      p AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
        UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.short
        UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.short),
      b AS (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS other FROM p GROUP BY 1),
      f AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
        FROM w LEFT JOIN b ON b.word = w.word),
      steps AS (
        SELECT word, word AS root FROM f
        UNION ALL SELECT steps.word, f.form FROM steps JOIN f ON f.word = steps.root WHERE f.form IS NOT NULL)
      SELECT f.word, f.form, steps.root, f.n, f.n_near, f.form_n
      FROM f JOIN steps ON steps.word = f.word JOIN f l ON l.word = steps.root AND l.form IS NULL""",
    "op13_license_scan": LICENSE_SQL,
}
