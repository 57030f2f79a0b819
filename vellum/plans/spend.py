"""Spend analytics over the model-call ledger.

Each read model is one pass: aggregates carry their predicates inside (FILTER), so
Spark sums per task and shuffles a row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import round_half_up
from vellum.sources.tables import LEDGER_SQL, ledger, table
from vellum.sources.views import ISSUES_SQL, PAGES_SQL, issues, pages

INGEST, PATRON = ("click", "purchase"), ("view", "signup")

_L = f"l AS ({LEDGER_SQL})"


def _in(steps: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{s}'" for s in steps) + ")"


def measures() -> list[Column]:
    """Calls, cost (0 where nothing is priced), unpriced calls and token sums."""
    return [
        F.count(F.lit(1)).alias("calls"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ]


MEASURES_SQL = """count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 4) AS cost,
  count(*) FILTER (WHERE cost_usd IS NULL) AS unpriced,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"""


def cost_of(steps: tuple[str, ...]) -> Column:
    return F.round(F.coalesce(F.sum(F.when(F.col("step").isin(*steps), F.col("cost_usd"))), F.lit(0.0)), 4)


def spend_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("step").agg(*measures())


def spend_by_model_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("step", "model").agg(*measures())


def spend_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).agg(*measures(), F.min("called_at").cast("string").alias("first_at"), F.max("called_at").cast("string").alias("last_at"), cost_of(INGEST).alias("ingest_cost"))


def spend_by_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by part of the service and pages touched, per issue, with the issue's title if known."""
    by = ledger(spark, sf_dir).groupBy("issue_pointer").agg(
        F.count(F.lit(1)).alias("calls"),
        cost_of(INGEST).alias("ingest_cost"),
        cost_of(PATRON).alias("patron_cost"),
        F.countDistinct(F.when(F.col("step").isin(*INGEST), F.col("page_record"))).alias("ingested_pages"),
    )
    return by.join(issues(spark, sf_dir).select(F.col("pointer").alias("issue_pointer"), "title"), "issue_pointer", "left")


def _page_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest page and issue groups of ingest steps, with the page's object count."""
    by = ledger(spark, sf_dir).where(F.col("step").isin(*INGEST)).groupBy("page_record", "issue_pointer").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"), F.max("called_at").alias("last_at")
    )
    newest = by.orderBy(F.desc("last_at"), "page_record", "issue_pointer").limit(200)
    return newest.join(pages(spark, sf_dir).select("page_record", "object_count"), "page_record", "left").withColumn("object_count", F.coalesce("object_count", F.lit(0)))


_PAGE_SPEND = f"""{_L}, p AS ({PAGES_SQL}),
  g AS (SELECT page_record, issue_pointer, count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 4) AS cost, max(called_at) AS last_at
        FROM l WHERE step IN {_in(INGEST)} GROUP BY 1, 2 ORDER BY last_at DESC, page_record, issue_pointer LIMIT 200),
  s AS (SELECT g.*, coalesce(p.object_count, 0) AS object_count FROM g LEFT JOIN p USING (page_record))"""


def spend_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_spend(spark, sf_dir).select("page_record", "issue_pointer", "calls", "cost", "object_count", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


def spend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the trailing 30, counted back from the newest call."""
    led = ledger(spark, sf_dir)
    newest = led.agg(F.max("called_at").alias("newest"))
    recent = led.join(F.broadcast(newest), F.col("called_at") > F.col("newest") - F.expr("INTERVAL 30 DAYS"))  # one row
    return recent.groupBy(F.date_format("called_at", "yyyy-MM-dd").alias("day")).agg(*measures())


def spend_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, upper median, least and largest cost of the newest page groups."""
    costs = F.sort_array(F.collect_list("cost"))  # 200 values at most
    out = _page_spend(spark, sf_dir).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("cost"), 6).alias("mean_cost"), costs.alias("costs"))
    return out.select("pages", "mean_cost", F.get("costs", F.floor(F.size("costs") / 2).cast("int")).alias("median_cost"), F.array_min("costs").alias("min_cost"), F.array_max("costs").alias("max_cost"))


def unpriced_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("cost_usd IS NULL").select("step", "model").distinct()


def call_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised usage: absent counts are 0, cached tokens aren't billed twice, thoughts are output."""
    raw = table(spark, sf_dir, "events")
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"), F.lit(0).cast("long"))
    missing = F.coalesce(F.expr("try_cast(get_json_object(props, '$.cached') AS BIGINT)"), F.lit(0).cast("long"))
    cached = F.col("user_id") % 50
    return raw.select("event_id", F.greatest(k - cached, F.lit(0).cast("long")).alias("input_tokens"), (k * 2 + k % 30).alias("output_tokens"), missing.alias("cache_write_tokens"), cached.alias("cache_read_tokens"))


#: A price list with a dated change: (model, from day or None, input, output, cache write, cache read) per million tokens.
PRICES = (("m0", None, 2.0, 10.0, 2.5, 0.2), ("m1", None, 0.5, 9.0, None, None), ("m1", "2024-01-15", 1.0, 18.0, None, None))


def with_asof_price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the price in force on each call's day, and the call's cost; NULL where none is.

    A price holds from its day until the model's next one: intervals make an equi join on
    the model with a range; the price list is small, and Spark broadcasts it by its size.
    """
    w = Window.partitionBy("model").orderBy("since")
    spans = prices.withColumn("since", F.coalesce(F.col("from_day"), F.lit("0000-01-01"))).withColumn("until", F.lead("since").over(w)).drop("from_day")
    day = F.date_format("called_at", "yyyy-MM-dd")
    hit = (calls["model"] == spans["model"]) & (day >= F.col("since")) & (F.col("until").isNull() | (day < F.col("until")))
    rate = lambda c: F.coalesce(F.col(c), F.col("input"))
    cost = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output") + F.col("cache_write_tokens") * rate("cache_write") + F.col("cache_read_tokens") * rate("cache_read")) / 1e6
    return calls.join(spans, hit, "left").drop(spans["model"]).withColumn("price_usd", round_half_up(cost, 6))


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, from_day string, input double, output double, cache_write double, cache_read double")


def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = ledger(spark, sf_dir).withColumns({"cache_write_tokens": F.lit(3), "cache_read_tokens": F.lit(5)})
    return with_asof_price(calls, price_table(spark)).select("call_id", "model", F.coalesce(F.col("since"), F.lit("none")).alias("since"), "price_usd")


_PRICE_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in PRICES)


def ledger_defaulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append with defaults: a call without an issue takes its page's; pages of locked issues are refused."""
    calls = ledger(spark, sf_dir).select("call_id", "page_record", F.when(F.col("call_id") % 2 == 0, F.col("issue_pointer")).alias("issue_pointer"))
    known = pages(spark, sf_dir).select("page_record", F.col("issue_pointer").alias("page_issue"))
    rights = issues(spark, sf_dir).select(F.col("pointer").alias("issue_pointer"), F.col("rights_uri").contains("/InC").alias("locked"))
    filled = calls.join(known, "page_record", "left").select("call_id", "page_record", F.coalesce("issue_pointer", "page_issue").alias("issue_pointer"))
    return filled.join(rights, "issue_pointer", "left").where(~F.coalesce("locked", F.lit(False))).select("call_id", "page_record", "issue_pointer")


def calls_on_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls since the start of the newest call's day: what a daily cap counts."""
    led = ledger(spark, sf_dir)
    today = led.agg(F.date_trunc("day", F.max("called_at")).alias("today"))
    return led.join(F.broadcast(today), F.col("called_at") >= F.col("today")).agg(F.count(F.lit(1)).alias("calls"))  # one row


QUERIES = {
    f.__name__: f
    for f in (spend_by_step, spend_by_model_step, spend_total, spend_by_issue, spend_by_page, spend_by_day, spend_page_stats, unpriced_steps, call_usage, asof_price, ledger_defaulted, calls_on_last_day)
}

ORACLE_SQL = {
    "spend_by_step": f"WITH {_L} SELECT step, {MEASURES_SQL} FROM l GROUP BY step",
    "spend_by_model_step": f"WITH {_L} SELECT step, model, {MEASURES_SQL} FROM l GROUP BY step, model",
    "spend_total": f"""WITH {_L} SELECT {MEASURES_SQL}, CAST(min(called_at) AS VARCHAR) AS first_at, CAST(max(called_at) AS VARCHAR) AS last_at,
        round(coalesce(sum(cost_usd) FILTER (WHERE step IN {_in(INGEST)}), 0.0), 4) AS ingest_cost FROM l""",
    "spend_by_issue": f"""WITH {_L}, i AS ({ISSUES_SQL}), g AS (
        SELECT issue_pointer, count(*) AS calls, round(coalesce(sum(cost_usd) FILTER (WHERE step IN {_in(INGEST)}), 0.0), 4) AS ingest_cost,
          round(coalesce(sum(cost_usd) FILTER (WHERE step IN {_in(PATRON)}), 0.0), 4) AS patron_cost,
          count(DISTINCT page_record) FILTER (WHERE step IN {_in(INGEST)}) AS ingested_pages FROM l GROUP BY issue_pointer)
      SELECT g.*, i.title FROM g LEFT JOIN i ON i.pointer = g.issue_pointer""",
    "spend_by_page": f"WITH {_PAGE_SPEND} SELECT page_record, issue_pointer, calls, cost, object_count, strftime(last_at, '%Y-%m-%d') AS last_day FROM s",
    "spend_by_day": f"""WITH {_L} SELECT strftime(called_at, '%Y-%m-%d') AS day, {MEASURES_SQL} FROM l
      WHERE called_at > (SELECT max(called_at) FROM l) - INTERVAL 30 DAY GROUP BY 1""",
    "spend_page_stats": f"""WITH {_PAGE_SPEND} SELECT count(*) AS pages, round(avg(cost), 6) AS mean_cost,
      list_sort(list(cost))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_cost, min(cost) AS min_cost, max(cost) AS max_cost FROM s""",
    "unpriced_steps": f"WITH {_L} SELECT DISTINCT step, model FROM l WHERE cost_usd IS NULL",
    "call_usage": """WITH e AS (SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
        coalesce(TRY_CAST(json_extract_string(props, '$.cached') AS BIGINT), 0) AS w, user_id % 50 AS cached FROM events)
      SELECT event_id, greatest(k - cached, 0) AS input_tokens, k * 2 + k % 30 AS output_tokens, w AS cache_write_tokens, cached AS cache_read_tokens FROM e""",
    "asof_price": f"""WITH {_L}, p(model, from_day, input, output, cache_write, cache_read) AS (VALUES {_PRICE_ROWS}),
      q AS (SELECT model, coalesce(from_day, '0000-01-01') AS since, input, output, coalesce(cache_write, input) AS cw, coalesce(cache_read, input) AS cr FROM p),
      c AS (SELECT *, strftime(called_at, '%Y-%m-%d') AS day FROM l)
      SELECT call_id, c.model, coalesce(q.since, 'none') AS since,
        floor((input_tokens * q.input + output_tokens * q.output + 3 * cw + 5 * cr) / 1e6 * 1e6 + 0.5) / 1e6 AS price_usd
      FROM c ASOF LEFT JOIN q ON c.model = q.model AND c.day >= q.since""",
    "ledger_defaulted": f"""WITH {_L}, p AS ({PAGES_SQL}), i AS ({ISSUES_SQL}),
      f AS (SELECT call_id, l.page_record, coalesce(CASE WHEN call_id % 2 = 0 THEN l.issue_pointer END, p.issue_pointer) AS issue_pointer
            FROM l LEFT JOIN p ON p.page_record = l.page_record)
      SELECT call_id, page_record, issue_pointer FROM f LEFT JOIN i ON i.pointer = f.issue_pointer
      WHERE NOT coalesce(contains(i.rights_uri, '/InC'), false)""",
    "calls_on_last_day": f"WITH {_L} SELECT count(*) AS calls FROM l WHERE called_at >= (SELECT date_trunc('day', max(called_at)) FROM l)",
}
