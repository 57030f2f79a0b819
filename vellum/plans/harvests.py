"""A paged listing harvested in two runs: the first ends half-way, the second asks for missing pages only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import paged
from vellum.sources.folders import new_folder
from vellum.sources.tables import table

#: Records of an answer here; the small tables then have several pages.
SIZE = 50
#: Pages of a task: tasks and stored files are that many times fewer than pages.
PER_TASK = 100


def catalog_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the records of a listing: written as its answers, harvested, interrupted, resumed.

    Each row tells its page and the run that read it. Customers without a key are in no listing.
    """
    c = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL")
    k = F.col("c_custkey")
    start = k - k % SIZE + 1
    records = c.select(start.alias("page_start"), (k % SIZE).cast("int").alias("pos"), k.alias("pointer"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("filetype"))
    total = (c.agg(F.max("c_custkey")).first()[0] or 0) + 1
    folder = new_folder(spark, "listing")
    url = paged.write_listing(records, f"{folder}/answers", SIZE, total)
    half, runs = total // 2, [f"{folder}/stored/run={n}" for n in (1, 2)]
    paged.harvest(spark, url, runs[0], None, SIZE, half, PER_TASK)
    read = lambda path: spark.read.schema(paged.LISTING).parquet(path)
    paged.harvest(spark, url, runs[1], read(runs[0]), SIZE, pages_per_task=PER_TASK)
    both = [read(path).withColumn("run", F.lit(n)) for n, path in enumerate(runs, 1)]
    return both[0].unionByName(both[1]).select("pointer", "title", "filetype", "page_start", "run")


QUERIES = {"catalog_harvest": catalog_harvest}

ORACLE_SQL = {
    "catalog_harvest": f"""WITH k AS (SELECT c_custkey AS pointer, c_name AS title, c_mktsegment AS filetype, c_custkey - c_custkey % {SIZE} + 1 AS page_start FROM customer WHERE c_custkey IS NOT NULL)
      SELECT pointer, title, filetype, page_start, CASE WHEN page_start <= (SELECT (max(pointer) + 1) // 2 FROM k) THEN 1 ELSE 2 END AS run FROM k""",
}
