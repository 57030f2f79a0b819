"""Curation as pure transitions: (tables, request) -> tables.

Parquet has no transactions over several tables; a caller writes the results to a
staging folder and swaps it in. Keys are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or update: of rows with one key the last by `order` stays; new rows come after old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), *order)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Append rows whose key is free; within the batch the first by `order` wins. Returns what is added."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(old.select(*key), key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Tri-state patch: patch has <field> and has_<field>; absent leaves, present sets, NULL clears."""
    p = patch.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields])
    joined = rows.join(p, key, "left")
    new = {f: F.when(F.coalesce(F.col(f"_has_{f}"), F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(new).select(*rows.columns)


def publish_batch(rows: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Rows of a batch (id, publish) with their new state: an unchanged state keeps its time, unpublishing clears it."""
    b = batch.groupBy("id").agg(F.max("publish").alias("publish"))
    same = F.col("publish") == F.col("is_published")
    at = F.when(same, F.col("published_at")).when(F.col("publish"), now)
    return rows.join(b, "id").select("id", (~same).alias("changed"), F.col("publish").alias("is_published"), at.alias("published_at"))


def replace_pages(old: DataFrame, new: DataFrame, page: str = "page_record") -> DataFrame:
    """Delete the pages that new rows belong to, then insert: what dynamic partition overwrite does on disk."""
    return old.join(new.select(page).distinct(), page, "left_anti").unionByName(new)


def cascade_delete(tables: Mapping[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Rows of each table (frame, foreign key) that survive the deletion of `gone` (id)."""
    return {n: df.join(gone.select(F.col("id").alias(k)), k, "left_anti") for n, (df, k) in tables.items()}


def cleared_status(objects_left: Column, proposal: Column, running: Column) -> Column:
    """A page's status after a clear, from what is left; a page that runs is refused."""
    return F.when(running, "refused").when(objects_left > 0, "done").when(proposal, "review").otherwise("pending")


def normalised(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def remapped(children: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Children with surrogate keys replaced by those of another store: ids (old_id, new_id)."""
    return children.join(ids, F.col(key) == F.col("old_id")).withColumn(key, F.col("new_id")).drop("old_id", "new_id")
