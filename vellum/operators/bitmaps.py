"""Exact distinct counts that combine: bitmaps of ids by bucket, stored by part and merged by OR.

A bitmap covers 32,768 ids (4 KB). Parts (a day, an issue, a load) are counted once and stored; the
distinct count over any of them is the number of bits in the OR of their bitmaps. No ids are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bitmaps(rows: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """(keys, bucket, bits) of the ids seen, null ids aside; Spark ORs per task before the shuffle."""
    at = F.col(id_column)
    return rows.where(at.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of parts, or of finer keys, ORed to coarser keys."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_ids(bitmaps: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """The exact number of distinct ids by keys."""
    return merged_bitmaps(bitmaps, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
