"""As-of join of two large tables without a window over a key.

Both sides are laid out in one order of (key, time), dealt to partitions by ranges of it, so a key with a third
of all rows lies in many partitions. Within a partition, a row's match is the last right row of its
key before it; rows ahead of their key's first right row in the partition take the last right row
of the partitions before, if it has their key: one row a partition is passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.folders import staged


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """left, with the values (null if none) of the right row of the same key and the latest time at or before left's.

    Right rows with a null key or time match nothing; of right rows with the same key and time, that with the
    largest values counts. Left rows with a null key or time stay, without a match.
    """
    names = left.columns
    ours = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_right"))
    theirs = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    # Times tie in the order right, left; a row's hash lets ranges cut between equal ones.
    order = ["_key", "_time", "_side", "_right"]
    both = ours.unionAll(theirs)
    ranged = both.repartitionByRange(*([partitions] if partitions else []), *order, F.xxhash64("_left"))
    laid = staged(ranged.withColumn("_part", F.spark_partition_id()), "asof")
    last = laid.where("_side = 0").groupBy("_part").agg(F.max(F.struct(*order)).alias("last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = laid.select("_part").distinct().join(last, "_part", "left").select("_part", F.last("last", True).over(before).alias("passed"))
    own = Window.partitionBy("_part", "_key").orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = laid.withColumn("_own", F.last("_right", True).over(own)).where("_side = 1").join(F.broadcast(parts), "_part")
    passed = F.when(F.col("passed._key") == F.col("_key"), F.col("passed._right"))
    match = F.when(F.col("_key").isNotNull() & F.col("_time").isNotNull(), F.coalesce("_own", passed))
    return found.select("_left.*", *[match[v].alias(f"asof_{v}") for v in values])
