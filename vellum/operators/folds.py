"""Folds over ordered groups of any size: one pass over sorted partitions with a carried accumulator.

A group's rows follow one another in one partition, and only numbers travel; the pass holds one Arrow batch and
the accumulator of the group at hand. Where Python adds up, it does so a row at a time, since each step
depends on the one before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, group: str, order: str, size: str, start: Callable[[], list[int]], step: Callable[[list[int], int], int]) -> DataFrame:
    """rows and result: what step(state, size) gives for each row, in order, with the group's own state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, start()
        for batch in batches:
            out = []
            for key, n in zip(batch.column("_group").to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if before is None or key != before[0]:
                    before, state = (key,), start()
                out.append(step(state, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "result"])

    narrow = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    out = narrow.repartition("_group").sortWithinPartitions("_group", "_order").mapInArrow(run, f"{kind}, result bigint")
    return out.select(F.col("_group").alias(group), F.col("_order").alias(order), F.col("_size").alias(size), "result")


def packed(rows: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Greedy pack in order: result is 1 for rows that still fit into the cap, 0 for those passed over."""

    def step(state: list[int], n: int) -> int:
        if state[0] + n > cap:
            return 0
        state[0] += n
        return 1

    return folded(rows, group, order, size, lambda: [0], step)


def chunked(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Consecutive rows cut into chunks of at most so much; a larger row is a chunk alone. result: the chunk's number."""

    def step(state: list[int], n: int) -> int:
        if state[1] > 0 and state[1] + n > most:
            state[0], state[1] = state[0] + 1, n
        else:
            state[1] += n
        return state[0]

    return folded(rows, group, order, size, lambda: [0, 0], step)
