"""A character index: which items hold a string, from the postings of its trigrams.

The posting table has a row for every trigram and block of ids: the sorted ids of the block whose
fields hold the trigram. It is partitioned by a hash of the trigram and sorted by (trigram, block) within, so a
query opens the partitions of its own trigrams and skips the row groups of others. The items lie
beside it, partitioned by runs of blocks and sorted by id. A query intersects the postings of
each block, rarest first; a block's lists are bounded by its ids. Only the items that
are left are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids a block spans, blocks a partition of items spans, partitions of the posting table.
BLOCK, RUN, BUCKETS = 4096, 64, 64


#: Trigrams of texts that a task holds before it hands on their postings.
HELD = 2_000_000


def _codes(text: str) -> np.ndarray:
    """Each three code points that follow one another, 21 bits a code point, sorted and distinct."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) if len(c) >= 3 else np.zeros(0, np.uint64)


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _postings(block: int):
    """Rows (id, texts) -> (gram, block, ids), combined over as many rows as a task holds."""

    def combined(codes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        code, own = np.concatenate(codes), np.concatenate(ids)
        blocks = own // block
        order = np.lexsort((own, blocks, code))
        code, own, blocks = code[order], own[order], blocks[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])]
        starts = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(own)].astype(np.int32)), pa.array(own))
        return pa.RecordBatch.from_arrays([pa.array([_gram(c) for c in code[starts].tolist()], pa.string()), pa.array(blocks[starts]), lists], names=["gram", "block", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, held = [], [], 0
        for batch in batches:
            for i, texts in zip(batch.column("id").to_pylist(), batch.column("texts"), strict=True):
                own = np.unique(np.concatenate([_codes(t) for t in texts.as_py()]))
                codes.append(own)
                ids.append(np.full(len(own), i, np.int64))
                held += len(own)
                if held > HELD:
                    yield combined(codes, ids)
                    codes, ids, held = [], [], 0
        if held:
            yield combined(codes, ids)

    return run


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS))


def build_index(items: DataFrame, fields: Sequence[str], folder: str, block: int = BLOCK) -> None:
    """Write the postings of all fields, lower-cased, and the items; ids are not null."""
    low = items.select("id", F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]).alias("texts"))
    part = low.mapInArrow(_postings(block), "gram string, block bigint, ids array<bigint>")
    postings = part.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).withColumn("bucket", _bucket(F.col("gram")))
    postings.repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
    runs = items.withColumn("run", F.floor(F.col("id") / (block * RUN)))
    runs.repartitionByRange("run", "id").sortWithinPartitions("run", "id").write.partitionBy("run").parquet(f"{folder}/items")


def candidates(spark: SparkSession, folder: str, terms: Sequence[str], block: int = BLOCK) -> DataFrame | None:
    """(run, id) of items that hold every trigram of every term; None if no term has three code points."""
    grams = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    if not grams:
        return None
    own = [F.lit(g) for g in grams]
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*[_bucket(g) for g in own]) & F.col("gram").isin(*grams))
    per_block = postings.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists")).where(F.col("n") == len(grams))
    rarest = F.get("lists", F.lit(0))["ids"]
    both = F.aggregate(F.slice("lists", 2, len(grams)), rarest, lambda a, b: F.array_intersect(a, b["ids"]))
    return per_block.select(F.explode(both).alias("id")).select(F.floor(F.col("id") / (block * RUN)).alias("run"), "id")


def indexed_items(spark: SparkSession, folder: str, terms: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The items that may hold every term; all of them where no term has three code points."""
    items, found = spark.read.parquet(f"{folder}/items"), candidates(spark, folder, terms, block)
    return (items if found is None else items.join(found, ["run", "id"], "left_semi")).drop("run")
