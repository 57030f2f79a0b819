"""A stored table of one row per key: a bucketed base, small deltas beside it, compaction.

The base lies in buckets of its key, as one of Spark's bucketed tables. An upsert brings its rows to
one per key and writes them as a delta; it neither reads nor writes the base. Reading joins each bucket of the
base with the deltas' rows of its keys. The base is scanned by bucket, so only rows of deltas are shuffled, to the
base's buckets. Compaction writes that join as a new base, a file per bucket, again without moving the base.

Of rows of one key the latest write wins, and inside one write the greatest by `order`, ties by the other columns;
null orders come first. Columns in `keep` hold what the key's first row said (as a creation time does). That is INSERT ... ON
CONFLICT DO UPDATE of all columns but `keep`.

A version is a small file naming the base and the deltas; the file CURRENT names the version in force and moves
last. A write that fails is never seen, and two writers can't claim one version. Keys are a primary key: a row
with a null in its key is an error. An upsert without rows makes a version that reads like the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.folders import read_text, write_text


class KeyedTable:
    """One row per key, in one folder that driver and executors share.

    schema is a DDL string that holds every column once; buckets stays the same for a table's whole life. After `most`
    deltas an upsert compacts by itself, so a read never joins more.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], order: Sequence[str], keep: Sequence[str] = (), buckets: int = 16, most: int = 8) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), spark.createDataFrame([], schema).schema
        self.key, self.order, self.keep, self.buckets, self.most = list(key), list(order), list(keep), buckets, most
        self.set = [c for c in self.schema.names if c not in (*self.key, *self.keep)]

    def version(self) -> int:
        """The number of the version in force; 0 before the first."""
        return int(read_text(self.spark, f"{self.folder}/CURRENT") or 0)

    def _held(self, version: int) -> dict:
        found = read_text(self.spark, f"{self.folder}/versions/{version}") if version else None
        return json.loads(found) if found else {"base": None, "deltas": []}

    def _publish(self, base: int, held: dict) -> int:
        write_text(self.spark, f"{self.folder}/versions/{base + 1}", json.dumps(held), replace=False)
        write_text(self.spark, f"{self.folder}/CURRENT", str(base + 1), replace=True)
        return base + 1

    def _name(self, path: str) -> str:
        return "keyed_" + path.rsplit("/", 1)[-1]

    def _base(self, path: str) -> DataFrame:
        """A base by its buckets. Its entry in the session's catalog is made here where there is none."""
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            keys = ", ".join(f"`{k}`" for k in self.key)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _one_per_key(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Of each key the greatest row by order; `keep` columns of the least."""
        last, first = [*order, *(c for c in self.set if c not in order)], [*order, *(c for c in self.keep if c not in order)]
        out = rows.groupBy(*self.key).agg(F.max(F.struct(*last)).alias("_last"), F.min(F.struct(*first)).alias("_first"))
        return out.select(*self.key, *[F.col(f"_last.`{c}`").alias(c) for c in self.set], *[F.col(f"_first.`{c}`").alias(c) for c in self.keep])

    def _required(self, column: str) -> Column:
        return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is a key and holds a null"))).otherwise(F.col(column)).alias(column)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, that in force by default."""
        held = self._held(self.version() if version is None else version)
        deltas = None
        for number, path in enumerate(held["deltas"]):
            one = self.spark.read.schema(self.schema).parquet(path).withColumn("_write", F.lit(number))
            deltas = one if deltas is None else deltas.unionByName(one)
        base = self._base(held["base"]) if held["base"] else None
        if deltas is None:
            return base if base is not None else self.spark.createDataFrame([], self.schema)
        # Dealt out as the base is: each bucket then meets its delta rows where it is read.
        new = self._one_per_key(deltas.repartition(self.buckets, *self.key), ["_write"])
        if base is None:
            return new.select(self.schema.names)
        # A delta's row has no null in its key, so the first of them tells whether there is one.
        old, hit = base.alias("old"), F.col(f"new.`{self.key[0]}`").isNotNull()
        both = old.join(new.alias("new"), [F.col(f"old.`{k}`") == F.col(f"new.`{k}`") for k in self.key], "full_outer")
        known = F.col(f"old.`{self.key[0]}`").isNotNull()
        value = {k: F.coalesce(F.col(f"old.`{k}`"), F.col(f"new.`{k}`")) for k in self.key}
        value |= {c: F.when(hit, F.col(f"new.`{c}`")).otherwise(F.col(f"old.`{c}`")) for c in self.set}
        value |= {c: F.when(known, F.col(f"old.`{c}`")).otherwise(F.col(f"new.`{c}`")) for c in self.keep}
        return both.select(*[value[c].alias(c) for c in self.schema.names])

    def upsert(self, rows: DataFrame) -> int:
        """Insert rows of new keys, update those of known ones; the number of the new version."""
        at = self.version()
        held = self._held(at)
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        one = self._one_per_key(typed, self.order).select(*[self._required(c) if c in self.key else F.col(f"`{c}`") for c in self.schema.names])
        path = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        one.write.parquet(path)
        done = self._publish(at, {"base": held["base"], "deltas": [*held["deltas"], path]})
        return self.compact() if len(held["deltas"]) + 1 >= self.most else done

    def compact(self) -> int:
        """Write base and deltas as a new base; the number of the new version, which reads like the one before."""
        at = self.version()
        path = f"{self.folder}/bases/{uuid.uuid4().hex}"
        self.read(at).write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", path).format("parquet").saveAsTable(self._name(path))
        return self._publish(at, {"base": path, "deltas": []})
