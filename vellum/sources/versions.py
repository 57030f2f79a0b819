"""Several tables that change together: partitions are replaced in new folders, one pointer moves last.

A store keeps each table in buckets of its key. A version is a small file that names, for every table
and bucket, the folder that holds it; the file CURRENT names the version in force. A change
writes the buckets that it touches into folders of its own, by dynamic partitions, then a version file,
then moves CURRENT. Readers take the folders of one version, so they see all tables of a change or none;
a change that fails in between leaves folders that no version names. Two changes at a time can't both
claim the next version: its file is made only where there is none.

The version file has (tables x buckets) entries, whatever the tables hold. A change reads and writes
the touched buckets only: their other rows are carried over, in one shuffle by bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.folders import read_text, write_text


class Store:
    """Tables in one folder, bucketed by one key column, read and replaced a version at a time."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schemas: Mapping[str, str], buckets: int = 16) -> None:
        self.spark, self.folder, self.key, self.schemas, self.buckets = spark, folder.rstrip("/"), key, dict(schemas), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The number of the version in force; 0 before the first."""
        return int(read_text(self.spark, f"{self.folder}/CURRENT") or 0)

    def _folders(self, version: int) -> dict[str, dict[str, str]]:
        return json.loads(read_text(self.spark, f"{self.folder}/versions/{version}") or "{}") if version else {}

    def read(self, table: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as of a version, that in force by default; only these buckets, if any are named."""
        held = self._folders(self.version() if version is None else version).get(table, {})
        paths = [path for bucket, path in held.items() if buckets is None or int(bucket) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def replace(self, rows: Mapping[str, DataFrame], keys: DataFrame, on_written: Callable[[str], None] = lambda table: None) -> int:
        """Replace all rows of these keys, in every table, by the given rows; the number of the new version.

        keys has the key column: keys without new rows lose what they had. on_written is called after each
        table's folders are written and before anything is published.
        """
        base = self.version()
        folders = self._folders(base)
        keys = keys.select(self.key).distinct()
        touched = {r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect()}  # `buckets` at most
        change = uuid.uuid4().hex
        for table, schema in self.schemas.items():
            columns = self.spark.createDataFrame([], schema).columns
            kept = self.read(table, base, touched).join(keys, self.key, "left_anti").select(columns)
            new = rows[table].join(keys, self.key, "left_semi").select(columns) if table in rows else kept.limit(0)
            path = f"{self.folder}/data/{change}/{table}"
            both = kept.unionByName(new).withColumn("bucket", self._bucket())
            both.repartition("bucket", self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
            on_written(table)
            filled = {r.bucket for r in self.spark.read.parquet(path).select("bucket").distinct().collect()} if touched and self._has_files(path) else set()
            held = folders.setdefault(table, {})
            for bucket in touched:
                held.pop(str(bucket), None)
                if bucket in filled:
                    held[str(bucket)] = f"{path}/bucket={bucket}"
        write_text(self.spark, f"{self.folder}/versions/{base + 1}", json.dumps(folders), replace=False)
        write_text(self.spark, f"{self.folder}/CURRENT", str(base + 1), replace=True)
        return base + 1

    def _has_files(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return any(f.isDirectory() for f in files.listStatus(where))
