"""Readers and writers of the archive's files: JSON payloads, page structures, OCR tables, exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "object_class string, role string, text string, region_bbox array<double>, continues_hint string"
OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
CATALOG_PAGE = "total int, items array<struct<pointer int, title string, sortda string, standa string, filetype string>>"
STRUCTURE = "page string"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a page, one JSON array a file, in reading order; a malformed file fails the read."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in BLOCK.split(', '))}>>", {"mode": "FAILFAST"}).alias("blocks"))
    b = raw.select("file", F.posexplode("blocks").alias("pos", "b")).select("file", "pos", "b.*")
    complete = F.col("object_class").isNotNull() & F.col("text").isNotNull()
    return b.withColumn("object_class", F.when(complete, F.col("object_class")).otherwise(F.raise_error(F.lit("a block needs object_class and text"))))


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pages of a catalog listing, a file each, as one table of issues; repeats of a pointer count once."""
    p = spark.read.schema(CATALOG_PAGE).option("multiLine", True).json(paths)
    return p.select(F.explode("items").alias("i")).select("i.*").dropDuplicates(["pointer"])


def page_structure(rows: DataFrame) -> DataFrame:
    """(pointer, page: JSON text of one object or an array of them) -> (pointer, printed_page, page_record, title)."""
    shape = "array<struct<pageptr string, pagetitle string>>"
    one = F.from_json("page", "pageptr string, pagetitle string")
    many = F.when(F.startswith(F.trim("page"), F.lit("[")), F.from_json("page", shape)).otherwise(F.array(one))
    e = rows.select("pointer", F.posexplode(many).alias("pos", "p"))
    return e.select("pointer", (F.col("pos") + 1).alias("printed_page"), F.expr("try_cast(p.pageptr AS int)").alias("page_record"), F.col("p.pagetitle").alias("title"))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """An OCR table: words with normalised token, of confidence 40 and more, in page units."""
    t = spark.read.schema(OCR).option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path).withColumn("file", F.input_file_name())
    page = t.where("level = 1").select("file", F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    w = t.where("level = 5").withColumn("token", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")).where("token <> ''")
    scaled = [(F.col(a) / F.col(b)).alias(c) for a, b, c in (("left", "page_w", "x"), ("top", "page_h", "y"), ("width", "page_w", "w"), ("height", "page_h", "h"))]
    return w.join(page, "file").select("file", F.col("block_num").alias("block"), F.col("line_num").alias("line"), "word_num", "token", "conf", *scaled)


def ocr_blocks(words: DataFrame, least: float = 40.0) -> DataFrame:
    """Mean confidence of a block over all its words, and how many of them are kept."""
    return words.groupBy("file", "block").agg(F.round(F.avg("conf"), 6).alias("conf"), F.count_if(F.col("conf") >= least).alias("words"))


def unresolved(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed scan still has to look up."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def replayed(objects: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Objects (page, seq) with their recorded enrichment, keyed `page:seq`."""
    return objects.withColumn("key", F.concat_ws(":", "page", "seq")).join(fixtures, "key", "left").drop("key")


def export_json(df: DataFrame, folders: list[str], keep: Callable[[DataFrame], bool] = lambda d: not d.isEmpty()) -> bool:
    """Write one payload to several folders; an empty one never replaces a good export."""
    if not keep(df):
        return False
    for folder in folders:
        df.write.mode("overwrite").json(folder)
    return True


def first_available(*loaders: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read: live, committed, derived."""
    for i, load in enumerate(loaders):
        try:
            return load()
        except Exception:  # a missing source of any kind leads on to the next
            if i + 1 == len(loaders):
                raise
    raise ValueError("no source given")


def conform(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """A schema migration: columns that are missing come with their type and default; others are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(d)).cast(t).alias(c) for c, (t, d) in defaults.items()])


def merged_settings(stored: Column, defaults: Mapping[str, str]) -> Column:
    """A settings map: stored values over defaults."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    extra = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & k.isin(*defaults))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(extra, k), F.lit(False))), extra)


def reader_card(interests: Column, most: int = 3) -> Column:
    """A reader's interests: unique, in order, three at most; none is an error."""
    kept = F.slice(F.array_distinct(F.filter(interests, lambda i: i.isNotNull() & (i != ""))), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("a reader has an interest at least")).cast("array<string>"))


def voice_models(models: DataFrame) -> DataFrame:
    """Models (name, methods) that speak, by the numbers in their names, newest first."""
    speaking = models.where(F.lower("name").contains("tts") & F.array_contains("methods", "generateContent"))
    numbers = F.transform(F.regexp_extract_all("name", F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    return speaking.orderBy(F.desc(numbers), F.desc("name"))
