"""Positional and running computations: windows, folds, interval and overlap lookups, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import folds, kernels
from vellum.sources.tables import table
from vellum.sources.views import OBJECT_TOPICS_SQL, bare_objects, object_topics

# ── sequences ─────────────────────────────────────────────────────────────────────────────


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents stand for a page's blocks; every third is a filler."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", "line", (F.col("pos") % 3 == 0).alias("filler"))


_LINES = """b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  ln AS (SELECT *, pos % 3 = 0 AS filler FROM b)"""


def collapsed(blocks: DataFrame, page: str) -> DataFrame:
    """Blocks (page, pos, line, filler, ...): fillers with one key collapse into the first of their page.

    Adds occurrences, and seq, which numbers the kept rows anew from 0. An empty key is a key.
    """
    key = F.when(F.col("filler"), F.concat(F.lit("f"), T.filler_key(F.col("line")))).otherwise(F.concat(F.lit("p"), "pos"))
    w = Window.partitionBy(page, "_key")
    r = blocks.withColumn("_key", key).withColumn("_rn", F.row_number().over(w.orderBy("pos"))).withColumn("occurrences", F.count(F.lit(1)).over(w))
    return r.where("_rn = 1").drop("_key", "_rn").withColumn("seq", F.row_number().over(Window.partitionBy(page).orderBy("pos")) - 1)


def filler_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(_lines(spark, sf_dir), "doc_id").select("doc_id", "pos", "filler", "occurrences", "seq")


def resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers after the drop of lines without words."""
    kept = _lines(spark, sf_dir).where(T.strip(F.col("line")) != "")
    return kept.select("doc_id", "pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("seq"))


def ranked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three topics an object, in the order given; repeats keep their first rank, and ranks may gap."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object_id"), (F.col("l_partkey") % 12).cast("int").alias("topic_id"), "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("object_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    first = li.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return first.groupBy("object_id", "topic_id").agg(F.min("rank").alias("rank"))


def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines share a segment of 10 to 40 seconds in proportion to their length plus 14."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") + 14).alias("weight"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    upto, total = F.sum("weight").over(w), F.sum("weight").over(Window.partitionBy("conv_id"))
    at = lambda c: F.round(F.lit(10.0) + F.lit(30.0) * c / total, 6)
    return c.select("conv_id", "turn", at(upto - F.col("weight")).alias("t0"), at(upto).alias("t1"))


def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of segments on a track: a lead, and a gap between them, in samples at 24 kHz."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) * 400).alias("samples"))
    s = s.withColumn("track", F.floor(F.col("conv_id") / 50))
    before = F.coalesce(F.sum(F.col("samples") + 13200).over(Window.partitionBy("track").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.select("track", "conv_id", (before + 6000).alias("offset"), (before + 6000 + F.col("samples")).alias("until"))


def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each section's first footnote: one more than those of sections before it."""
    refs = object_topics(spark, sf_dir).groupBy("object_id").agg(F.count(F.lit(1)).alias("refs"))
    s = refs.withColumn("edition", F.floor(F.col("object_id") / 200))
    w = Window.partitionBy("edition").orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("edition", "object_id", "refs", (F.coalesce(F.sum("refs").over(w), F.lit(0)) + 1).alias("first_note"))


def line_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that plays at a listener's time, a hundred times a segment: an equi join on the segment, then a range."""
    t = line_times(spark, sf_dir)
    asks = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("conv_id"), F.round(F.lit(10.0) + F.col("event_id") % 30 + 0.5, 3).alias("t"))
    return asks.join(t, (asks["conv_id"] == t["conv_id"]) & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))).select("event_id", asks["conv_id"], "turn")


# ── folds ─────────────────────────────────────────────────────────────────────────────────


def pack(blocks: Column, cap: int) -> Column:
    """Greedy pack of structs (pos, id, n) in order: what doesn't fit is skipped, and packing goes on.

    Gives struct(used, kept, skipped).
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"), F.lit(0).alias("skipped"))

    def step(a: Column, b: Column) -> Column:
        fits = a["used"] + b["n"] <= cap
        return F.struct(F.when(fits, a["used"] + b["n"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["kept"], b["id"])).otherwise(a["kept"]).alias("kept"), F.when(fits, a["skipped"]).otherwise(a["skipped"] + 1).alias("skipped"))

    return F.aggregate(F.array_sort(blocks), start, step)


def corpus_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's documents packed into a budget of characters; a document that is too long is skipped.

    Only ids and lengths travel; the ids kept are at most as many as the budget has characters.
    """
    d = bare_objects(spark, sf_dir).select("issue_id", "id", (F.length("text") + 1).alias("n"))
    p = folds.packed(d, "issue_id", "id", "n", 40_000)
    fits = F.col("result") == 1
    ids = F.array_join(F.array_sort(F.collect_list(F.when(fits, F.col("id")))).cast("array<string>"), ",")
    return p.groupBy("issue_id").agg(F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("used"), F.count_if(fits).cast("int").alias("kept"), F.count_if(~fits).cast("int").alias("skipped"), ids.alias("ids"))


def chunks(spark: SparkSession, sf_dir: str, most: int = 3000) -> DataFrame:
    """Consecutive turns cut into chunks of at most so many characters; a longer turn is a chunk alone."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    cut = folds.chunked(c, "conv_id", "turn", "n", most)
    return cut.groupBy("conv_id", F.col("result").cast("int").alias("chunk")).agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"))


def slices(spark: SparkSession, sf_dir: str, height: int = 900, overlap: int = 90) -> DataFrame:
    """Overlapping vertical slices of a tall box, eight at most; the last one is clipped."""
    box = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("h"))
    n = F.when(F.col("h") <= height, 1).otherwise(F.least(F.lit(8), F.ceil((F.col("h") - overlap) / F.lit(float(height - overlap)))).cast("int"))
    step = F.when(F.col("n") > 1, (F.col("h") - overlap) / F.col("n")).otherwise(F.col("h").cast("double"))
    s = box.withColumn("n", n).withColumn("step", step).select("doc_id", "h", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    top = G.round_half_up(F.col("slice") * F.col("step"), 0)
    return s.select("doc_id", "slice", top.cast("long").alias("top"), F.least(F.lit(0.0) + F.col("h"), G.round_half_up(F.col("slice") * F.col("step") + F.col("step") + overlap, 0)).cast("long").alias("bottom"))


# ── geometry over rectangles made of embeddings ───────────────────────────────────────────


#: Boxes on a page.
PAGE_BOXES = 20


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: G.round_half_up(F.abs(F.get("embedding", F.lit(i))).cast("double") % 1.0, 4)
    b = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / PAGE_BOXES).alias("page"), F.col("label"), e(0).alias("x"), e(1).alias("y"), e(2).alias("w"), e(3).alias("h"), e(4).alias("score"))
    return b.withColumn("rect", F.array("x", "y", "w", "h"))


_R = lambda i: f"floor((abs(embedding[{i + 1}])::DOUBLE % 1.0) * 1e4 + 0.5) / 1e4"
_BOXES = f"bx AS (SELECT vec_id, vec_id // {PAGE_BOXES} AS page, label, {_R(0)} AS x, {_R(1)} AS y, {_R(2)} AS w, {_R(3)} AS h, {_R(4)} AS score FROM embeddings)"


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in reading order, by the column-banding fold."""
    b = _boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "x", "y")).alias("boxes"))
    return b.select("page", F.array_join(G.banded(F.col("boxes")), ",").alias("ids"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's usable rectangles, clamped, and the least rectangle around them."""
    b = _boxes(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list("rect")).alias("rects")).withColumn("rects", G.normal_region(F.col("rects")))
    u = G.union_box(F.col("rects"))
    total = F.aggregate("rects", F.lit(0.0), lambda a, r: a + G.area(r))
    return b.where("rects IS NOT NULL").select("page", F.size("rects").alias("n"), F.round(total, 6).alias("area"), *[F.round(F.get(u, F.lit(i)), 6).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])


def iou_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each new box's earlier box of most overlap on its page; none if it meets none."""
    b = _boxes(spark, sf_dir).select("vec_id", "page", "rect")
    new, old = b.where("vec_id % 2 = 1"), b.where("vec_id % 2 = 0").select(F.col("vec_id").alias("old_id"), "page", F.col("rect").alias("old"))
    pairs = new.join(old, "page").withColumn("iou", F.round(G.iou(F.col("rect"), F.col("old")), 9)).where("iou > 0")
    best = pairs.groupBy("vec_id").agg(F.max_by("old_id", F.struct("iou", -F.col("old_id"))).alias("old_id"), F.max("iou").alias("iou"))
    return new.select("vec_id").join(best, "vec_id", "left").select("vec_id", "old_id", F.round(F.coalesce("iou", F.lit(0.0)), 6).alias("iou"))


def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word centres that no grouped box of their page holds, within 0.002."""
    words = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("page"), ((F.col("event_id") * 37) % 1000 / 1000.0).alias("cx"), ((F.col("event_id") * 91) % 1000 / 1000.0).alias("cy"))
    b = _boxes(spark, sf_dir).select("page", "x", "y", "w", "h")
    e = 0.002
    inside = (words["page"] == b["page"]) & (F.col("cx") >= F.col("x") - e) & (F.col("cx") <= F.col("x") + F.col("w") + e) & (F.col("cy") >= F.col("y") - e) & (F.col("cy") <= F.col("y") + F.col("h") + e)
    return words.join(b, inside, "left_anti").select("event_id", "page")


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges moved to the nearest column edge, if one is within 0.015; the first of equals counts."""
    edges = F.array(*[F.lit(i / 8) for i in range(9)])
    near = F.array_min(F.transform(edges, lambda v, i: F.struct(F.round(F.abs(v - F.col("x")), 9).alias("d"), i.alias("i"), v.alias("v"))))
    return _boxes(spark, sf_dir).select("vec_id", F.when(near["d"] < 0.015, near["v"]).otherwise(F.col("x")).alias("x"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel crop of each page's largest box, 480 wide at most."""
    b = _boxes(spark, sf_dir).where("w > 0 AND h > 0")
    r = b.groupBy("page").agg(F.max_by(F.struct("vec_id", "x", "y", "w", "h"), F.struct(F.round(F.col("w") * F.col("h"), 9), -F.col("vec_id"))).alias("r"))
    px = lambda c, size: G.round_half_up(F.col(f"r.{c}") * size, 0).cast("long")
    p = r.select("page", F.col("r.vec_id").alias("vec_id"), px("x", 5332).alias("x"), px("y", 6845).alias("y"), px("w", 5332).alias("w"), px("h", 6845).alias("h"))
    wide = F.least(F.lit(480), F.col("w"))
    return p.select("page", "vec_id", F.format_string("/%d,%d,%d,%d/%d,/0/default.jpg", "x", "y", "w", "h", wide).alias("url"), G.round_half_up(wide * F.col("h") / F.col("w"), 0).cast("long").alias("height"))


def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes of a plausible area; a box without words needs an extent both ways."""
    a = F.col("w") * F.col("h")
    wordless = F.col("vec_id") % 3 == 0
    b = _boxes(spark, sf_dir).where(a.between(0.0004, 0.5) & (~wordless | ((F.col("w") >= 0.02) & (F.col("h") >= 0.02))))
    whole = (F.col("w") * F.col("h") >= 0.98) & (F.col("score") < 0.9)
    return b.select("vec_id", G.round_half_up(a, 4).alias("area"), whole.alias("whole_page"))


def rect_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in area order of a page's boxes listed in vec_id order; equal values are used once each."""
    b = _boxes(spark, sf_dir).withColumn("key", F.concat_ws(",", *[G.round_half_up(F.col(c), 1).cast("string") for c in ("x", "y")]))
    w = Window.partitionBy("page", "key")
    sized = b.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc(F.round(F.col("w") * F.col("h"), 9)), "vec_id")) - 1)
    a = sized.select("page", "key", "place", F.row_number().over(w.orderBy("place")).alias("use"))
    r = b.select("page", "key", "vec_id", F.row_number().over(w.orderBy("vec_id")).alias("use"))
    return r.join(a, ["page", "key", "use"]).select("page", "vec_id", "place")


def group_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box goes to the first group that names it; empty groups vanish; leftovers make groups of their own."""
    known = _boxes(spark, sf_dir).select("page", F.col("vec_id").alias("box"))
    named = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("box"), (F.col("l_suppkey") % 40).alias("grp"))
    first = named.groupBy("box").agg(F.min("grp").alias("grp")).join(known, "box").select("page", "box", "grp")
    left = known.join(first, ["page", "box"], "left_anti").select("page", "box", (F.col("box") + 1000).alias("grp"))
    both = first.withColumn("unplaced", F.lit(False)).unionByName(left.withColumn("unplaced", F.lit(True)))
    return both.select("page", "box", "unplaced", F.dense_rank().over(Window.partitionBy("page").orderBy("grp")).alias("grp"))


def clean_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid box of each id, clamped to the page, to four places."""
    b = _boxes(spark, sf_dir).withColumn("id", F.floor(F.col("vec_id") / 3)).where("w > 0.01 AND h > 0.01")
    r = b.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where("rn = 1")
    c = G.clamped(F.col("rect"))
    return r.select("id", "vec_id", *[G.round_half_up(F.get(c, F.lit(i)), 4).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


def class_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curator's class, else the transcriber's, else the grouper's; and whether the two machines agree."""
    k = F.col("event_id")
    say = lambda mod, names: F.get(F.array(*[F.lit(n) for n in names]), (k % mod).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", say(7, [None, "article", None, None, "coupon", None, None]).alias("curator"), say(4, ["article", None, "coupon", "listing"]).alias("transcriber"), say(3, ["article", "listing", "coupon"]).alias("grouper"))
    by = F.when(F.col("curator").isNotNull(), "curator").when(F.col("transcriber").isNotNull(), "transcriber").otherwise("grouper")
    return e.select("event_id", F.coalesce("curator", "transcriber", "grouper").alias("object_class"), by.alias("decided_by"), F.col("transcriber").eqNullSafe(F.col("grouper")).alias("agreed"))


def edit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits after a log of operations: each counts one, an undo takes one back, never below zero."""
    ops = F.transform(F.sequence(F.lit(1), (F.col("user_id") % 6 + 1).cast("int")), lambda i: F.when((i + F.col("event_id")) % 3 == 0, "undo").otherwise("move"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("edits"), ops.alias("ops"))
    undone = F.size(F.filter("ops", lambda o: o == "undo"))
    return e.select("event_id", F.greatest(F.lit(0), F.col("edits") + F.size(F.slice("ops", 1, 500)) - 2 * undone).cast("long").alias("edits"), F.size("ops").alias("log_size"))


def _word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("page", F.col("vec_id").alias("id"), "x", "y", "w", (F.col("h") / 20).alias("h"), (F.col("vec_id") % 9).alias("words"))


def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_page(_word_lines(spark, sf_dir), kernels.merged_gaps, "page bigint, place bigint, x0 double, x1 double, y0 double, y1 double, words bigint")


def column_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 400).alias("page"), (F.floor(F.col("event_id") % 5 * 20 + F.col("user_id") % 2) / 100.0).alias("x"), F.lit(0.17).alias("w"))
    return kernels.per_page(lines, kernels.column_grid, "page bigint, place bigint, left_edge double, right_edge double, lines bigint")


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("page", F.col("vec_id").alias("id"), "x", "y", "w", "h", "score")
    return kernels.per_page(b, kernels.keep_best, "page bigint, id bigint, x double, y double, w double, h double, score double").select("page", "id", "score")


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of confidence 40 and more, and mean confidences, per page of 300 words; 0 where there are none."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 300).alias("page"), (F.col("user_id") % 7).alias("block"), (F.col("event_id") * 13 % 100).alias("conf"))
    per = e.groupBy("page", "block").agg(F.count(F.lit(1)).alias("all_words"), F.count_if(F.col("conf") >= 40).alias("words"), F.round(F.avg("conf"), 6).alias("block_conf"))
    return per.groupBy("page").agg(F.sum("words").alias("words"), F.round(F.sum(F.col("block_conf") * F.col("all_words")) / F.sum("all_words"), 3).alias("conf"), F.round(F.max("block_conf"), 4).alias("best_block"))


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and tokens, in order, of each line's words."""
    b = _boxes(spark, sf_dir).withColumn("line", F.col("label"))
    g = b.groupBy("page", "line").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count(F.lit(1)).alias("words"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return g.select("page", "line", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "words", F.array_join("ids", " ").alias("tokens"))


def cosine_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k nearest vectors, by cosine, of every fiftieth one: a stated query set against all rows.

    Queries and rows go in blocks of bounded size; a pair of blocks is one matrix product in
    one task, which hands on k rows a query. Nothing is broadcast.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = e.mapInArrow(kernels.vector_blocks(4096), "ids array<bigint>, units binary")
    queries = e.where("vec_id % 50 = 0").mapInArrow(kernels.vector_blocks(512), "ids array<bigint>, units binary").toDF("query_ids", "query_units")
    pairs = queries.hint("shuffle_replicate_nl").crossJoin(blocks)
    s = pairs.mapInArrow(kernels.nearest_in_blocks(k), "query_id bigint, vec_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a document's identity as canonical text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", "text"), 256).alias("content_hash"))


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ids, and whether a signature that was handed in is right."""
    s = table(spark, sf_dir, "benchmark").select("item_id", kernels.signature(F.concat(F.lit("item:"), "item_id"), "example-secret").alias("signature"))
    return s.withColumn("valid", F.length("signature") == 64)


QUERIES = {
    f.__name__: f
    for f in (
        filler_collapse, resequence, ranked_tags, line_times, segment_offsets, footnotes, line_at, corpus_pack, chunks, slices, reading_order, regions, iou_best, uncovered, snap, crops, box_filter, rect_order,
        group_claims, clean_boxes, class_precedence, edit_delta, gap_merge, column_grid, nms, ocr_pages, line_boxes, cosine_topk, content_hash, signature,
    )
}

_PADS = kernels.hmac_pads("example-secret")

_TIMES = """tm0 AS (SELECT conv_id, turn, length(text) + 14 AS weight FROM conversations),
  tm AS (SELECT conv_id, turn, round(10.0::DOUBLE + 30.0::DOUBLE * (sum(weight) OVER w - weight) / sum(weight) OVER p, 6) AS t0, round(10.0::DOUBLE + 30.0::DOUBLE * (sum(weight) OVER w) / sum(weight) OVER p, 6) AS t1
         FROM tm0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id))"""
_KEY = r"CASE WHEN filler THEN 'f' || trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g')) ELSE 'p' || pos END"
_IOU = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0.0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0.0))"

ORACLE_SQL = {
    "filler_collapse": f"""WITH {_LINES}, k AS (SELECT *, {_KEY} AS key FROM ln), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id, key) AS occurrences FROM k)
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, filler, occurrences, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq FROM r WHERE rn = 1""",
    "resequence": rf"""WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq FROM ln
      WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""",
    "ranked_tags": """WITH r AS (SELECT l_orderkey AS object_id, CAST(l_partkey % 12 AS INTEGER) AS topic_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem)
      SELECT object_id, topic_id, CAST(min(rank) AS INTEGER) AS rank FROM r WHERE rank <= 3 GROUP BY 1, 2""",
    "line_times": f"WITH {_TIMES} SELECT conv_id, turn, t0, t1 FROM tm",
    "segment_offsets": """WITH s AS (SELECT conv_id, conv_id // 50 AS track, CAST(sum(length(text)) * 400 AS BIGINT) AS samples FROM conversations GROUP BY 1),
        b AS (SELECT *, CAST(coalesce(sum(samples + 13200) OVER (PARTITION BY track ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 6000 AS off FROM s)
      SELECT track, conv_id, off AS "offset", off + samples AS until FROM b""",
    "footnotes": f"""WITH ot AS ({OBJECT_TOPICS_SQL}), r AS (SELECT object_id // 200 AS edition, object_id, count(*) AS refs FROM ot GROUP BY object_id)
      SELECT edition, object_id, refs, CAST(coalesce(sum(refs) OVER (PARTITION BY edition ORDER BY object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 AS first_note FROM r""",
    "line_at": f"""WITH {_TIMES}, q AS (SELECT event_id, event_id // 100 AS conv_id, round(10.0::DOUBLE + event_id % 30 + 0.5, 3) AS t FROM events)
      SELECT q.event_id, q.conv_id, tm.turn FROM q JOIN tm ON tm.conv_id = q.conv_id AND q.t >= tm.t0 AND q.t < tm.t1""",
    "corpus_pack": """WITH g AS (SELECT source || '-' || doc_id // 500 AS issue_id, list({'id': doc_id, 'n': length(text) + 1} ORDER BY doc_id) AS bs FROM documents GROUP BY 1),
        p AS (SELECT issue_id, list_reduce(list_prepend({'used': 0::BIGINT, 'ids': []::BIGINT[], 'skipped': 0, 'id': 0::BIGINT, 'n': 0::BIGINT},
              list_transform(bs, lambda b: {'used': 0::BIGINT, 'ids': []::BIGINT[], 'skipped': 0, 'id': b.id, 'n': b.n::BIGINT})),
            lambda a, b: {'used': CASE WHEN a.used + b.n <= 40000 THEN a.used + b.n ELSE a.used END, 'ids': CASE WHEN a.used + b.n <= 40000 THEN list_append(a.ids, b.id) ELSE a.ids END,
              'skipped': CASE WHEN a.used + b.n <= 40000 THEN a.skipped ELSE a.skipped + 1 END, 'id': 0::BIGINT, 'n': 0::BIGINT}) AS r FROM g)
      SELECT issue_id, r.used AS used, CAST(len(r.ids) AS INTEGER) AS kept, r.skipped AS skipped, array_to_string(r.ids, ',') AS ids FROM p""",
    "chunks": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
        f AS (SELECT conv_id, turn, rn, n AS used, 0 AS chunk FROM c WHERE rn = 1
          UNION ALL SELECT c.conv_id, c.turn, c.rn, CASE WHEN f.used > 0 AND f.used + c.n > 3000 THEN c.n ELSE f.used + c.n END, CASE WHEN f.used > 0 AND f.used + c.n > 3000 THEN f.chunk + 1 ELSE f.chunk END
          FROM f JOIN c ON c.conv_id = f.conv_id AND c.rn = f.rn + 1)
      SELECT conv_id, chunk, min(turn) AS first_turn, count(*) AS turns FROM f GROUP BY 1, 2""",
    "slices": """WITH b AS (SELECT doc_id, n_chars AS h, CASE WHEN n_chars <= 900 THEN 1 ELSE least(8, CAST(ceil((n_chars - 90) / 810.0) AS INTEGER)) END AS n FROM documents),
        s AS (SELECT doc_id, h, CASE WHEN n > 1 THEN (h - 90)::DOUBLE / n ELSE h::DOUBLE END AS step, unnest(range(n)) AS slice FROM b)
      SELECT doc_id, CAST(slice AS INTEGER) AS slice, CAST(floor(slice * step + 0.5) AS BIGINT) AS top, CAST(least(h::DOUBLE, floor(slice * step + step + 90 + 0.5)) AS BIGINT) AS bottom FROM s""",
    "reading_order": f"""WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, vec_id) AS rn FROM bx),
        f AS (SELECT page, vec_id, x, y, rn, x AS lft, 0 AS band FROM o WHERE rn = 1
          UNION ALL SELECT o.page, o.vec_id, o.x, o.y, o.rn, CASE WHEN o.x - f.lft > 0.02 THEN o.x ELSE f.lft END, CASE WHEN o.x - f.lft > 0.02 THEN f.band + 1 ELSE f.band END FROM f JOIN o ON o.page = f.page AND o.rn = f.rn + 1)
      SELECT page, string_agg(vec_id, ',' ORDER BY band, y, vec_id) AS ids FROM f GROUP BY 1""",
    "regions": f"""WITH {_BOXES}, c AS (SELECT page, x, y, least(w, 1 - x) AS w, least(h, 1 - y) AS h FROM bx WHERE w > 0 AND h > 0)
      SELECT page, CAST(count(*) AS INTEGER) AS n, round(sum(w * h), 6) AS area, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h FROM c GROUP BY 1""",
    "iou_best": f"""WITH {_BOXES}, p AS (SELECT a.vec_id, b.vec_id AS old_id, round({_IOU} / (a.w * a.h + b.w * b.h - {_IOU}), 9) AS iou FROM bx a JOIN bx b ON a.page = b.page AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 WHERE {_IOU} > 0),
        r AS (SELECT * FROM p WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY iou DESC, old_id) = 1)
      SELECT bx.vec_id, r.old_id, round(coalesce(r.iou, 0.0), 6) AS iou FROM bx LEFT JOIN r USING (vec_id) WHERE bx.vec_id % 2 = 1""",
    "uncovered": f"""WITH {_BOXES}, q AS (SELECT event_id, event_id // 100 AS page, (event_id * 37) % 1000 / 1000.0::DOUBLE AS cx, (event_id * 91) % 1000 / 1000.0::DOUBLE AS cy FROM events)
      SELECT event_id, page FROM q WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.page = q.page AND cx >= x - 0.002::DOUBLE AND cx <= x + w + 0.002::DOUBLE AND cy >= y - 0.002::DOUBLE AND cy <= y + h + 0.002::DOUBLE)""",
    "snap": f"""WITH {_BOXES}, d AS (SELECT vec_id, x, i / 8.0::DOUBLE AS v, i, round(abs(i / 8.0::DOUBLE - x), 9) AS dist FROM bx, range(9) r(i)),
        m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, i) = 1)
      SELECT vec_id, CASE WHEN dist < 0.015 THEN v ELSE x END AS x FROM m""",
    "crops": f"""WITH {_BOXES}, r AS (SELECT * FROM bx WHERE w > 0 AND h > 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY round(w * h, 9) DESC, vec_id) = 1),
        p AS (SELECT page, vec_id, CAST(floor(x * 5332 + 0.5) AS BIGINT) AS x, CAST(floor(y * 6845 + 0.5) AS BIGINT) AS y, CAST(floor(w * 5332 + 0.5) AS BIGINT) AS w, CAST(floor(h * 6845 + 0.5) AS BIGINT) AS h FROM r)
      SELECT page, vec_id, printf('/%d,%d,%d,%d/%d,/0/default.jpg', x, y, w, h, least(480, w)) AS url, CAST(floor(least(480, w) * h / w::DOUBLE + 0.5) AS BIGINT) AS height FROM p""",
    "box_filter": f"""WITH {_BOXES} SELECT vec_id, floor(w * h * 1e4 + 0.5) / 1e4 AS area, w * h >= 0.98 AND score < 0.9 AS whole_page FROM bx
      WHERE w * h BETWEEN 0.0004 AND 0.5 AND (vec_id % 3 <> 0 OR (w >= 0.02 AND h >= 0.02))""",
    "rect_order": f"""WITH {_BOXES}, k AS (SELECT *, floor(x * 10 + 0.5) / 10 AS kx, floor(y * 10 + 0.5) / 10 AS ky, row_number() OVER (PARTITION BY page ORDER BY round(w * h, 9) DESC, vec_id) - 1 AS place FROM bx),
        a AS (SELECT page, kx, ky, place, row_number() OVER (PARTITION BY page, kx, ky ORDER BY place) AS u FROM k), r AS (SELECT page, kx, ky, vec_id, row_number() OVER (PARTITION BY page, kx, ky ORDER BY vec_id) AS u FROM k)
      SELECT r.page, r.vec_id, CAST(a.place AS INTEGER) AS place FROM r JOIN a USING (page, kx, ky, u)""",
    "group_claims": f"""WITH k AS (SELECT vec_id // {PAGE_BOXES} AS page, vec_id AS box FROM embeddings), n AS (SELECT l_orderkey // {PAGE_BOXES} AS page, l_suppkey % 40 AS grp, l_orderkey AS box FROM lineitem),
        f AS (SELECT page, box, min(grp) AS grp FROM n JOIN k USING (page, box) GROUP BY 1, 2),
        b AS (SELECT page, box, grp, false AS unplaced FROM f UNION ALL SELECT page, box, box + 1000, true FROM k WHERE (page, box) NOT IN (SELECT (page, box) FROM f))
      SELECT page, box, unplaced, CAST(dense_rank() OVER (PARTITION BY page ORDER BY grp) AS INTEGER) AS grp FROM b""",
    "clean_boxes": f"""WITH {_BOXES}, v AS (SELECT *, vec_id // 3 AS id FROM bx WHERE w > 0.01 AND h > 0.01 QUALIFY row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id) = 1)
      SELECT id, vec_id, floor(x * 1e4 + 0.5) / 1e4 AS x, floor(y * 1e4 + 0.5) / 1e4 AS y, floor(least(w, 1 - x) * 1e4 + 0.5) / 1e4 AS w, floor(least(h, 1 - y) * 1e4 + 0.5) / 1e4 AS h FROM v""",
    "class_precedence": """WITH e AS (SELECT event_id, ([NULL, 'article', NULL, NULL, 'coupon', NULL, NULL])[event_id % 7 + 1] AS c, (['article', NULL, 'coupon', 'listing'])[event_id % 4 + 1] AS t, (['article', 'listing', 'coupon'])[event_id % 3 + 1] AS g FROM events)
      SELECT event_id, coalesce(c, t, g) AS object_class, CASE WHEN c IS NOT NULL THEN 'curator' WHEN t IS NOT NULL THEN 'transcriber' ELSE 'grouper' END AS decided_by, t IS NOT DISTINCT FROM g AS agreed FROM e""",
    "edit_delta": """WITH e AS (SELECT event_id, event_id % 4 AS edits, user_id % 6 + 1 AS n FROM events)
      SELECT event_id, greatest(0, edits + n - 2 * len(list_filter(range(1, n + 1), lambda i: (i + event_id) % 3 = 0))) AS edits, CAST(n AS INTEGER) AS log_size FROM e""",
    "ocr_pages": """WITH e AS (SELECT event_id // 300 AS page, user_id % 7 AS block, event_id * 13 % 100 AS conf FROM events),
        b AS (SELECT page, block, count(*) AS n, count(*) FILTER (WHERE conf >= 40) AS words, round(avg(conf), 6) AS c FROM e GROUP BY 1, 2)
      SELECT page, CAST(sum(words) AS BIGINT) AS words, round(sum(c * n) / sum(n), 3) AS conf, round(max(c), 4) AS best_block FROM b GROUP BY 1""",
    "line_boxes": f"""WITH {_BOXES} SELECT page, label AS line, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x + w), 6) AS x1, round(max(y + h), 6) AS y1, count(*) AS words, string_agg(vec_id, ' ' ORDER BY vec_id) AS tokens FROM bx GROUP BY 1, 2""",
    "cosine_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
      SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS place FROM s QUALIFY place <= 5""",
    "content_hash": "SELECT doc_id, sha256(concat_ws('|', lang, source, text)) AS content_hash FROM documents",
    "nms": f"""WITH {_BOXES}, g AS (SELECT page, list({{'id': vec_id, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score}} ORDER BY score DESC, vec_id) AS bs FROM bx GROUP BY 1),
        r AS (SELECT page, list_reduce(list_prepend(bs[1:0], list_transform(bs, lambda b: [b])), lambda a, o: CASE WHEN len(list_filter(a, lambda b:
            greatest(least(b.x + b.w, o[1].x + o[1].w) - greatest(b.x, o[1].x), 0.0) * greatest(least(b.y + b.h, o[1].y + o[1].h) - greatest(b.y, o[1].y), 0.0)
            / greatest(b.w * b.h + o[1].w * o[1].h - greatest(least(b.x + b.w, o[1].x + o[1].w) - greatest(b.x, o[1].x), 0.0) * greatest(least(b.y + b.h, o[1].y + o[1].h) - greatest(b.y, o[1].y), 0.0), 1e-12) > 0.1)) = 0
            THEN list_concat(a, o) ELSE a END) AS kept FROM g),
        u AS (SELECT page, unnest(kept) AS b FROM r)
      SELECT page, b.id AS id, b.score AS score FROM u""",
    "gap_merge": f"""WITH {_BOXES}, ln AS (SELECT page, vec_id AS id, x, y, w, h / 20 AS h, vec_id % 9 AS words FROM bx WHERE vec_id % 9 >= 3),
        g AS (SELECT page, 2 * (list(h ORDER BY h))[count(*) // 2 + 1] AS reach, list({{'x0': x, 'x1': x + w, 'y0': y, 'y1': y + h, 'words': words}} ORDER BY y, x, id) AS ls FROM ln GROUP BY 1),
        r AS (SELECT page, list_reduce(list_prepend(ls[1:0], list_transform(ls, lambda l: [l])), lambda a, o: CASE
            WHEN len(list_filter(a, lambda b: least(o[1].x1, b.x1) - greatest(o[1].x0, b.x0) > 0.5 * least(o[1].x1 - o[1].x0, b.x1 - b.x0) AND o[1].y0 - b.y1 < reach)) = 0 THEN list_concat(a, o)
            ELSE list_transform(a, lambda b, i: CASE WHEN i = list_position(list_transform(a, lambda c: least(o[1].x1, c.x1) - greatest(o[1].x0, c.x0) > 0.5 * least(o[1].x1 - o[1].x0, c.x1 - c.x0) AND o[1].y0 - c.y1 < reach), true)
              THEN {{'x0': least(b.x0, o[1].x0), 'x1': greatest(b.x1, o[1].x1), 'y0': b.y0, 'y1': greatest(b.y1, o[1].y1), 'words': b.words + o[1].words}} ELSE b END) END) AS gaps FROM g),
        u AS (SELECT page, unnest(gaps) AS b FROM r)
      SELECT page, row_number() OVER (PARTITION BY page ORDER BY b.words DESC, b.y0, b.x0) - 1 AS place, b.x0 AS x0, b.x1 AS x1, b.y0 AS y0, b.y1 AS y1, b.words AS words FROM u WHERE b.words >= 5""",
    "column_grid": """WITH ln AS (SELECT event_id // 400 AS page, floor(event_id % 5 * 20 + user_id % 2) / 100.0::DOUBLE AS x FROM events),
        n AS (SELECT page, greatest(6.0, count(*) / 120.0::DOUBLE) AS least_n FROM ln GROUP BY 1),
        h AS (SELECT page, bin, coalesce(k.n, 0) AS n FROM (SELECT page, unnest(range(200)) AS bin FROM n) b LEFT JOIN (SELECT page, least(199, greatest(0, CAST(floor(x * 200) AS BIGINT))) AS bin, count(*) AS n FROM ln GROUP BY 1, 2) k USING (page, bin)),
        q AS (SELECT *, lag(n, 1, -1) OVER w AS before, lead(n, 1, -1) OVER w AS after FROM h WINDOW w AS (PARTITION BY page ORDER BY bin)),
        p AS (SELECT page, list(bin / 200.0::DOUBLE ORDER BY bin) AS ps FROM q JOIN n USING (page) WHERE q.n >= least_n AND q.n >= before AND q.n > after GROUP BY 1),
        s AS (SELECT page, list_reduce(list_transform(ps, lambda v: [v]), lambda a, o: CASE WHEN o[1] - a[len(a)] >= 0.04::DOUBLE THEN list_concat(a, o) ELSE a END) AS st FROM p),
        d AS (SELECT page, st, list_sort(list_transform(range(1, len(st)), lambda i: st[i + 1] - st[i])) AS pitch FROM s),
        f AS (SELECT page, CASE WHEN len(pitch) = 0 THEN st ELSE list_transform(list_filter(range(1, len(st) + 1), lambda i: i = len(st) OR st[i + 1] - st[i] >= pitch[len(pitch) // 2 + 1] / 2), lambda i: st[i]) END AS st FROM d),
        e AS (SELECT page, i - 1 AS place, st[i] AS left_edge, coalesce(st[i + 1], 9.0) AS next FROM (SELECT page, st, unnest(range(1, len(st) + 1)) AS i FROM f)),
        o AS (SELECT e.page, place, left_edge, list(x + 0.17::DOUBLE ORDER BY x) FILTER (WHERE x IS NOT NULL) AS own FROM e LEFT JOIN ln ON ln.page = e.page AND x >= left_edge - 0.5 / 200::DOUBLE AND x < next - 0.5 / 200::DOUBLE GROUP BY 1, 2, 3)
      SELECT page, place, left_edge, CASE WHEN len(own) > 0 THEN own[CAST(floor(0.95::DOUBLE * len(own)) AS BIGINT) + 1] ELSE left_edge END AS right_edge, CAST(coalesce(len(own), 0) AS BIGINT) AS lines FROM o""",
    "signature": f"""SELECT item_id, sha256(unhex('{_PADS[1].hex()}') || unhex(sha256(unhex('{_PADS[0].hex()}') || encode('item:' || item_id)))) AS signature, true AS valid FROM benchmark""",
}
