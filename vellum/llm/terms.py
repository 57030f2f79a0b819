"""Terms of documents, and the choice of terms that tell labelled classes apart.

Terms are lower-cased words without ASCII punctuation at their ends, and the starts
of words (insults of one family share them), each at several counts: that a start
turns up five times says more than that it turns up once. Document frequencies are counted per class with Spark over a sample of
labelled rows whose expected number and bytes are bounded by parameters; the table of chosen
terms is bounded by another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import array_texts, staged

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Bytes of the word starts that count as terms besides whole words.
STARTS = (4, 5, 6, 7, 8)

#: A word or word start gives a term for each of these counts that it reaches in a text.
LEVELS = (1, 2, 3, 5)


def stems_of(raw: bytes) -> list[bytes]:
    """The word without punctuation at its ends, and its starts (marked as such by a trailing dash)."""
    word = raw.strip(PUNCTUATION)
    return [word, *[word[:n] + b"-" for n in STARTS if len(word) > n]] if word else []


def terms_of(text: bytes) -> set[bytes]:
    """Terms of a lower-cased text: word or word start, and the count level reached."""
    stems: Counter = Counter()
    for word, n in Counter(text.split()).items():
        for stem in stems_of(word):
            stems[stem] += n
    return {b"%d %s" % (level, stem) for stem, n in stems.items() for level in LEVELS if n >= level}


def shape_terms(text: bytes) -> set[bytes]:
    """Terms for a lower-cased text's shape: its length, symbols, digits, repetition and line ends, in steps."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    step = lambda x: min(20, int(20 * x))
    symbols = size - len(text.translate(None, PUNCTUATION))
    digits = size - len(text.translate(None, b"0123456789"))
    return {
        b"~length %d" % len(words).bit_length(),
        b"~symbols %d" % step(symbols / size),
        b"~digits %d" % step(digits / size),
        b"~distinct %d" % step(len(set(words)) / n),
        b"~shouts %d" % step(text.count(b"!") / n),
        b"~mean %d" % min(20, size // n),
    }


def lower_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """Each row's text in lower case (Unicode), null as empty."""
    return array_texts(batch.column(column), pc.utf8_lower)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, bound_bytes: int = 32 << 20, keep: str = "true", longest: int = 1 << 20) -> DataFrame:
    """About `bound` rows (doc_id, text, label, h) and `bound_bytes` of text at most, as a table.

    Ids are chosen by a hash of the id, rows by a hash of id and text (h), after counting each:
    an id may have many rows. Equal rows of an id count once; texts of over `longest`
    characters are no examples. label: SQL for the class. Rows of labels with the same doc_id
    count once, as the largest class among them.
    """
    said = labels.withColumn("label", F.expr(label).cast("int")).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").alias("label")).where(keep)
    n = said.count()
    below = lambda h, share: F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))
    if n > bound:
        said = said.where(below(F.xxhash64(F.lit(17), F.col("doc_id")), bound / n))
    # `bound` rows of an id and a label: small enough to broadcast at any size of input.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(said), "doc_id")
    rows = staged(rows.withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "h"]), "labelled_rows")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    share = min(1.0, 1.05 * bound / max(1, n), bound_bytes / max(1, size or 0))
    return rows if share >= 1 else staged(rows.where(below(F.xxhash64(F.lit(18), F.col("h")), share)), "labelled_sample")


def _frequencies(shape: bool):
    def pack(counts: dict[tuple[bytes, int], int]) -> pa.RecordBatch:
        arrays = [pa.array([t for t, _ in counts], pa.binary()), pa.array([c for _, c in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["term", "label", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            for text, label in zip(lower_texts(batch), batch.column("label").to_pylist(), strict=True):
                for term in terms_of(text) | (shape_terms(text) if shape else set()):
                    counts[term, label] = counts.get((term, label), 0) + 1
                if len(counts) > 100_000:  # Spark adds them up
                    yield pack(counts)
                    counts = {}
        yield pack(counts)

    return run


def document_frequencies(sample: DataFrame, shape: bool = False) -> DataFrame:
    """term, label, df: rows of the sample with each term, by label."""
    rows = sample.select("text", F.col("label").cast("int").alias("label"))
    return rows.mapInArrow(_frequencies(shape), "term binary, label int, df bigint").groupBy("term", "label").agg(F.sum("df").alias("df"))


def telling_terms(sample: DataFrame, classes: int, most: int, least_chi2: float = 30.0, shape: bool = False) -> tuple[list[tuple[bytes, list[int]]], list[int]]:
    """The `most` terms whose presence depends most on the class, with their document
    frequencies by class, and the rows by class. Chi-squared of the 2 x classes table.
    """
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [sizes.get(c, 0) for c in range(classes)]
    total = sum(rows)
    if not total:
        return [], rows
    by = document_frequencies(sample, shape).groupBy("term").agg(*[F.sum(F.when(F.col("label") == c, F.col("df")).otherwise(0)).alias(f"c{c}") for c in range(classes)])
    df = sum(F.col(f"c{c}") for c in range(classes))
    chi2 = F.lit(0.0)
    for c in range(classes):
        if rows[c]:
            expected = df * F.lit(rows[c] / total)
            absent = F.lit(float(rows[c])) - expected
            off = (F.col(f"c{c}") - expected) * (F.col(f"c{c}") - expected)
            chi2 = chi2 + off / expected + F.when(absent > 0, off / absent).otherwise(0.0)
    top = by.withColumn("chi2", chi2).where((F.col("chi2") >= least_chi2) & (df >= 3) & (F.length("term") > 0)).orderBy(F.desc("chi2"), "term").limit(most)
    return [(bytes(r["term"]), [r[f"c{c}"] for c in range(classes)]) for r in top.collect()], rows


class Vocabulary:
    """Chosen terms by number; which of them a text has."""

    def __init__(self, chosen: list[bytes]) -> None:
        self.shapes = {t: i for i, t in enumerate(chosen) if t.startswith(b"~")}
        # Stem -> (level, term number) of its chosen terms.
        self.stems: dict[bytes, list[tuple[int, int]]] = {}
        for i, term in enumerate(chosen):
            if i not in self.shapes.values():
                level, stem = term.split(b" ", 1)
                self.stems.setdefault(stem, []).append((int(level), i))
        # No stem without one of these first bytes: most words need no further look.
        self.heads = {stem[: STARTS[0]] for stem in self.stems}
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def numbers(self, text: bytes) -> list[int]:
        """Sorted numbers of the terms of a lower-cased text."""
        counts: dict[bytes, int] = {}
        known, stems, heads = self.known, self.stems, self.heads
        for word, n in Counter(text.split()).items():
            own = known.get(word)
            if own is None:
                head = word.strip(PUNCTUATION)[: STARTS[0]]
                own = tuple(s for s in stems_of(word) if s in stems) if head in heads else ()
                if len(known) < 100_000:  # a cache, bounded
                    known[word] = own
            for stem in own:
                counts[stem] = counts.get(stem, 0) + n
        out = [i for stem, n in counts.items() for level, i in stems[stem] if n >= level]
        if self.shapes:
            out += [self.shapes[t] for t in shape_terms(text) if t in self.shapes]
        return sorted(out)
