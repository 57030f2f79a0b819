"""Spelling variants: words within one edit of a far more frequent one, by Aho-Corasick halves.

1. *Words.* Runs of letters of every whole text are counted per Arrow batch, then by Spark.
2. *Segments.* One edit leaves one of a word's two halves whole: its first half opens, or its second
   half closes, every word within one edit, and their lengths differ by one at most. A word's
   two halves are its patterns, known by (length, place, segment).
3. *Shards.* Patterns are dealt to shards by a hash of what they are known by. A word is scanned in the shards
   of the segments that it could open or close with, six at most, instead of in all of them. Each shard
   builds an Aho-Corasick automaton of its segments; a scan gives the segments in
   the word, of which those at a wrong offset or of an incompatible length are dropped; the
   others' owners are compared letter by letter.
4. *Hot segments.* Where more than `owners` words share a pattern, what lies between the matched ends
   is halved again: the pattern becomes two longer ones, each again with a whole half. So candidates
   of a word stay bounded whatever a vocabulary shares, and none is lost.
5. *Forms.* Each word keeps the number of its near words and the most frequent one; roots follow
   by doubling steps over the words that have a form.

A pair is met once: by the second half only where the first doesn't match.

Edge cases: null and empty texts have no words; a null doc_id is the empty text before the
colon of the hashed key; rows that repeat count again; words of any length are segmented,
but an automaton holds at most 64 code points of a segment (owners are compared whole); ties of the
most frequent near word go to the smallest in code-point order; an empty table gives no words.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import staged, texts

#: Code points of a segment that an automaton holds.
HELD = 64

_FOUND = "word string, n_near bigint, top bigint, form string"


def _counted(least: int, noise: int):
    """Batches (doc_id, text) -> (word, n), a row for each word of a batch."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, int] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, lower=True), strict=True):
                own: dict[str, int] = {}
                for word in runs.findall(text.decode()):
                    own[word] = own.get(word, 0) + 1
                key = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), key)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    out[word] = out.get(word, 0) + n
                if len(out) > 200_000:
                    yield _count_batch(out)
                    out = {}
            yield _count_batch(out)

    return run


def _count_batch(out: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with one code point deleted from those runs whose
    key's crc32 `noise` divides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_length, noise), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced. lo and hi close in on it: what lies outside is the same in both."""
    if len(a) < len(b):
        a, b = b, a
    lo, hi = 0, len(b)
    if len(a) == hi:
        while hi - lo > 1:
            mid = (lo + hi) >> 1
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            elif a[mid:hi] == b[mid:hi]:
                hi = mid
            else:
                return False
        return a[lo:hi] != b[lo:hi]
    if len(a) != hi + 1:
        return False
    while lo < hi:
        mid = (lo + hi) >> 1
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        elif a[mid + 1 : hi + 1] == b[mid:hi]:
            hi = mid
        else:
            return False
    return True


class Owners:
    """Words of one length behind a pattern, whose matched ends have `start` and `end` code points; many are known by the halves
    of what lies between, one of which an edit leaves whole."""

    __slots__ = ("end", "firsts", "half", "lasts", "rows", "start")

    def __init__(self, start: int, end: int) -> None:
        self.start, self.end, self.rows, self.firsts = start, end, [], None

    def like(self, word: str) -> list[tuple[str, int, int, str, str]]:
        """Rows that may be near a word with these ends."""
        if len(self.rows) <= 4:
            return self.rows
        size = len(self.rows[0][0])
        if size - self.start - self.end < 2:
            return self.rows
        if self.firsts is None:
            self.half, self.firsts, self.lasts = (self.start + size - self.end) >> 1, {}, {}
            for row in self.rows:
                self.firsts.setdefault(row[0][self.start : self.half], []).append(row)
                self.lasts.setdefault(row[0][self.half : size - self.end], []).append(row)
        first = word[self.start : self.half]
        out = self.firsts.get(first, [])
        more = self.lasts.get(word[self.half + len(word) - size : len(word) - self.end])
        return out + [row for row in more if row[0][self.start : self.half] != first] if more else out


class Shard:
    """Owners by what they open and close with, and an automaton of these segments.

    Words are scanned as `^word$`, and segments held as `^segment` and `segment$`: only those at a word's ends are hit. One that
    opens keeps its owners by length and closing segment; one that closes, those that only close with it, by length."""

    def __init__(self) -> None:
        self.opens: dict[str, dict[int, dict[str, Owners]]] = {}
        self.closes: dict[str, dict[int, Owners]] = {}
        self.bare: dict[int, Owners] = {}
        self.automaton = None

    def add(self, word: str, n: int, opens: int, closes: int, unless: int) -> None:
        """unless: the pattern doesn't count for words that share so long a beginning (0: always counts)."""
        size = len(word)
        start, end = word[: min(opens, HELD)], word[size - min(closes, HELD) :] if closes else ""
        only_closes = self.closes.setdefault(end, {}) if end else self.bare
        by_key, key = (self.opens.setdefault(start, {}).setdefault(size, {}), end) if start else (only_closes, size)
        held = by_key.get(key)
        if held is None:
            held = by_key[key] = Owners(len(start), len(end))
        # Ends that an automaton doesn't hold whole are compared.
        held.rows.append((word, n, unless, word[:opens] if opens > HELD else "", word[size - closes :] if closes > HELD else ""))

    def _ready(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, by_size in self.opens.items():
            self.automaton.add_word(f"^{text}", (None, by_size))
        for text, by_size in self.closes.items():
            self.automaton.add_word(f"{text}$", (text, by_size))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, word: str) -> tuple[int, int, str]:
        """Near words of this one in the shard: their number, the largest count and its word."""
        if self.automaton is None:
            self._ready()
        last = len(word) - 1
        longest = last + 2
        found = [owners for size, owners in self.bare.items() if last <= size <= longest]
        opened, closing = [], [""]
        for _, (text, by_size) in self.automaton.iter(f"^{word}$") if len(self.automaton) else ():
            into = opened if text is None else found
            if text is not None:
                closing.append(text)
            for size, held in by_size.items():
                if last <= size <= longest:
                    into.append(held)
        for by_end in opened:
            found.extend(by_end[end] for end in closing if end in by_end)
        count, top, form = 0, 0, ""
        for owners in found:
            for other, n, unless, starts, ends in owners.like(word):
                if near(other, word) and word.startswith(starts) and word.endswith(ends) and not (unless and word.startswith(other[:unless])):
                    count += 1
                    if n > top or (n == top and other < form):
                        top, form = n, other
        return count, top, form


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, patterns before words to scan -> what each word finds in each shard."""
    number, shard, before = None, Shard(), None
    for batch in batches:
        found: tuple[list, list, list, list] = ([], [], [], [])
        for at, scans, word, n, opens, closes, unless in zip(*(batch.column(c).to_pylist() for c in ("shard", "scans", "word", "n", "opens", "closes", "unless")), strict=True):
            if at != number:
                number, shard, before = at, Shard(), None
            if not scans:
                shard.add(word, n, opens, closes, unless)
            elif word != before and (shard.opens or shard.closes or shard.bare):
                before = word
                count, top, form = shard.scan(word)
                if count:
                    for column, value in zip(found, (word, count, top, form), strict=True):
                        column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=["word", "n_near", "top", "form"])


def _known_by(size: Column, opens: Column, closes: Column) -> Column:
    """What a pattern of words of this size is known by: the length and both matched ends of `word`."""
    return F.xxhash64(size, opens, closes, F.substring("word", F.lit(1), opens), F.substring("word", F.length("word") - closes + 1, closes))


def _longer(rows: DataFrame) -> DataFrame:
    """Each pattern's two longer ones: what lies between its matched ends is halved."""
    half = F.floor((F.col("size") - F.col("opens") - F.col("closes")) / 2).cast("int")
    rest = F.col("size") - F.col("opens") - F.col("closes") - half
    left = F.struct((F.col("opens") + half).alias("opens"), F.col("closes").alias("closes"), F.col("unless").alias("unless"))
    right = F.struct(F.col("opens").alias("opens"), (F.col("closes") + rest).alias("closes"), (F.col("opens") + half).alias("unless"))
    kept = [c for c in rows.columns if c not in ("opens", "closes", "unless", "key")]
    out = rows.select(*kept, F.inline(F.array(left, right)))
    return out.withColumn("key", _known_by(F.col("size"), F.col("opens"), F.col("closes")))


def near_words(words: DataFrame, owners: int = 32, shard_patterns: int = 20_000) -> DataFrame:
    """words (word, n), distinct -> (word, n_near, top, form): for words with a near one, the number of
    near words, and the count and word of the most frequent.

    owners bounds the words behind a pattern before it is made longer, shard_patterns those in an
    automaton on average.
    """
    whole = [F.length("word").alias("size"), F.lit(0).alias("opens"), F.lit(0).alias("closes"), F.lit(0).alias("unless")]
    patterns = _longer(words.select("word", "n", *whole))
    sizes = F.sequence(F.length("word") - 1, F.length("word") + 1)
    scans = _longer(words.select("word", F.explode(sizes).alias("size"), *whole[1:]))
    shards = max(1, -(-2 * words.count() // shard_patterns))
    done: list[DataFrame] = []

    def settled(p: DataFrame, s: DataFrame) -> None:
        columns = ["shard", "scans", "word", "n", "opens", "closes", "unless"]
        shard = F.pmod("key", F.lit(shards)).alias("shard")
        owned = p.select(shard, F.lit(False).alias("scans"), "word", "n", "opens", "closes", "unless")
        asking = s.select(shard, F.lit(True).alias("scans"), "word", F.lit(0).cast("long").alias("n"), F.lit(0).alias("opens"), F.lit(0).alias("closes"), F.lit(0).alias("unless"))
        done.extend([owned.select(columns), asking.select(columns)])

    while True:
        # At two code points between the ends, owners are bounded by the alphabet.
        hot = staged(patterns.where("size - opens - closes > 2").groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > owners).select("key"), "hot_patterns")
        if hot.isEmpty():
            settled(patterns, scans)
            break
        settled(patterns.join(hot, "key", "left_anti"), scans.join(hot, "key", "left_anti"))
        patterns, scans = (staged(_longer(rows.join(hot, "key", "left_semi")), "longer_patterns") for rows in (patterns, scans))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionAll(more)
    found = rows.repartition("shard").sortWithinPartitions("shard", "scans", "word").mapInArrow(_scan, _FOUND)
    best = F.min(F.struct((-F.col("top")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("top"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), no cycles -> (word, root): the last form on the way, by doubling steps."""
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = further.select("word", "root")
        if further.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31, times: int = 10, owners: int = 32, shard_patterns: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word. times: how much more frequent a form is."""
    words = staged(word_counts(docs, least_length, least_count, noise), "words")
    found = near_words(words, owners, shard_patterns).withColumnsRenamed({"form": "candidate"})
    is_form = F.col("top") >= times * F.col("n")
    known = staged(
        words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("candidate")).alias("form"), F.when(is_form, F.col("top")).alias("form_n")),
        "near_words",
    )
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
