"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased (A-Z) runs without ASCII punctuation or white space. A document
and a test item become a pair if they share a seed of `least` tokens. The pair is
tiled: running Karp-Rabin matching finds the longest common runs of tokens that no
tile holds yet, marks them as tiles, and goes on with shorter ones down to `least`
tokens. Coverage is the share of the test's tokens in tiles. Tiles may lie in any
order, so a passage whose parts were moved about is covered like a straight copy.
Only document tokens inside seeds can be part of a tile; the others are left out.

A tile of n tokens holds n - least + 1 seeds, n / least at least. So a test of which `threshold`
is tiled has at least threshold / least times as many of its places start a shared seed, and
pairs with fewer are not tiled.

The test's seeds are broadcast if the benchmark has `broadcast_tokens` tokens at most
(counted first). A larger benchmark is joined. Documents emit the seeds that pass a filter of
2^27 bits made of the benchmark's; of each test, only as many of its rarest seeds (by documents)
are joined that every pair which can reach the threshold shares one. So seeds that very many
documents and tests have make no pairs by themselves; the pairs fetch their texts by key.

Edge cases: null and empty texts on either side give no pair; a test of fewer
than `least` tokens has no seed and flags nothing; repeated rows are reported one by
one; a null id is reported as null; without a benchmark nothing is flagged; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import staged, texts

_TABLE = bytes(c | 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
_BASE = 1_000_003
#: Bits of the filter of a joined benchmark's seeds.
_FILTER_BITS = 27


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _matches(test: list[int], doc: list[int], free_t: bytearray, free_d: bytearray, size: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked common runs of at least `size` tokens, by Karp-Rabin: (length, test, doc)."""
    mask = (1 << 61) - 1
    lead = pow(_BASE, size - 1, mask)

    def rolled(tokens: list[int], free: bytearray) -> Iterator[tuple[int, int]]:
        run, h = 0, 0
        for i, t in enumerate(tokens):
            if not free[i]:
                run, h = 0, 0
                continue
            if run == size:
                h = (h - tokens[i - size] * lead) % mask
            else:
                run += 1
            h = (h * _BASE + t) % mask
            if run == size:
                yield i - size + 1, h

    table: dict[int, list[int]] = {}
    for j, h in rolled(doc, free_d):
        table.setdefault(h, []).append(j)
    found = []
    for i, h in rolled(test, free_t):
        for j in table.get(h, ()):
            if i and j and free_t[i - 1] and free_d[j - 1] and test[i - 1] == doc[j - 1]:
                continue  # part of the run that starts further left
            n = 0
            while i + n < len(test) and j + n < len(doc) and free_t[i + n] and free_d[j + n] and test[i + n] == doc[j + n]:
                n += 1
            if n >= size:
                found.append((n, i, j))
    return found


def greedy_tiles(test: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, test position, document position); tokens below 0 match nothing."""
    free_t, free_d = bytearray(t >= 0 for t in test), bytearray(t >= 0 for t in doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(test), len(doc)) // 2)
    while True:
        found = sorted(_matches(test, doc, free_t, free_d, size), key=lambda m: (-m[0], m[1], m[2]))
        if not found and size == least:
            return tiles
        if not found:
            size = max(least, size // 2)
        for n, i, j in found:
            if not (all(free_t[i : i + n]) and all(free_d[j : j + n])):
                break  # what is left of it is found by the next pass, at its own length
            free_t[i : i + n] = bytes(n)
            free_d[j : j + n] = bytes(n)
            tiles.append((n, i, j))


def needed(tokens: int, least: int, threshold: float) -> int:
    """Places of a test that start a shared seed, at least, where the threshold is reached."""
    return max(1, math.ceil(threshold * tokens / least - 1e-9))


class TestSeeds:
    """Vocabulary, seeds and token numbers of a benchmark of bounded size."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, bytes]], least: int, threshold: float) -> None:
        self.least, self.threshold = least, threshold
        self.words: dict[bytes, int] = {}
        self.ids, self.tests = [], []
        seeds: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            test = [self.words.setdefault(w, len(self.words)) for w in tokens_of(text)]
            own, places = np.unique(self._seeds(np.array(test, np.int64)), return_counts=True)
            for h, n in zip(own.tolist(), places.tolist(), strict=True):
                seeds.setdefault(h, []).append((len(self.tests), n))
            self.ids.append(item_id)
            self.tests.append(test)
        self.hashes = np.array(sorted(seeds), np.int64)
        self.tests_of = [seeds[h] for h in self.hashes.tolist()]

    def _seeds(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens) - self.least + 1
        h = np.zeros(max(0, n), np.int64)
        for i in range(self.least):
            h = h * np.int64(0x5851F42D4C957F2D) + tokens[i : i + n]
        return h ^ (h >> 29)

    def tile(self, text: bytes) -> list[tuple[int | None, float, int, int, int]]:
        """item_id, coverage, tiles, matched tokens, longest tile for each test that shares a seed."""
        if not len(self.hashes):
            return []
        get = self.words.get
        tokens = np.array([get(w, -1) for w in tokens_of(text)], np.int64)
        if len(tokens) < self.least:
            return []
        h = self._seeds(tokens)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hits = np.flatnonzero(self.hashes[at] == h)
        shared: dict[int, int] = {}
        for s in set(at[hits].tolist()):
            for t, n in self.tests_of[s]:
                shared[t] = shared.get(t, 0) + n
        by_test: dict[int, list[int]] = {t: [] for t, n in shared.items() if n >= needed(len(self.tests[t]), self.least, self.threshold)}
        for p, s in zip(hits.tolist(), at[hits].tolist(), strict=True) if by_test else ():
            for t, _ in self.tests_of[s]:
                if t in by_test:
                    by_test[t].append(p)
        out = []
        for t, places in by_test.items():
            doc: list[int] = []
            end = -1
            for p in places:
                if end >= 0 and p > end:
                    doc.append(-1)
                doc += tokens[max(p, end) : p + self.least].tolist()
                end = p + self.least
            tiles = greedy_tiles(self.tests[t], doc, self.least)
            if tiles:
                matched = sum(n for n, _, _ in tiles)
                out.append((self.ids[t], matched / len(self.tests[t]), len(tiles), matched, max(n for n, _, _ in tiles)))
        return out


_HIT = "doc_id bigint, item_id bigint, coverage double, n_tiles int, matched int, longest int"


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _HIT.split(", ")])


def _places(least: int, known: np.ndarray | None = None, distinct: bool = True):
    """Rows (row, text) -> (row, seed, tokens): the text's seeds, of a filter's words those that pass, and its number of tokens."""

    def pack(row: list, seed: list, tokens: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, seed, tokens)], names=["row", "seed", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, seed, tokens = [], [], []
            for r, text in zip(batch.column("row").to_pylist(), texts(batch), strict=True):
                words = tokens_of(text)
                own = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + least])) for i in range(len(words) - least + 1)], np.uint64)
                own = np.unique(own) if distinct else own
                if known is not None:
                    bit = own >> np.uint64(64 - _FILTER_BITS)
                    own = own[(known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                row += [r] * len(own)
                seed += own.view(np.int64).tolist()
                tokens += [len(words)] * len(own)
                if len(row) > 500_000:
                    yield pack(row, seed, tokens)
                    row, seed, tokens = [], [], []
            yield pack(row, seed, tokens)

    return run


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A filter of 2^27 bits, one for the upper bits of each seed: 16 MB, however many seeds."""
    bit = F.shiftrightunsigned("seed", 64 - _FILTER_BITS)
    words = seeds.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _joined_tiles(docs: DataFrame, tests: DataFrame, least: int, threshold: float) -> DataFrame:
    """Tiled pairs by a join on the tests' rarest seeds, for a benchmark too large to broadcast."""
    numbered = lambda df, name: staged(df.withColumn("row", F.monotonically_increasing_id()), name)
    docs, tests = numbered(docs, "decontamination_docs"), numbered(tests, "decontamination_tests")
    schema = "row bigint, seed bigint, tokens bigint"
    places = staged(tests.select("row", "text").mapInArrow(_places(least, distinct=False), schema), "test_seeds")
    known = docs.sparkSession.sparkContext.broadcast(seed_filter(places))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _places(least, known.value)(batches)

    hits = staged(docs.select("row", "text").mapInArrow(passed, schema).drop("tokens"), "document_seeds")
    often = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    # Rarest first; seeds in no document stand before all others.
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("docs", F.lit(0)), "seed"))
    least_shared = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("tokens") / F.lit(least) - 1e-9))
    ranked = places.join(often, "seed", "left").withColumn("place", place).where(F.col("docs").isNotNull() & (F.col("place") <= F.col("tokens") - least + 2 - least_shared))
    rare = ranked.select(F.col("row").alias("test_row"), "seed").distinct()
    pairs = hits.join(rare, "seed").select("row", "test_row").distinct()
    both = pairs.join(docs, "row").join(tests.select(F.col("row").alias("test_row"), "item_id", F.col("text").alias("test")), "test_row").select("doc_id", "text", "item_id", "test")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, item_id, test in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("item_id").to_pylist(), texts(batch, "test"), strict=True):
                rows += [(doc_id, *hit) for hit in TestSeeds([(item_id, test)], least, threshold).tile(text)]
            yield _hits(rows)

    return both.mapInArrow(run, _HIT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, broadcast_tokens: int = 200_000) -> DataFrame:
    """Pairs (doc_id, item_id) of which at least `threshold` of the test is tiled, with coverage."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.length("text") + 1)).first()[0] or 0  # a token has a character at least
    if size <= 2 * broadcast_tokens:
        seeds = TestSeeds([(r["item_id"], r["text"].encode()) for r in tests.collect()], least, threshold)
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(seeds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cloudpickle.loads(shared.value)
            for batch in batches:
                yield _hits([(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True) for hit in own.tile(text)])

        hits = docs.mapInArrow(run, _HIT)
    else:
        hits = _joined_tiles(docs, tests, least, threshold)
    return hits.where(F.col("coverage") >= threshold)
