"""SimHash near-deduplication with pivot distance tables.

Fingerprints. Word shingles are hashed with XXH64 (seed 42); a fingerprint bit is
set where more than half of the hashes have it. Tasks work on Arrow batches.

Candidates. Equal fingerprints are one node (a group of exact copies is one row
after Spark's partial aggregation). A fingerprint's 64 bits make `blocks` blocks;
two fingerprints at distance d or less agree in at least blocks - d whole blocks,
so they share the key of some choice of that many. Each choice deals the
fingerprints out by key: with 6 blocks and d = 3 that is 20 keys of 31 to 33 bits, so
that unrelated fingerprints seldom meet at any corpus size.

Pivots. Distances to reference fingerprints alone don't index 64-bit hashes:
unrelated ones lie at 32 +- 4 bits from any pivot, so intervals of +- 3 discard only
about half of the pairs per pivot, and every pair would have to be looked at. So
the distance tables work inside a key's group: every row carries its distances to
`PIVOTS`; rows are sorted by the distance to the first, which gives each row a
window of at most d to look into; a pair whose distances to any pivot differ by
more than d can't be within d of each other, and is discarded; survivors are
verified, and a spanning forest of each group goes on, so links number less than
keyed rows. A group that holds more than `group_rows` rows is dealt out once more, by its
key and by choices of blocks of the bits that the key leaves open: a link agrees in one of
these, too. That leaves 16 bits open, so that no group holds over 65,536 fingerprints.

Groups of linked fingerprints are connected components; a component is named by
its smallest doc_id.

Edge cases: null, empty and blank texts have fingerprint zero and link like any
other; a text with fewer words than a shingle is hashed whole; a null doc_id counts
as smaller than any other, and its component_id is null; repeated rows are
answered one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import id_values, staged, texts
from vellum.llm.components import with_components

NULL_ID = -(2**63)

#: Reference fingerprints, from a fixed multiplicative generator.
PIVOTS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(16)]


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of so many words, or of the whole shorter text."""
    tokens = text.split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is set if it is set in over half of the hashes; no hashes: 0."""
    if not hashes:
        return 0
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[lo : lo + (1 << 16)], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t, words)) for t in texts(batch, lower=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(id_values(batch)), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id (null: the smallest long), fp as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_choices(distance: int, blocks: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of the bits `within`, cut into blocks: one for each choice of as many blocks as a link agrees in."""
    bits = [b for b in range(64) if within >> b & 1]
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def block_keys(distance: int, blocks: int) -> Column:
    """One (choice, bits) key for each choice of blocks that a link must agree in."""
    chosen = block_choices(distance, blocks)
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(chosen)])


def finer_keys(distance: int, blocks: int) -> Column:
    """The keys of a row of a hot key: its choice's bits, and a choice among blocks of the other bits, which
    a link with that key must agree in as well."""
    all_bits = (1 << 64) - 1
    finer = [[_signed(m | x) for x in block_choices(distance, blocks, all_bits & ~m)] for m in block_choices(distance, blocks)]
    masks = F.element_at(F.array(*[F.array(*[F.lit(x) for x in own]) for own in finer]), F.col("choice") + 1)
    return F.transform(masks, lambda m, i: F.xxhash64(F.lit(1), F.col("choice"), i, F.col("fp").bitwiseAND(m)))


def pivot_table(fps: np.ndarray, pivots: int = len(PIVOTS)) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to the pivots: rows x pivots."""
    return np.stack([np.bitwise_count(fps ^ np.uint64(p)) for p in PIVOTS[:pivots]], axis=1).astype(np.int8)


def linked_blocks(fps: np.ndarray, distance: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of distinct fingerprints within distance, by the pivot table, block by block."""
    if len(fps) < 2:
        return
    table = pivot_table(fps, 4 if len(fps) < 64 else len(PIVOTS))
    order = np.argsort(table[:, 0], kind="stable")
    table, own = table[order], fps[order]
    # Only rows up to `distance` further along the first pivot can be linked.
    until = np.searchsorted(table[:, 0], table[:, 0].astype(np.int16) + distance, side="right")
    for lo in range(0, len(own), block):
        hi = min(len(own), lo + block)
        for at in range(lo, int(until[hi - 1]), block):
            to = min(int(until[hi - 1]), at + block)
            near = np.ones((hi - lo, to - at), bool)
            for p in range(table.shape[1]):
                near &= np.abs(table[lo:hi, p, None] - table[None, at:to, p]) <= distance
            i, j = np.nonzero(near)
            i, j = i + lo, j + at
            sure = (i < j) & (np.bitwise_count(own[i] ^ own[j]) <= distance)
            yield order[i[sure]], order[j[sure]]


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within distance: links that connect what the pairs connect, fewer than rows."""
    label = np.arange(len(fps))
    u, v = [], []
    for i, j in linked_blocks(fps, distance):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        # One pair for each two trees that meet in this block.
        _, one = np.unique(np.minimum(label[i], label[j]) * len(fps) + np.maximum(label[i], label[j]), return_index=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        for at in one.tolist():
            a, b = root(int(label[i[at]])), root(int(label[j[at]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                u.append(int(i[at]))
                v.append(int(j[at]))
        if parent:
            ends = np.array([root(x) for x in range(len(fps))])
            label = ends[label]
    return np.array(u, np.int64), np.array(v, np.int64)


def _links(distance: int):
    """Rows sorted by key -> verified links, of larger groups a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pack(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(edges)
            u, v = [], []
            pairs = edges[:-1][sizes == 2]
            if len(pairs):  # most groups that aren't single: verified together
                a, b = fps[pairs], fps[pairs + 1]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
                u.append(a[near])
                v.append(b[near])
            for at, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = np.unique(fps[at : at + n])
                i, j = spanning_links(own.view(np.uint64), distance)
                u.append(own[i])
                v.append(own[j])
            if not u:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate([rest_key, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([rest_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1], side="left")
            out = pack(keys[:last], fps[:last]) if last else None
            rest_key, rest_fp = keys[last:], fps[last:]
            if out is not None:
                yield out
        if len(rest_key) and (out := pack(rest_key, rest_fp)) is not None:
            yield out

    return run


def fingerprint_links(prints: DataFrame, distance: int = 3, blocks: int = 6, group_rows: int = 20_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) at most `distance` bits apart, which connect
    all that such links connect."""
    keyed = prints.select("fp", F.explode(block_keys(distance, blocks)).alias("k")).select("fp", "k.choice", F.xxhash64("k.choice", "k.bits").alias("key"))
    # Keys that more rows share than a task should hold are few: they are counted, and
    # their groups are dealt out again by further bits.
    hot = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("key"), "hot_keys")
    keyed, dealt = keyed.select("fp", "key"), keyed
    if not hot.isEmpty():
        finer = dealt.join(hot, "key").select("fp", F.explode(finer_keys(distance, blocks)).alias("key"))
        keyed = keyed.join(hot, "key", "left_anti").select("fp", "key").unionAll(finer)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance), "u bigint, v bigint").distinct()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    prints = staged(with_fingerprints(docs, words), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = fingerprint_links(nodes.select("fp"), distance)
    roots = with_components(nodes.withColumnRenamed("fp", "node"), links)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per distinct fingerprint; a fingerprint shared by very many documents is split by the join.
    by_print = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return prints.join(by_print, "fp").select(real("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component_id"))
