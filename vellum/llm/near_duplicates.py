"""Groups of near duplicates: SimHash links first, then every pair that they left apart.

Two texts are near duplicates if the sets of their shingles of five words (A-Z
lower-cased) have a Jaccard similarity of 0.8 or more. At that similarity two SimHash
fingerprints differ in 15 % of their bits, too many for whole blocks to agree. So

1. equal word sequences become one class, named by its smallest doc_id;
2. every class gets a fingerprint of 128 bits over its distinct shingles, and is dealt out
   to a group in each of `TABLES` tables, by the table's fixed choice of its bits. Key length
   follows the number of classes, so that unrelated classes seldom meet, at every size;
3. in a group, pairs whose distances to any pivot differ by more than the radius are
   discarded by the pivot table, survivors are compared, and only a minimum spanning
   forest of the near ones goes on, with less links than rows;
4. the links' texts are fetched and their Jaccard similarity computed in full; connected
   components of verified links are the first groups;
5. steps 2 to 4 miss pairs (no table, a radius, a forest whose links fail), so all pairs of
   classes in different first groups are searched exactly, on whole shingle sets:
   a. a class of n shingles of which over 0.2 n are in no other text is out. A slice of
      all shingles, chosen by their hashes, settles that for most;
   b. in the others, shingles are put in order: those of one first group only, then by the
      number of first groups that have them. Two sets of similarity 0.8 share one of
      the first n - ceil(0.8 n) + 1 of each, so pairs meet at these; those of one first group
      join nothing new and go no further;
   c. pairs of different first groups whose sizes and places still allow 0.8 are verified;
6. connected components of all verified links are the groups. No link is lost.

Steps 2 to 4 are there for large groups of copies, whose pairs step 5 would have to
try one by one; what they leave apart, step 5 finds. There, a group of more than `GROUP` rows is
first thinned out by leaders: rows within a quarter of the radius of a leader are linked to it
and only the leader goes on. A task thins a very large group as its rows come in, so it never
holds one whole.

Whole texts go through a shuffle only where a step needs them: rows are first held against a
filter of the ids (`passing`), which is broadcast and of a bounded size at any number of ids; only
what passes is joined, and the rest, where it is wanted too, stays where it was read.

Edge cases: null texts count as empty, and texts without words are equal; a null doc_id comes
before all others; equal rows of an id are one document, of which one row is kept; rows that
repeat an id with other texts count as documents in the order of a hash of their texts; an
empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import id_values, staged, texts
from vellum.llm.components import with_components
from vellum.llm.repeats import real_id, unique_rows
from vellum.llm.simhash import PIVOTS, shingle_hashes

#: Tables that classes are dealt out to, at any size.
TABLES = 16
#: Rows of a group that are compared directly.
GROUP = 1024
#: Rows of a shingle that wait for its count; one in more texts comes last in the order.
COMMON = 1 << 16
#: Rows of a filter of ids, of 64 bits each: 2^26 bits, however many ids.
FILTER_ROWS = 1 << 20
_BITS = 128


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def passing(rows: DataFrame, ids: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
    """The rows whose key passes a filter of the ids (doc), one bit of which each id sets: all that are
    among them, and of the others a few. how = left_anti: all other rows."""
    bit = F.xxhash64(F.col("doc"))
    words = ids.select(F.shiftright(bit, 6).bitwiseAND(F.lit(FILTER_ROWS - 1)).alias("word"), _bit(bit).alias("bits"))
    known = F.broadcast(words.groupBy("word").agg(F.bit_or("bits").alias("bits")))
    own = F.xxhash64(key)
    return rows.join(known, (F.shiftright(own, 6).bitwiseAND(F.lit(FILTER_ROWS - 1)) == known["word"]) & (_bit(own).bitwiseAND(known["bits"]) != 0), how)


def set_fingerprint(shingles: list[int] | np.ndarray) -> tuple[int, int]:
    """128 SimHash bits of a set of 64-bit hashes, as two signed longs."""
    if not len(shingles):
        return 0, 0
    h = np.asarray(shingles, np.uint64)
    again = h * np.uint64(0x9E3779B97F4A7C15)
    again = (again ^ (again >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    again ^= again >> np.uint64(33)
    out = []
    for x in (h, again):
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0]))
    return out[0], out[1]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of broadcast rows of two uint64 words."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def near_pairs(prints: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within radius and their distances; the pivot table discards first."""
    pivots = np.array(PIVOTS, np.uint64).reshape(-1, 2)
    table = np.stack([distances(prints, p) for p in pivots], axis=1)
    i_all, j_all, d_all = [], [], []
    for lo in range(0, len(prints), block):
        for at in range(lo, len(prints), block):
            a, b = table[lo : lo + block], table[at : at + block]
            maybe = np.ones((len(a), len(b)), bool)
            for p in range(table.shape[1]):
                maybe &= np.abs(a[:, p, None] - b[None, :, p]) <= radius
            i, j = np.nonzero(maybe)
            i, j = i + lo, j + at
            i, j = i[i < j], j[i < j]
            d = distances(prints[i], prints[j])
            near = d <= radius
            i_all.append(i[near])
            j_all.append(j[near])
            d_all.append(d[near])
    return np.concatenate(i_all), np.concatenate(j_all), np.concatenate(d_all)


def thinned(prints: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (leader, row) of rows within a quarter of the radius of a leader, and the leaders."""
    links: list[tuple[int, int]] = []
    leaders, rest = [], np.arange(len(prints))
    while len(rest):
        near = distances(prints[rest], prints[rest[0]]) <= radius // 4
        leaders.append(int(rest[0]))
        links += [(leaders[-1], int(x)) for x in rest[near] if x != rest[0]]
        rest = rest[~near]
    return links, np.array(leaders, np.int64)


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs within radius (large groups: of their leaders)."""
    links: list[tuple[int, int]] = []
    rows = np.arange(len(prints))
    if len(rows) > GROUP:
        links, rows = thinned(prints, radius)
    i, j, d = near_pairs(prints[rows], radius)
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.argsort(d, kind="stable").tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            parent[a] = b
            links.append((int(rows[i[k]]), int(rows[j[k]])))
    return links


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, f, n, sliced = [], [], [], []
            for text in texts(batch, lower=True):
                c.append(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(text.split())), np.int64))
                shingles = np.array(list(set(shingle_hashes(text, words))), np.uint64)
                f.append(set_fingerprint(shingles))
                n.append(len(shingles))
                sliced.append(int(_in_slice(shingles).sum()))
            c, f = np.array(c).reshape(-1, 2), np.array(f, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x[:, w].copy()) for x in (c, f) for w in (0, 1)), *(pa.array(x, pa.int64()) for x in (n, sliced))], names=["doc", "c1", "c2", "f1", "f2", "n", "sliced"])

    return run


def key_bits(classes: int) -> int:
    """Bits of a key: groups of about eight unrelated rows."""
    return min(40, max(8, math.ceil(math.log2(max(2, classes))) - 3))


def _deal(bits: int, tables: int):
    """Each class to one key per table: a hash of the table's number and its chosen bits."""
    rng = np.random.default_rng(7)
    masks = np.zeros((tables, 2), np.uint64)
    for t in range(tables):
        for bit in rng.choice(_BITS, bits, replace=False).tolist():
            masks[t, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, f1, f2 = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc", "f1", "f2"))
            for lo in range(0, len(doc), 4000):
                a, b = (f[lo : lo + 4000].view(np.uint64) for f in (f1, f2))
                key = ((a[:, None] & masks[:, 0]) * np.uint64(0x9E3779B97F4A7C15)) ^ (((b[:, None] & masks[:, 1]) + np.arange(tables, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
                each = lambda x: pa.array(np.repeat(x[lo : lo + 4000], tables))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), each(doc), each(f1), each(f2)], names=["key", "doc", "f1", "f2"])

    return run


def _forests(radius: int, small: int = 12):
    """Rows sorted by key -> links (u, v) of each group's spanning forest."""

    def pack(keys: np.ndarray, doc: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = [], []
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(edges)
        # Small groups, all at once: each row against the next ones of its group.
        of = np.repeat(sizes, sizes)
        for step in range(1, small):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & (of[step:] <= small))
            near = at[distances(prints[at], prints[at + step]) <= radius]
            u.append(doc[near])
            v.append(doc[near + step])
        for at, n in zip(edges[:-1][sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            links = np.array(spanning_links(prints[at : at + n], radius), np.int64).reshape(-1, 2) + at
            u.append(doc[links[:, 0]])
            v.append(doc[links[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            cols = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("key", "doc", "f1", "f2"), strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left")) if len(cols[0]) else 0
            if last:
                yield pack(cols[0][:last], cols[1][:last], np.stack([c[:last] for c in cols[2:]], axis=1).view(np.uint64))
            rest = [c[last:] for c in cols]
            if len(rest[0]) > 4 * GROUP:  # a group without end in sight: only its leaders wait for more
                links, kept = thinned(np.stack(rest[2:], axis=1).view(np.uint64), radius)
                at = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(rest[1][at[:, 0]]), pa.array(rest[1][at[:, 1]])], names=["u", "v"])
                rest = [c[kept] for c in rest]
        if len(rest[0]):
            yield pack(rest[0], rest[1], np.stack(rest[2:], axis=1).view(np.uint64))

    return run


def _verify(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(texts(batch, "a", lower=True), texts(batch, "b", lower=True), strict=True):
                x, y = set(shingle_hashes(a, words)), set(shingle_hashes(b, words))
                both = len(x & y)
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _in_slice(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(15)) < 5


def _slice(words: int):
    """Each text's distinct shingles with one of 5 of 16 hash ends, and its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts(batch, lower=True))
            yield from _exploded(((*ids, x[_in_slice(x)]) for *ids, x in zip(id_values(batch, "doc").tolist(), id_values(batch, "root").tolist(), found, strict=True)), 2)

    return run


def _all_shingles(words: int):
    """Each text's distinct shingles with its first group and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts(batch, lower=True))
            yield from _exploded(((*ids, len(x), x) for *ids, x in zip(id_values(batch, "doc").tolist(), id_values(batch, "root").tolist(), found, strict=True)), 3)

    return run


def _exploded(rows: Iterator[tuple], n: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows of n numbers and an array of shingles -> (token, numbers), a row per shingle."""
    names = ["token", *("doc", "root", "n")[:n]]

    def pack() -> pa.RecordBatch:
        lengths = [len(x) for *_, x in held]
        numbers = [np.repeat(np.array(c, np.int64), lengths) for c in list(zip(*held, strict=True))[:n]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate([x for *_, x in held]).view(np.int64), *numbers)], names=names)

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], most: int = 0) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows sorted by the first column -> columns that hold whole runs of it, and whether they are
    a part of a run of over `most` rows, which is handed on in parts (most = 0: whole)."""
    rest = [[np.zeros(0, np.int64)] * len(names)]
    waiting, cut = 0, None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        if cut is not None:  # the rest of a run that was cut
            k = int(np.searchsorted(cols[0], cut, side="right"))
            if k:
                yield [c[:k] for c in cols], True
            cols = [c[k:] for c in cols]
            if not len(cols[0]):
                continue
            cut = None
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        key = next((r[0][0] for r in rest if len(r[0])), cols[0][0])
        if last or key != cols[0][-1]:
            yield [np.concatenate(c) for c in zip(*rest, [c[:last] for c in cols], strict=True)], False
            rest, waiting = [], 0
        rest.append([c[last:] for c in cols])
        waiting += len(cols[0]) - last
        if most and waiting > most:
            cut = cols[0][-1]
            yield [np.concatenate(c) for c in zip(*rest, strict=True)], True
            rest, waiting = [[np.zeros(0, np.int64)] * len(names)], 0
    if waiting:
        yield [np.concatenate(c) for c in zip(*rest, strict=True)], False


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, root, doc) sorted by token and root -> the docs of every token that several roots have."""
    for (token, root, doc), part in _runs(batches, ["token", "root", "doc"], COMMON):
        edges = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        several = root[edges[:-1]] != root[edges[1:] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[np.repeat(several, np.diff(edges)) | part])], names=["doc"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, root's complement, doc, n) sorted by token and root -> rows of tokens that several roots have, with
    the number of these roots and how far the root is from the doc."""
    for (token, root, doc, n), part in _runs(batches, ["token", "root", "doc", "n"], COMMON):
        if part:
            roots = np.full(len(token), 1 << 40)
        else:
            new = np.r_[True, token[1:] != token[:-1]]
            of = np.cumsum(new) - 1
            roots = np.bincount(of, np.r_[True, (token[1:] != token[:-1]) | (root[1:] != root[:-1])])[of].astype(np.int64)
        keep = roots > 1
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, roots, token, ~root - doc, n)], names=["doc", "roots", "token", "apart", "n"])


def _prefixes(similarity: float):
    """Rows of a doc, its shared tokens in order -> those in its prefix, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, token, apart, n), _ in _runs(batches, ["doc", "token", "apart", "n"]):
            edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            sizes = np.diff(edges)
            # Tokens of one root only stand before all shared ones.
            place = np.arange(len(doc)) - np.repeat(edges[:-1], sizes) + n - np.repeat(sizes, sizes)
            keep = place <= n - np.ceil(similarity * n - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, n, doc, doc + apart, place)], names=["token", "n", "doc", "root", "place"])

    return run


def _meetings(similarity: float, block: int = 2048):
    """Prefix rows sorted by token and n -> pairs (u, v) of different roots that may reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, n, doc, root, place), _ in _runs(batches, ["token", "n", "doc", "root", "place"]):
            # Partners stand in the same token's run.
            ends = np.searchsorted(token, token, side="right")
            lo = 0
            while lo < len(token):
                hi = min(lo + block, len(token))
                counts = ends[lo:hi] - np.arange(lo, hi) - 1
                hi = lo + max(1, int(np.searchsorted(np.cumsum(counts), 1 << 21, side="right")))
                counts = counts[: hi - lo]
                i = np.repeat(np.arange(lo, hi), counts)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
                # At the first token that both have, all others follow.
                most = np.minimum(n[i] - place[i], n[j] - place[j])
                may = (root[i] != root[j]) & (most >= similarity * (n[i] + n[j] - most) - 1e-9)
                a, b = doc[i[may]], doc[j[may]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])
                lo = hi

    return run


def remaining_pairs(rows: DataFrame, sizes: DataFrame, roots: DataFrame, moved: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of different roots that may reach the similarity: all that do are among them.

    rows: doc, text; sizes: doc, n (distinct shingles), sliced (those of the slice); roots: node, root, a row a class;
    moved: doc, root of every doc that isn't its group's root. Shingles that just one group has can't be shared
    with another: a text with more than 1 - similarity of them is left out before its other shingles are looked at.
    Those that several groups have are far fewer, so these are counted.
    """
    # Most roots equal their doc. Side by side, equal numbers keep a row from being compressed against the row before it,
    # so roots travel as their complement, and as the difference from doc where rows are in no order of docs.
    others = passing(rows, moved, F.col("doc"), "left_anti").withColumn("root", F.col("doc"))
    grouped = passing(rows, moved, F.col("doc")).join(moved, "doc", "left").select("doc", "text", F.coalesce("root", "doc").alias("root")).unionByName(others).withColumn("root", F.bitwise_not("root"))
    sliced = grouped.select("doc", "root", "text").mapInArrow(_slice(words), "token bigint, doc bigint, root bigint")
    shared = sliced.repartition("token").sortWithinPartitions("token", "root").mapInArrow(_not_alone, "doc bigint")
    shared = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("shared"))
    alone = F.col("sliced") - F.coalesce("shared", F.lit(0))
    left = roots.select(F.col("node").alias("doc"), "root").join(sizes, "doc").join(shared, "doc", "left").where(alone <= (1 - similarity) * F.col("n") + 1e-6).select("doc", "root")
    left = staged(left.distinct(), "texts_left")
    whole = passing(rows, left, F.col("doc")).join(left, "doc").withColumn("root", F.bitwise_not("root"))
    tokens = whole.mapInArrow(_all_shingles(words), "token bigint, doc bigint, root bigint, n bigint")
    shared = tokens.repartition("token").sortWithinPartitions("token", "root").mapInArrow(_shared, "doc bigint, roots bigint, token bigint, apart bigint, n bigint")
    prefixes = shared.repartition("doc").sortWithinPartitions("doc", "roots", "token").mapInArrow(_prefixes(similarity), "token bigint, n bigint, doc bigint, root bigint, place bigint")
    return prefixes.repartition("token").sortWithinPartitions("token", "n").mapInArrow(_meetings(similarity), "u bigint, v bigint").distinct()


def verified_links(rows: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (u, v) whose texts have the similarity. Only the texts that links need are fetched."""
    ends = links.select(F.col("u").alias("doc")).unionAll(links.select(F.col("v").alias("doc"))).distinct()
    needed = staged(passing(rows, ends, F.col("doc")).join(ends, "doc", "left_semi"), "linked_texts")
    pairs = links.join(needed.select(F.col("doc").alias("u"), F.col("text").alias("a")), "u").join(needed.select(F.col("doc").alias("v"), F.col("text").alias("b")), "v")
    return staged(pairs.select("u", "v", "a", "b").mapInArrow(_verify(words, similarity), "u bigint, v bigint"), "verified_links")


def _roots(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """rows (doc, text), each doc once -> (doc, root): the smallest doc of its group."""
    prints = staged(rows.mapInArrow(_prints(words), "doc bigint, c1 bigint, c2 bigint, f1 bigint, f2 bigint, n bigint, sliced bigint"), "set_fingerprints")
    classes = staged(prints.groupBy("c1", "c2").agg(F.min("doc").alias("doc"), F.first("f1").alias("f1"), F.first("f2").alias("f2")), "text_classes")
    cosine = 2 * similarity / (1 + similarity)
    apart = math.acos(cosine) / math.pi
    radius = math.floor(_BITS * apart + 3 * math.sqrt(_BITS * apart * (1 - apart)))
    dealt = classes.select("doc", "f1", "f2").mapInArrow(_deal(key_bits(classes.count()), TABLES), "key bigint, doc bigint, f1 bigint, f2 bigint")
    links = staged(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(radius), "u bigint, v bigint").distinct(), "candidate_links")
    verified = verified_links(rows, links, words, similarity)
    first = staged(with_components(classes.select(F.col("doc").alias("node"), "c1", "c2"), verified), "first_groups")
    moved = staged(prints.select("doc", "c1", "c2").join(first.select("c1", "c2", "root"), ["c1", "c2"]).where("doc <> root").select("doc", "root"), "moved")
    more = staged(remaining_pairs(rows, prints.select("doc", "n", "sliced"), first.select("node", "root"), moved, words, similarity), "candidate_links")
    verified = first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(verified_links(rows, more, words, similarity))
    roots = with_components(classes.select(F.col("doc").alias("node"), "c1", "c2"), verified)
    return prints.select("doc", "c1", "c2").join(roots, ["c1", "c2"]).select("doc", "root")


def _grouped(docs: DataFrame, carry: list[str], words: int, similarity: float) -> tuple[DataFrame, DataFrame, bool]:
    """(id, carried, row, root, leads) of every row, (doc, root) of every document, and whether ids repeat."""
    rows, with_roots, repeated = unique_rows(docs, carry)
    roots = staged(_roots(rows, words, similarity), "near_groups")
    return with_roots(roots.withColumn("leads", F.expr("doc = root"))), roots, repeated


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group) for every row."""
    each, _, repeated = _grouped(docs, [], words, similarity)
    if repeated:  # roots are numbers of documents; the first of a group has its smallest id
        each = each.join(each.where("leads").groupBy("root").agg(F.min("id").alias("group")), "root")
    return each.select(real_id("id").alias("doc_id"), real_id("group" if repeated else "root").alias("group_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near duplicates: of each group one row of its smallest doc_id."""
    each, roots, repeated = _grouped(docs, docs.columns, words, similarity)
    if not repeated:
        gone = roots.where("doc <> root").select("doc")
        doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
        return passing(docs, gone, doc, "left_anti").unionAll(passing(docs, gone, doc).join(gone, doc == gone["doc"], "left_anti"))
    rows = each.where("leads").select("root", "row", "carried")
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    return rows.join(first, "root").where("row = first").select("carried.*")
