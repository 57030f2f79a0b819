"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows (`examples` and `sample_bytes`, parameters of
the fit). Their terms are all their words: lower-cased, without ASCII punctuation at the
ends. A term's weight in a text is (1 + ln tf) x idf x (phi + 0.001), where phi, from 0 to 1,
is the correlation of the term with the label over the sample: words that tell the
classes apart weigh most, and no word is dropped. Each example is a unit vector.

Search. The inverted index keeps, for each term, its postings by blocks of examples and the
largest weight in each block. A query adds up block maxima into an upper bound of its
cosine with any example of a block, visits blocks by falling bound, and stops at the first
block whose bound is below the k-th best cosine. No example above that cosine can be
missed: the search is exact, and tests hold it against brute force.

Score: the votes of the k nearest, weighted by 1 / (distance + 0.1); examples
tied with the k-th share the places left, so the order of examples decides
nothing. The vote is calibrated by the sample's own outcome: each example is scored
against all others, votes are put into bins, and a bin's score is its labelled rate
(made monotone by pooling). A text without any known word has no direction; its
score is the labelled rate of such examples. Evidence: nearest example's doc_id.

All documents are scored in one pass without a shuffle; the index is of bounded
size and travels as a Spark broadcast.

Edge cases: null and empty texts have no terms; repeated rows get equal scores; a
null doc_id hashes as 0, so it is held out; without labelled rows all scores are
0; label rows that repeat an id count once, and so do equal rows of an id; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import carrying, schema_with
from vellum.llm.terms import PUNCTUATION, labelled_sample, lower_texts

BLOCK = 512
BINS = 20
#: A term that this share of the examples has keeps a weight for every example instead of a list.
DENSE = 1 / 12
#: Cosines this close tie: weights are kept in single precision.
TIE = 1e-6
#: Weight of a term that doesn't depend on the label, where 1 is a term that decides it.
FLOOR = 1e-3


def words_of(text: bytes) -> dict[bytes, int]:
    """Counts of the words of a lower-cased text, without punctuation at their ends."""
    counts: dict[bytes, int] = {}
    for raw, n in Counter(text.split()).items():
        word = raw.strip(PUNCTUATION)
        if word:
            counts[word] = counts.get(word, 0) + n
    return counts


class BlockMaxIndex:
    """Inverted index over unit vectors with the largest weight of each term in each block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int, block: int = BLOCK) -> None:
        """Entries (example, term, weight), each pair once."""
        self.examples, self.block = examples, block
        self.blocks = max(1, -(-examples // block))
        # Similar examples share a block, so that block maxima are tight: order by strongest term.
        by = np.lexsort((term, -weight, example))
        lead = by[np.r_[True, example[by][1:] != example[by][:-1]]] if len(by) else by
        first = np.full(examples, terms, np.int64)
        first[example[lead]] = term[lead]
        self.order = np.argsort(first, kind="stable")  # place -> example
        place = np.empty(examples, np.int64)
        place[self.order] = np.arange(examples)
        at = place[example]
        by = np.lexsort((at, term))
        at, term, weight = at[by], term[by], weight[by].astype(np.float32)
        # Postings of frequent terms are rows of weights, block by block, with each block's largest; of the others, lists.
        often = np.flatnonzero(np.bincount(term, minlength=terms) > max(8, DENSE * examples))
        self.row = np.full(terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        dense = self.row[term] >= 0
        rows = np.zeros((len(often), self.blocks * block), np.float32)
        rows[self.row[term[dense]], at[dense]] = weight[dense]
        self.maxima = rows.reshape(len(often), self.blocks, block).max(2)
        self.rows = [np.ascontiguousarray(rows[:, b * block : (b + 1) * block]) for b in range(self.blocks)]
        self.at, self.weight = at[~dense].astype(np.int32), weight[~dense]
        self.starts = np.zeros(terms + 1, np.int32)
        np.cumsum(np.bincount(term[~dense], minlength=terms), out=self.starts[1:])

    def from_lists(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What these terms' lists add to the cosine with each example, by block."""
        start = self.starts[terms]
        n = self.starts[terms + 1] - start
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.zeros((self.blocks, self.block))
        entry = np.arange(ends[-1]) + np.repeat(start - (ends - n), n)
        return np.bincount(self.at[entry], np.repeat(w, n) * self.weight[entry], self.blocks * self.block).reshape(self.blocks, self.block)

    def from_rows(self, rows: np.ndarray, w: np.ndarray, b: int) -> np.ndarray:
        """What the rows of frequent terms add for the examples of a block."""
        return w @ self.rows[b][rows]

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """All examples whose cosine is at least the k-th best, and their cosines (the example `but` left out)."""
        rows = self.row[terms]
        often = rows >= 0
        lists = self.from_lists(terms[~often], w[~often])
        rows, w = rows[often], w[often].astype(np.float32)
        bound = lists.max(1) + (w @ self.maxima[rows]) * (1 + 1e-5)
        found, sims, kth = [], [], 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < kth - 1e-6:
                break
            scores = lists[b] + self.from_rows(rows, w, b)
            hit = np.flatnonzero((scores > 0) & (scores >= kth - TIE))
            own = self.order[hit + b * self.block]
            if but >= 0:
                hit, own = hit[own != but], own[own != but]
            if not len(hit):
                continue
            found.append(own)
            sims.append(scores[hit])
            have = np.concatenate(sims)
            if len(have) >= k:
                kth = float(np.partition(have, len(have) - k)[len(have) - k])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        found, have = np.concatenate(found), np.concatenate(sims)
        near = have >= kth - TIE
        return found[near], have[near]


class ToxicityModel:
    """Vocabulary, weights, index and calibration; small enough to broadcast by its parameters."""

    def __init__(self, terms: list[list[bytes]] | pa.ChunkedArray, counts: pa.ChunkedArray | list[list[int]], labels: list[int], ids: list[int], k: int) -> None:
        terms, counts = (pa.array(x, pa.list_(t)) if isinstance(x, list) else x.combine_chunks() for x, t in ((terms, pa.binary()), (counts, pa.int32())))
        self.labels, self.ids, self.k = np.array(labels, float), np.array(ids, np.int64), k
        coded = terms.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.raw: dict[bytes, int] = {}
        n, rows = len(self.known), len(labels)
        sizes = np.diff(terms.offsets.to_numpy())
        example = np.repeat(np.arange(rows), sizes)
        df, df1 = np.bincount(term, minlength=n), np.bincount(term, self.labels[example], n)
        ones = self.labels.sum()
        # Phi of the 2 x 2 table of term and label.
        spread = df * (rows - df) * ones * (rows - ones)
        phi = np.abs(rows * df1 - df * ones) / np.sqrt(np.where(spread > 0, spread, np.inf))
        self.weights = (np.log((1 + rows) / (1 + df)) + 1) * (phi + FLOOR)
        w = self.weights[term] * (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False).astype(float)))
        norm = np.sqrt(np.bincount(example, w * w, rows))
        self.index = BlockMaxIndex(example, term, w / norm[example], rows, n)
        empty = sizes == 0
        self.none = float((self.labels[empty].sum() + 0.5 * (ones / rows)) / (empty.sum() + 0.5)) if rows else 0.0
        self.bins = [0.0] * BINS
        self.shared: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None, "raw": {}}

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of a lower-cased text over the known words: term numbers and weights."""
        counts: dict[int, int] = {}
        raw, known = self.raw, self.known
        for word, n in Counter(text.split()).items():
            at = raw.get(word)
            if at is None:
                at = known.get(word.strip(PUNCTUATION), -1)
                if len(raw) < 100_000:  # a cache, bounded
                    raw[word] = at
            if at >= 0:
                counts[at] = counts.get(at, 0) + n
        terms = np.fromiter(counts, np.int64, len(counts))
        w = self.weights[terms] * (1 + np.log(np.fromiter(counts.values(), float, len(counts))))
        return terms, w / math.sqrt(float(w @ w)) if len(terms) else w

    def vote(self, text: bytes, but: int = -1) -> tuple[float, int | None]:
        """Distance-weighted share of label 1 among the k nearest examples, and the nearest one's id; nan without any.

        Examples that tie with the k-th share the places left.
        """
        terms, w = self.vector(text)
        at, sims = self.index.nearest(terms, w, self.k, but) if len(terms) else ((), ())
        if not len(at):
            return math.nan, None
        kth = float(np.min(sims))
        sure = sims > kth + TIE
        share = np.where(sure, 1.0, min(1.0, max(0.0, self.k - sure.sum()) / max(1, (~sure).sum())))
        weight = share / (1.0 - np.minimum(sims, 1.0) + 0.1)
        best = at[sims >= sims.max() - TIE]
        return float((weight @ self.labels[at]) / weight.sum()), int(self.ids[best].min())

    def calibrated(self, vote: float) -> float:
        return self.none if math.isnan(vote) else self.bins[min(BINS - 1, int(vote * BINS))]

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Bins of equal width; their labelled rates, pooled until they rise."""
        pools: list[list[float]] = []
        of = np.minimum(BINS - 1, (votes * BINS).astype(int))
        for b in range(BINS):
            own = labels[of == b]
            pools.append([float(own.sum()) + (b + 0.5) / BINS, len(own) + 1.0, 1.0])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        self.bins = [s / n for s, n, width in pools for _ in range(int(width))]


def packed(model: ToxicityModel) -> bytes:
    """Compressed: a broadcast lies on every executor's disk."""
    return zlib.compress(cloudpickle.dumps(model), 1)


def unpacked(data: bytes) -> ToxicityModel:
    return cloudpickle.loads(zlib.decompress(data))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [words_of(t) for t in lower_texts(batch)]
        arrays = [batch.column("doc_id"), batch.column("h"), batch.column("label"), pa.array([list(c) for c in got], pa.list_(pa.binary())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "label", "terms", "counts"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = 6000, sample_bytes: int = 32 << 20, k: int = 15, keep: str = "true") -> ToxicityModel:
    """Fit on about `examples` labelled rows and `sample_bytes` of text at most (keep: SQL filter of their doc_id)."""
    sample = labelled_sample(docs, labels, label, examples, sample_bytes, keep)
    got = sample.mapInArrow(_counted, "doc_id bigint, h bigint, label int, terms array<binary>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    model = ToxicityModel(got["terms"], got["counts"], got["label"].to_pylist(), got["doc_id"].to_pylist(), k)
    if not len(got):
        return model
    # Each example against all others, in tasks. The index is sent once, for this and for all scores.
    number = {key: i for i, key in enumerate(zip(got["doc_id"].to_pylist(), got["h"].to_pylist(), strict=True))}
    shared = model.shared = docs.sparkSession.sparkContext.broadcast(packed(model))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(shared.value)
        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True)
            said = [own.vote(t, but=number[key])[0] for key, t in zip(keys, lower_texts(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.float64()), batch.column("label")], names=["vote", "label"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = sample.repartition(min(tasks, 64)).mapInArrow(votes, "vote double, label int").where(~F.isnan("vote")).toArrow()
    model.calibrate(said["vote"].to_numpy(), said["label"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """carried (a struct of the columns to keep, all by default), score, predicted, evidence (nearest example)."""
    rows = carrying(docs, docs.columns if keep is None else keep)
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(packed(model))
    none, bins = model.none, model.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = unpacked(shared.value)
        scorer.none, scorer.bins = none, bins
        for batch in batches:
            got = [(scorer.calibrated(v), e) for v, e in (scorer.vote(t) for t in lower_texts(batch))]
            score = pa.array([s for s, _ in got], pa.float64())
            said = pa.array([int(s >= 0.5) for s, _ in got], pa.int32())
            near = pa.array([e for _, e in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("carried"), score, said, near], names=["carried", "score", "predicted", "evidence"])

    return rows.mapInArrow(run, schema_with(rows.schema["carried"], "", "score double, predicted int, evidence bigint"))


#: Labels of these rows are learnt from; the others are held out.
NOT_HELD_OUT = "pmod(coalesce(crc32(cast(doc_id as string)), 0), 5) <> 0"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_toxicity(rows, labels, keep=NOT_HELD_OUT)
    scored = score_toxicity(rows, model, keep=["doc_id"]).select("carried.doc_id", "score", "predicted", "evidence")
    return scored.select("doc_id", F.expr(f"NOT ({NOT_HELD_OUT})").alias("held_out"), "score", "predicted", "evidence")
