"""Mixing to target weights by soft membership.

Domains come from the labelled table: high quality, low quality, toxic. A softmax
regression over telling terms, fitted on a bounded sample of labelled rows, gives every
document a posterior over the domains.

Document rates r >= 0 (expected copies) then minimise

    1/2 (s - t)' W (s - t)  +  l2/2 sum_i w_i (r_i - 1)^2,
    s_d = sum_i w_i r_i p_id,   w_i = tokens_i / tokens,   W = (sum_i w_i p_i p_i' + 0.01 I)^-1,

where t are the target shares of the token budget: the expected domain totals of tokens
meet the targets, and rates stay near 1 as far as that allows. W weighs the residuals by
how far rates can move them, so that domains that overlap don't slow the descent: the
gradient in the weighted norm is p_i' W (s - t) + l2 (r_i - 1), and its Lipschitz constant is
at most 1 + l2. Steps have Nesterov's momentum, and end when the targets are met or, where
they can't be met, when the projected gradient vanishes: the rates stand at their best. Each step is one Spark pass over the
posteriors (tokens and a few doubles a document): tasks fold the steps so far into their
rows' rates and add up the domains' totals; the driver gets one row of totals a step. No
rates are kept, shuffled or sent anywhere while fitting.

A domain that no document belongs to can't be filled; its target is missed. `missed` says by
how much the share that is missed most differs from its target.

Edge cases: null and empty texts have no tokens and rate as their posterior says; without
labelled rows every domain is equally likely; label rows that repeat an id count once;
repeated rows get equal rates; a null doc_id is carried; an empty table gives an empty
result; other columns are carried if asked for, and give way to columns made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import carried_columns, carrying, schema_with, staged
from vellum.llm.terms import Vocabulary, labelled_sample, lower_texts, telling_terms

DOMAINS = ("high", "low", "toxic")
DOMAIN_SQL = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 END"
TARGETS = {"high": 0.75, "low": 0.2, "toxic": 0.05}


class DomainModel:
    """Softmax regression over the presence of chosen terms."""

    def __init__(self, chosen: list[bytes], classes: int) -> None:
        self.vocabulary = Vocabulary(chosen)
        self.weights = np.zeros((len(chosen) + 1, classes))  # the last row is the constant

    def posteriors(self, numbers: list[list[int]]) -> np.ndarray:
        """Posteriors of texts with these term numbers: texts x classes."""
        if not numbers:
            return np.zeros((0, self.weights.shape[1]))
        constant = len(self.weights) - 1
        flat = np.array([i for own in numbers for i in (constant, *own)], np.int64)
        starts = np.cumsum([0, *(len(own) + 1 for own in numbers[:-1])])
        z = np.add.reduceat(self.weights[flat], starts, axis=0)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, rows: list[tuple[list[int], int]], l2: float = 1e-3, steps: int = 300) -> None:
        """Accelerated gradient descent on the mean log loss over (term numbers, class)."""
        classes = self.weights.shape[1]
        if not rows:
            return
        x = np.zeros((len(rows), len(self.weights)), np.float32)
        y = np.zeros((len(rows), classes), np.float32)
        for i, (numbers, label) in enumerate(rows):
            x[i, numbers] = 1.0
            y[i, label] = 1.0
        x[:, -1] = 1.0
        # Half the largest eigenvalue of x'x / n bounds the curvature; power iteration finds it.
        v = np.ones(x.shape[1], np.float32)
        for _ in range(20):
            v = x.T @ (x @ v) / len(x)
            size = float(np.linalg.norm(v))
            v /= size
        rate = 1.0 / (0.5 * size + l2)
        w = ahead = np.zeros_like(self.weights, np.float32)
        for t in range(steps):
            z = x @ ahead
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = ahead - rate * (x.T @ (p - y) / len(x) + l2 * ahead)
            ahead = new + t / (t + 3) * (new - w)
            w = new
        self.weights = w.astype(float)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN_SQL, classes: int = len(DOMAINS), examples: int = 6000, sample_bytes: int = 32 << 20, features: int = 600, keep: str = "true") -> DomainModel:
    """Fit on about `examples` labelled rows and `sample_bytes` of text at most; domain: SQL over labels for the
    class number; keep: SQL filter of their doc_id."""
    sample = labelled_sample(docs, labels, domain, examples, sample_bytes, keep)
    chosen, _ = telling_terms(sample, classes, features, shape=True)
    model = DomainModel([t for t, _ in chosen], classes)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.vocabulary.numbers(t) for t in lower_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(got, pa.list_(pa.int64())), batch.column("label")], names=["h", "numbers", "label"])

    got = sample.select("h", "text", "label").mapInArrow(numbers, "h bigint, numbers array<bigint>, label int").collect()
    model.fit([(r["numbers"], r["label"]) for r in sorted(got, key=lambda r: r["h"])])
    return model


def with_posteriors(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """carried (a struct of the columns to keep), tokens (words), p: the posterior over the domains, draw: a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = carrying(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(shared.value)
        for batch in batches:
            numbers, tokens, draw = [], [], []
            for text in lower_texts(batch):
                numbers.append(own.vocabulary.numbers(text))
                tokens.append(len(text.split()))
                draw.append(xxhash.xxh3_64_intdigest(text) >> 44)
            p = own.posteriors(numbers).tolist()
            arrays = [batch.column("carried"), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64())), pa.array(draw, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["carried", "tokens", "p", "draw"])

    return rows.mapInArrow(run, schema_with(rows.schema["carried"], "", "tokens bigint, p array<double>, draw bigint"))


def fold_rates(p: np.ndarray, steps: list[np.ndarray], l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after these steps, the point ahead, where momentum leads to, and the last projected gradient.

    A step is the vector W (s - t) at the point ahead.
    """
    rates = point = np.ones(len(p))
    gradient = np.full(len(p), np.inf)
    for k, residual in enumerate(steps):
        new = np.maximum(0.0, point - (p @ residual + l2 * (point - 1.0)) / (1.0 + l2))
        gradient = point - new
        point = new + k / (k + 3) * (new - rates)
        rates = new
    return rates, point, gradient


def _matrix(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def fit_rates(rows: DataFrame, targets: list[float], l2: float = 1e-4, most_steps: int = 60, tolerance: float = 2e-4, flat: float = 2e-4) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of projected gradient descent over rows (tokens, p), to fold into rates, and the shares reached.

    They end when no share misses its target by `tolerance`, or when the projected gradient, as
    the root of its mean square over tokens, is below `flat`.
    """
    classes = len(targets)
    # A table of its own: passes should read as few files as these columns need.
    rows = staged(rows.select("tokens", "p"), "posteriors_alone")
    names = [f"s{i}" for i in range(classes * (classes + 2) + 1)]

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """Token totals by domain at the point ahead and at the rates, the squared gradient, and the moments sum n p p'."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(names))
            for batch in batches:
                p, n = _matrix(batch, classes), batch.column("tokens").to_numpy(zero_copy_only=False)
                rates, point, gradient = fold_rates(p, steps, l2)
                out[:classes] += (n * point) @ p
                out[classes : 2 * classes] += (n * rates) @ p
                if steps:
                    out[2 * classes] += n @ (gradient * gradient)
                else:
                    out[2 * classes + 1 :] += ((p * n[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=names)

        got = rows.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        out = np.array([x or 0.0 for x in got])
        return out[:classes], out[classes : 2 * classes], out[2 * classes], out[2 * classes + 1 :].reshape(classes, classes)

    steps: list[np.ndarray] = []
    ahead, at_rates, _, moments = sums(steps)
    n = ahead.sum()
    if n <= 0:
        return steps, np.zeros(classes)
    target, gradient = np.array(targets), math.inf
    weights = np.linalg.inv(moments / n + 0.01 * np.eye(classes))
    while len(steps) < most_steps and gradient >= flat and np.abs(at_rates / n - target).max() >= tolerance:
        steps.append(weights @ (ahead / n - target))
        ahead, at_rates, squares, _ = sums(steps)
        gradient = math.sqrt(squares / n)
    return steps, at_rates / n


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float = 1.0, keep: list[str] | None = None, l2: float = 1e-4) -> DataFrame:
    """keep columns, tokens, p_<domain>, rate, copies, missed for every document.

    targets: shares of the token budget, which is `budget` times the corpus's tokens.
    copies realises a rate by its whole part and a draw on the text's hash for the rest.
    """
    keep = list(docs.columns) if keep is None else keep
    weights = [targets[d] * budget for d in DOMAINS]
    rows = staged(with_posteriors(docs, fit_domains(docs, labels), keep), "posteriors")
    steps, reached = fit_rates(rows, weights, l2)
    missed = float(np.abs(reached - np.array(weights)).max())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch, len(DOMAINS))
            arrays = [batch.column(c) for c in ("carried", "tokens", "draw")] + [pa.array(p[:, d].copy()) for d in range(len(DOMAINS))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(fold_rates(p, steps, l2)[0])], names=["carried", "tokens", "draw", *made[1:-1]])

    made = ["tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    out = rows.mapInArrow(rate, schema_with(rows.schema["carried"], "", "tokens bigint, draw bigint, " + ", ".join(f"{c} double" for c in made[1:-1])))
    whole = F.floor("rate")
    copies = (whole + (F.col("draw") / float(1 << 20) < F.col("rate") - whole).cast("int")).cast("int")
    out = out.withColumn("copies", copies).withColumn("missed", F.lit(missed))
    return out.select(*carried_columns(keep, [*made, "missed"]), *made, "missed")
