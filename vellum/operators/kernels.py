"""Order-dependent geometry as grouped Arrow-backed pandas functions, one page a group.

A page holds a bounded number of boxes and words, so a group is small. Vectors go in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(page: pd.DataFrame, limit: float = 0.1) -> pd.DataFrame:
    """Greedy non-maximum suppression: rows (x, y, w, h, score, id); a box that overlaps a better one by more than limit goes."""
    p = page.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    x, y, w, h = (p[c].to_numpy(float) for c in ("x", "y", "w", "h"))
    alive = np.ones(len(p), bool)
    keep = []
    for i in range(len(p)):
        if not alive[i]:
            continue
        keep.append(i)
        ix = np.maximum(0.0, np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x))
        iy = np.maximum(0.0, np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y))
        inter = ix * iy
        alive &= inter / np.maximum(w[i] * h[i] + w * h - inter, 1e-12) <= limit
    return p.iloc[keep]


def merged_gaps(page: pd.DataFrame) -> pd.DataFrame:
    """Uncovered lines (x, y, w, h, words) joined to gaps.

    Lines of three words or more, from the top: a line joins the first gap that it overlaps
    by over half of the narrower's width, at less than two median line heights below.
    Gaps of five words or more are reported, largest first.
    """
    lines = page[page["words"] >= 3].sort_values(["y", "x", "id"])
    out: list[dict] = []
    heights = np.sort(lines["h"].to_numpy())
    reach = 2 * heights[len(heights) // 2] if len(heights) else 0.0
    for r in lines.itertuples():
        for g in out:
            across = min(r.x + r.w, g["x1"]) - max(r.x, g["x0"])
            if across > 0.5 * min(r.w, g["x1"] - g["x0"]) and r.y - g["y1"] < reach:
                g["x0"], g["x1"] = min(g["x0"], r.x), max(g["x1"], r.x + r.w)
                g["y1"], g["words"] = max(g["y1"], r.y + r.h), g["words"] + r.words
                break
        else:
            out.append({"x0": r.x, "x1": r.x + r.w, "y0": r.y, "y1": r.y + r.h, "words": r.words})
    rows = sorted((g for g in out if g["words"] >= 5), key=lambda g: (-g["words"], g["y0"], g["x0"]))
    return pd.DataFrame([{"page": page["page"].iloc[0], "place": i, **g} for i, g in enumerate(rows)], columns=["page", "place", "x0", "x1", "y0", "y1", "words"])


def column_grid(page: pd.DataFrame, bins: int = 200) -> pd.DataFrame:
    """Columns of a page from its lines' left edges (x, w).

    Peaks of a histogram of left edges that hold enough lines are column starts; peaks
    nearer than 0.04 are one; columns narrower than half the median pitch go; a column's
    right edge is the 95th percentile element of its lines' right ends.
    """
    x, right = page["x"].to_numpy(float), (page["x"] + page["w"]).to_numpy(float)
    counts = np.bincount(np.clip((x * bins).astype(int), 0, bins - 1), minlength=bins)
    least = max(6.0, len(x) / 120)
    before, after = np.r_[-1, counts[:-1]], np.r_[counts[1:], -1]
    peaks = [i / bins for i in np.flatnonzero((counts >= least) & (counts >= before) & (counts > after))]
    starts: list[float] = []
    for p in peaks:
        if not starts or p - starts[-1] >= 0.04:
            starts.append(p)
    pitch = np.sort(np.diff(starts))
    if len(pitch):
        half = pitch[len(pitch) // 2] / 2
        starts = [s for i, s in enumerate(starts) if i + 1 == len(starts) or starts[i + 1] - s >= half]
    rows = []
    for i, s in enumerate(starts):
        own = np.sort(right[(x >= s - 0.5 / bins) & (x < (starts[i + 1] if i + 1 < len(starts) else 9.0) - 0.5 / bins)])
        rows.append({"page": page["page"].iloc[0], "place": i, "left_edge": s, "right_edge": float(own[int(0.95 * len(own))]) if len(own) else s, "lines": len(own)})
    return pd.DataFrame(rows, columns=["page", "place", "left_edge", "right_edge", "lines"])


def per_page(boxes: DataFrame, kernel, schema: str) -> DataFrame:
    return boxes.groupBy("page").applyInPandas(lambda page: kernel(page), schema)


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and outer padded keys of HMAC-SHA256 for a secret of 64 bytes at most."""
    key = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text: two nested SHA-256 over padded keys, within the JVM."""
    inner, outer = (F.unhex(F.lit(pad.hex())) for pad in hmac_pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def vector_blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, embedding) -> blocks (ids, units): up to `most` vectors at unit length, as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), most):
                part = batch.slice(lo, most)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = flat.reshape(len(part), -1)
                units = v / np.sqrt((v * v).sum(1, keepdims=True))
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), "units": pa.array([units.tobytes()], pa.binary())})

    return run


def nearest_in_blocks(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks (query_ids, query_units, ids, units) -> each query's k nearest of the block by one matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, e in zip(*(batch.column(c) for c in ("query_ids", "query_units", "ids", "units")), strict=True):
                q_ids, ids = np.array(q_ids.as_py(), np.int64), np.array(ids.as_py(), np.int64)
                left, right = (np.frombuffer(m.as_py(), np.float64).reshape(len(i), -1) for m, i in ((q, q_ids), (e, ids)))
                near = np.round(left @ right.T, 6)
                near[q_ids[:, None] == ids[None, :]] = -np.inf
                # All that tie with the k-th best stay; the rank over blocks settles them.
                least = -np.partition(-near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                i, j = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                order = np.lexsort((ids[j], -near[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(near[i, j])], names=["query_id", "vec_id", "cosine"])

    return run
