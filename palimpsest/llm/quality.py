"""Quality classifier: a convolutional network over bytes, in numpy.

A filter is a table per tap with a weight for each byte value, so a filter's response is a
sum of table lookups. Responses are taken every ``STRIDE`` bytes of the whole text, max-pooled over
overlapping chunks, rectified, and the chunks' mean and maximum go through one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, short_batches
from .langid import folds

TAPS, FILTERS, STRIDE = 6, 16, 2
BLOCK = 32  # positions; a chunk is 8 blocks and begins every 7
CHUNK, HOP = 8, 7
STEP = 1 << 18  # bytes convolved at once: a multiple of STRIDE * BLOCK * HOP would not matter, blocks are joined before pooling


@dataclass
class Net:
    taps: np.ndarray  # TAPS x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    most: np.ndarray  # FILTERS
    last: float


def _padded(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    n = -(-max(len(raw), 1) // (STRIDE * BLOCK)) * STRIDE * BLOCK
    return np.frombuffer(raw.ljust(n + TAPS, b"\0"), np.uint8)


def responses(net: Net, b: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Filter responses at the positions of bytes ``begin`` to ``end``."""
    out = np.take(net.taps[0], b[begin:end:STRIDE], axis=0)
    for j in range(1, TAPS):
        out += np.take(net.taps[j], b[begin + j : end + j : STRIDE], axis=0)
    return out


def blocks(net: Net, b: np.ndarray) -> np.ndarray:
    """The largest response of each block of a whole text, in bounded memory."""
    n = len(b) - TAPS
    step = STEP // (STRIDE * BLOCK) * STRIDE * BLOCK
    return np.concatenate([responses(net, b, at, min(at + step, n)).reshape(-1, BLOCK, FILTERS).max(1) for at in range(0, n, step)])


def chunk_starts(n_blocks: int) -> np.ndarray:
    return np.arange(0, max(n_blocks - (CHUNK - HOP), 1), HOP)


def pooled(top: np.ndarray) -> np.ndarray:
    starts = chunk_starts(len(top))
    pad = np.full((starts[-1] + CHUNK - len(top), FILTERS), -np.inf, np.float32) if starts[-1] + CHUNK > len(top) else top[:0]
    full = np.concatenate([top, pad])
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK, axis=0)[::HOP][: len(starts)].max(-1)


def probability(net: Net, text: str) -> float:
    h = np.maximum(pooled(blocks(net, _padded(text))) + net.bias, 0)
    z = float(h.mean(0) @ net.mean + h.max(0) @ net.most + net.last)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, rate: float = 0.02, seed: int = 0) -> Net:
    """Adam on the weighted log loss; gradients pass only through each chunk's largest responses."""
    rng = np.random.default_rng(seed)
    net = Net(
        (rng.standard_normal((TAPS, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.standard_normal(FILTERS).astype(np.float32) * 0.3, rng.standard_normal(FILTERS).astype(np.float32) * 0.3, 0.0,
    )
    data = [_padded(t) for t in texts]
    params = [net.taps, net.bias, net.mean, net.most, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in params]
            batch = order[at : at + 32]
            for k in batch:
                b = data[k]
                r = responses(net, b, 0, len(b) - TAPS)
                top = r.reshape(-1, BLOCK, FILTERS)
                where = top.argmax(1) + np.arange(len(top))[:, None] * BLOCK
                best = np.take_along_axis(r, where, 0)
                starts = chunk_starts(len(best))
                idx = np.minimum(starts[:, None] + np.arange(CHUNK)[None], len(best) - 1)
                win = best[idx]
                arg = win.argmax(1)
                at_block = np.take_along_axis(idx, arg, 1)
                value = np.take_along_axis(best, at_block, 0) + net.bias
                h = np.maximum(value, 0)
                mean, most = h.mean(0), h.max(0)
                z = mean @ net.mean + most @ net.most + params[4][0]
                d = float((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * weights[k])
                grads[2] += d * mean
                grads[3] += d * most
                grads[4] += d
                dh = np.repeat((d * net.mean / len(h))[None], len(h), 0)
                dh[h.argmax(0), np.arange(FILTERS)] += d * net.most
                dh *= value > 0
                grads[1] += dh.sum(0)
                pos = np.take_along_axis(where, at_block, 0) * STRIDE
                f = np.broadcast_to(np.arange(FILTERS), pos.shape)
                for j in range(TAPS):
                    np.add.at(grads[0][j], (b[pos + j], f), dh)
            step += 1
            now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / len(batch) + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.last = float(params[4][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_bytes: int = 1 << 16) -> Net | None:
    """Trains on at most ``per_class`` texts of each class, the first by a hash of the id; None if no row is labelled.

    Only texts up to ``max_bytes`` are sampled, which bounds what the driver holds; the classes' shares among all labels weigh
    the sample. Null labels are ignored; of several labels of a document the smallest holds.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    fits = docs.where((F.octet_length("text") <= max_bytes) & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), F.col("doc_id")))
    chosen = marks.withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", "quality")
    got = fits.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.text))
    y = np.array([r.quality for r in got])
    have = {q: max(int((y == q).sum()), 1) for q in (0, 1)}
    weights = np.array([share[q] / have[q] for q in y.tolist()])
    return train([r.text for r in got], y, weights / weights.mean())


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """``doc_id, score`` of every whole text; null counts as empty. Without a trained net every score is 0.5."""

    def scored(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [0.5 if net is None else probability(net, t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p})

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(scored, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.col("doc_id").isNotNull() & (folds(F.col("doc_id"), 4) == 2)
    net = fit(docs.where(~held), labels.where(~held))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
