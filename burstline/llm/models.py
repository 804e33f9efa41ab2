"""What the two classifiers share: the bounded sample of labelled rows, boosted trees and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import written


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the doc_id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled rows outside the held-out fold, those of least hash of doc_id.

    The ids are bounded by `most`, so they are broadcast and the texts of documents stay where they are.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), "doc_id"), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for a log loss, split on histograms of quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score, self.trees = np.full(n, self.base), []
        slots = self.bins + 1
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                count = 1 << level
                feature, cut = np.full(count, -1), np.zeros(count, np.int64)
                best = np.full(count, 1e-6)
                for f in range(m):
                    key = node * slots + binned[:, f]
                    sums = [np.bincount(key, w, count * slots).reshape(count, slots).cumsum(axis=1) for w in (g, h)]
                    (gl, hl), (gt, ht) = sums, (sums[0][:, -1:], sums[1][:, -1:])
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least) | (ht - hl < self.least)] = -1
                    at = gain[:, : len(self.cuts[f])].argmax(axis=1) if len(self.cuts[f]) else np.zeros(count, np.int64)
                    value = gain[np.arange(count), at] if len(self.cuts[f]) else np.full(count, -1.0)
                    better = value > best
                    best[better], feature[better], cut[better] = value[better], f, at[better]
                splits.append((feature, np.asarray([self.cuts[f][c] if f >= 0 else np.inf for f, c in zip(feature, cut, strict=True)])))
                right = np.where(feature[node] >= 0, binned[np.arange(n), np.maximum(feature[node], 0)] > cut[node], False)
                node = 2 * node + right
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            score += value[node]
            self.trees.append((splits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (x[rows, np.maximum(feature[node], 0)] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (mean x, mean y of each pool), both ascending."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    return np.asarray([t / n for _, n, t in pools]), np.asarray([s / n for s, n, _ in pools])
