"""Mutual information of adjacent characters, counted over a whole corpus.

The model is of fixed size at any scale: pairs are counted in ``BUCKETS`` hash buckets and characters by code point, so
what travels to the executors is bounded by 4 million bucket entries (32 MB) plus one entry per code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 22
FLOOR, CEILING, UNSEEN = -6.0, 8.0, -5.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A multiplicative hash of the pair, below BUCKETS."""
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)


def count_pairs(corpus: DataFrame, text: str = "text", by_script: bool = False) -> DataFrame:
    """(``script``, ``kind``, ``key``, ``n``): kind 0 counts characters by code point, kind 1 pairs by bucket.

    Texts with more than three Han letters in ten characters are of script 1, others (with ``by_script`` off: all) of script
    0. Each task adds up its own batches first; the shuffle carries one row per key and task, not one per pair. Null and
    empty texts count nothing.
    """

    def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not some:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in some]), minlength=len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], [], []]
        for batch in batches:
            column = batch.column(0)
            for lo in range(0, len(column), 2000):
                points = code_points("\0".join(t for t in column.slice(lo, 2000).to_pylist() if t))
                inside = points != 0
                owner = np.cumsum(~inside)
                han = np.bincount(owner, weights=(points >= 0x4E00) & (points <= 0x9FFF))
                script = (han > 0.3 * np.bincount(owner, weights=inside))[owner] if by_script and len(points) else np.zeros(len(points), dtype=bool)
                pairs = bucket(points[:-1], points[1:])
                both = inside[:-1] & inside[1:]
                for s in (0, 1):
                    mine = script == bool(s)
                    sums[2 * s].append(np.unique(points[inside & mine].astype(np.int64), return_counts=True))
                    sums[2 * s + 1].append(np.unique(pairs[both & mine[1:]], return_counts=True))
                sums = [[merged(some)] if len(some) >= 16 else some for some in sums]
        for i, (keys, values) in enumerate(map(merged, sums)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // 2] * len(keys), pa.int32()), pa.array([i % 2] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(values, pa.int64())],
                ["script", "kind", "key", "n"],
            )

    partial = corpus.select(text).mapInArrow(run, "script INT, kind INT, key BIGINT, n BIGINT")
    return partial.groupBy("script", "kind", "key").agg(F.sum("n").alias("n"))


class PairModel:
    """Smoothed pointwise mutual information (bits) of adjacent characters; unseen characters score UNSEEN."""

    def __init__(self, chars: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], known_from: int = 3):
        order = np.argsort(chars[0])
        self.char_keys, self.char_counts = chars[0][order], chars[1][order].astype(np.float64)
        order = np.argsort(pairs[0])
        self.pair_keys, self.pair_counts = pairs[0][order], pairs[1][order].astype(np.float32)
        self.total = max(1.0, float(self.char_counts.sum()))
        self.known_from = max(known_from, 1e-6 * self.total)

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text") -> PairModel:
        return cls._of(count_pairs(corpus, text).toArrow(), 0)

    @classmethod
    def fit_by_script(cls, corpus: DataFrame, text: str = "text") -> tuple[PairModel, PairModel]:
        """The models of texts with many Han letters, and of the others, counted in one pass."""
        rows = count_pairs(corpus, text, by_script=True).toArrow()
        return cls._of(rows, 1), cls._of(rows, 0)

    @classmethod
    def _of(cls, rows: pa.Table, wanted: int) -> PairModel:
        script, kind, key, n = (rows.column(c).to_numpy() for c in ("script", "kind", "key", "n"))
        return cls(*((key[some], n[some]) for some in ((script == wanted) & (kind == k) for k in (0, 1))))

    def state(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """What the model is made of again; plain arrays, which executors read without this package."""
        return (self.char_keys, self.char_counts), (self.pair_keys, self.pair_counts)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def counts(self, points: np.ndarray) -> np.ndarray:
        return self._look(self.char_keys, self.char_counts, points.astype(np.int64))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """One score per adjacent pair."""
        if len(points) < 2:
            return np.zeros(0)
        single = self.counts(points)
        both = self._look(self.pair_keys, self.pair_counts, bucket(points[:-1], points[1:]))
        expected = single[:-1] * single[1:] / self.total
        score = np.log2((both + 0.5) / (expected + 0.5))
        score[(single[:-1] < self.known_from) | (single[1:] < self.known_from)] = UNSEEN
        return np.clip(score, FLOOR, CEILING)


def improbable_runs(scores: np.ndarray, shift: float = 0.5) -> list[tuple[int, int, float]]:
    """All maximum-scoring segments of the pairs' improbability (``-score - shift``), as character spans with weights.

    A stack of disjoint candidates is kept with their left and right running totals; a new one swallows those to its
    left that it extends to a larger total (linear time).
    """
    weights = np.clip(-scores - shift, -2.5, 4.0)
    if not (weights > 0).any():
        return []
    stack: list[list[float]] = []  # start, end, total before, total after
    total = 0.0
    for i, w in enumerate(weights.tolist()):
        before, total = total, total + w
        if w <= 0:
            continue
        run = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= run[2]:
                j -= 1
            if j < 0 or stack[j][3] >= run[3]:
                stack.append(run)
                break
            run = [stack[j][0], run[1], stack[j][2], run[3]]
            del stack[j:]
    return [(int(a), int(b) + 1, after - before) for a, b, before, after in stack]
