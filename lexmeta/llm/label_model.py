"""An expectation-maximisation label model over noisy labelling functions.

Votes are summed up to patterns before anything leaves Spark: k functions with votes 0 and 1 give at most 2^k rows, so
the fit is of fixed size however many rows voted. Each function has a hit rate on true and on false cases; both are
learned together with the share of true cases from the agreement of the functions; the rates that they have on cases of
known truth start the learning and hold it to the meaning of the votes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _patterns(df: DataFrame, asked: dict[str, list[str]], *by: str) -> DataFrame:
    """Counts per defect and pattern of its votes (``1`` and ``0`` in a row), in one pass. A null vote counts as 0."""
    each = [F.struct(F.lit(d).alias("defect"), F.concat(*[F.coalesce(F.col(v), F.lit(0)).cast("string") for v in some]).alias("pattern")) for d, some in asked.items()]
    return df.select(*by, F.explode(F.array(*each)).alias("e")).groupBy(*by, "e.defect", "e.pattern").agg(F.count("*").alias("n"))


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[float(x) for x in p] for p in patterns])


def vote_patterns(df: DataFrame, asked: dict[str, list[str]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each defect its distinct vote patterns (at most 2^k of k votes) and how many rows show each."""
    rows = _patterns(df, asked).collect()
    out = {}
    for d, some in asked.items():
        mine = [r for r in rows if r["defect"] == d]
        out[d] = (_matrix([r["pattern"] for r in mine]).reshape(-1, len(some)), np.array([r["n"] for r in mine], dtype=float))
    return out


def judged_patterns(df: DataFrame, asked: dict[str, list[str]], truth: str) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like vote_patterns, with the true defect of the rows: (patterns, truths, counts), at most 2^k rows for each truth."""
    rows = _patterns(df, asked, truth).collect()
    out = {}
    for d, some in asked.items():
        mine = [r for r in rows if r["defect"] == d]
        out[d] = (_matrix([r["pattern"] for r in mine]).reshape(-1, len(some)), np.array([r[truth] for r in mine]), np.array([r["n"] for r in mine], dtype=float))
    return out


def rates(patterns: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each function's hit rate on true cases and on false ones, from counted cases of known truth."""
    out = []
    for some in (truth, ~truth):
        n = counts * some
        out.append((n @ patterns + 0.5) / (n.sum() + 1))
    return out[0], out[1]


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 60, share: float = 0.03, known: tuple[np.ndarray, np.ndarray] | None = None, hold: float = 0.5) -> dict[tuple[int, ...], float]:
    """Posterior of a true case for each pattern; empty input gives no patterns.

    ``known`` rates (of cases whose truth is known) are where the steps start, and weigh ``hold`` in each of them.
    """
    if not len(patterns):
        return {}
    k = patterns.shape[1]
    hit, alarm = np.full(k, 0.8), np.full(k, 0.02)
    if known:
        hit, alarm = (np.clip(x, 1e-4, 0.98) for x in known)
    hit0, alarm0 = hit, alarm
    for _ in range(steps):
        log_true = np.log(share) + (patterns * np.log(hit) + (1 - patterns) * np.log(1 - hit)).sum(axis=1)
        log_false = np.log(1 - share) + (patterns * np.log(alarm) + (1 - patterns) * np.log(1 - alarm)).sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(log_false - log_true, -500, 500)))
        true, false = counts * q, counts * (1 - q)
        hit = (true @ patterns + 8) / (true.sum() + 10)  # priors: ten true cases at 0.8, a thousand false ones at 0.02
        alarm = (false @ patterns + 20) / (false.sum() + 1000)
        if known:
            hit, alarm = (1 - hold) * hit + hold * hit0, (1 - hold) * alarm + hold * alarm0
        hit, alarm = np.clip(hit, 0.02, 0.98), np.clip(alarm, 1e-4, 0.5)
        share = float(np.clip((true.sum() + 3) / (counts.sum() + 100), 1e-5, 0.5))
    return {tuple(int(x) for x in p): float(v) for p, v in zip(patterns, q)}


def posterior(votes: list[str], table: dict[tuple[int, ...], float]) -> Column:
    """The posterior as a column: a literal map from pattern to probability, unknown patterns give 0."""
    if not table:
        return F.lit(0.0)
    key = F.concat(*[F.coalesce(F.col(v), F.lit(0)).cast("string") for v in votes])
    pairs = [x for p, v in sorted(table.items()) for x in (F.lit("".join(map(str, p))), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(0.0))


def best_cutoff(scores: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> float:
    """The cutoff with the highest F1 on counted validation cases; of equals, the one nearest 0.65."""
    best = (0.0, -1.0, 0.5)
    for c in np.linspace(0.05, 0.95, 19):
        said = scores > c
        hit = float(counts[said & truth].sum())
        f1 = 2 * hit / max(1.0, float(counts[said].sum() + counts[truth].sum()))
        best = max(best, (f1, -abs(c - 0.65), float(c)))
    return best[2]
