"""Small models over metric scores: ridge with cross-validation, a bank of models per dataset, the first principal
component. Data is reduced in Spark to sums of products, k x k numbers for k features (the metric grid has at most 28);
the equations are solved on these.

Rows with a null or NaN feature or target are left out. A constant feature gets weight 0; an empty group has no model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moment_rows(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per group: n, sums and products of the columns, in one aggregate."""
    ok = df
    for c in columns:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(c).cast("double") for c in columns]).alias("s"), F.array(*[p.cast("double") for p in products]).alias("p"))


def _square(s: list[float], p: list[float]) -> tuple[np.ndarray, np.ndarray]:
    k = len(s)
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.array(p, dtype=float)
    return np.array(s, dtype=float), out + np.triu(out, 1).T


def _moments(df: DataFrame, by: list[str], columns: list[str]) -> list[tuple]:
    """The groups' values, n, sums and products; for groupings of a known few groups (folds, or none at all)."""
    return [(tuple(r[b] for b in by), r["n"], *(_square(r["s"], r["p"]) if r["n"] else (np.zeros(len(columns)), np.zeros((len(columns),) * 2)))) for r in _moment_rows(df, by, columns).collect()]


def _solve(n: float, s: np.ndarray, p: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised features (population spread), given back on the plain scale; the last column is the target."""
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
    use = sd > 1e-12
    w = np.zeros(len(sd))
    if use.any():
        z = cov[:-1, :-1][np.ix_(use, use)] / np.outer(sd[use], sd[use])
        w[use] = np.linalg.solve(n * z + alpha * np.eye(use.sum()), n * cov[:-1, -1][use] / sd[use]) / sd[use]
    return w, float(mean[-1] - w @ mean[:-1])


def predict(features: list[str], w: np.ndarray, b: float) -> Column:
    return sum((F.col(c) * float(x) for c, x in zip(features, w)), F.lit(float(b)))


def ridge_cv(df: DataFrame, key: str, features: list[str], target: str, alpha: float = 1.0, folds: int = 5) -> tuple[np.ndarray, float, DataFrame]:
    """Weights and bias over all rows, and (key, target, ``out_of_fold``); folds by hash of the key."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    marked = df.withColumn("_fold", fold)
    parts = {k[0]: (n, s, p) for k, n, s, p in _moments(marked, ["_fold"], [*features, target])}
    total = [sum(x[i] for x in parts.values()) for i in range(3)]
    out = F.lit(None).cast("double")
    for k, (n, s, p) in parts.items():
        if total[0] > n:
            w, b = _solve(total[0] - n, total[1] - s, total[2] - p, alpha)
            out = F.when(F.col("_fold") == k, predict(features, w, b)).otherwise(out)
    w, b = _solve(*total, alpha) if parts else (np.zeros(len(features)), 0.0)
    return w, b, marked.select(key, target, out.alias("out_of_fold"))


def model_bank(df: DataFrame, dataset: str, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """``df`` with the score of its dataset's own ridge model; datasets of fewer rows than features score 0."""
    kind, least = dict(df.dtypes)[dataset], len(features)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fits = [(k, *_solve(n, *_square(s, p), alpha)) for k, n, s, p in part.itertuples(index=False) if n > least]
            yield pd.DataFrame({dataset: [k for k, _, _ in fits], "_w": [w.tolist() for _, w, _ in fits], "_b": [b for _, _, b in fits]})

    models = _moment_rows(df, [dataset], [*features, target]).mapInPandas(run, f"`{dataset}` {kind}, _w ARRAY<DOUBLE>, _b DOUBLE")
    dot = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), "_w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.join(models, dataset, "left").withColumn("bank_score", F.coalesce(dot + F.col("_b"), F.lit(0.0))).drop("_w", "_b")


def first_component(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and weights of the first principal component, its sign such that it goes with the mean score."""
    found = _moments(df, [], features)
    n, s, p = found[0][1:]
    if not n:
        return np.zeros(len(features)), np.ones(len(features)), np.zeros(len(features))
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd[sd < 1e-12] = 1.0
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    v = vectors[:, -1]
    return mean, sd, v if v.sum() >= 0 else -v
