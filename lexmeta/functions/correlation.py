"""Pearson, Spearman and Kendall per group, at any group size.

Ranks are global per group, yet no group is sorted in one task: the counts of distinct pairs are range-partitioned by
either side, and each partition's ranks start at the count of all partitions before it. What is carried between
partitions is one row per partition and group, for Kendall one per pair of partitions.

A pair with a null side is left out. A constant side, or fewer than two rows, gives NaN, as does a NaN value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmeta.session import cut_lineage


def pearson(x: str, y: str) -> Column:
    """An aggregate: Pearson's r, NaN for a constant side or fewer than two rows (both columns without nulls)."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(x) < 2)
    return F.when(constant, F.lit(float("nan"))).otherwise(F.coalesce(r, F.lit(float("nan"))))


def _range_parts(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rows range-partitioned by keys and value, with the partition number; written out, for the bounds are sampled. Equal
    (keys, value) are never split."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, value).withColumn(out, F.spark_partition_id()))


def _average_ranks(cells: DataFrame, keys: list[str], value: str, part: str, out: str) -> DataFrame:
    """(keys, value, ``out``): the average rank (ties share it) of each distinct value inside its group, from counts."""
    counts = cells.groupBy(*keys, part, value).agg(F.sum("_n").alias("_c"))
    parts = counts.groupBy(*keys, part).agg(F.sum("_c").alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, part, F.coalesce(F.sum("_total").over(ahead), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*keys, part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_lower", F.coalesce(F.sum("_c").over(inside), F.lit(0.0))).join(offsets, [*keys, part])
    return ranked.select(*keys, value, (F.col("_before") + F.col("_lower") + (F.col("_c") + 1) / 2).alias(out))


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant pairs of weighted points, by halving at x and searching the sorted y of the lower half."""
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], n[order]
    total, todo = 0.0, [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or x[lo] == x[hi - 1]:
            continue
        if hi - lo <= 64:
            xs, ys, ns = x[lo:hi], y[lo:hi], n[lo:hi]
            total += float(ns @ (np.sign(xs[:, None] - xs) * np.sign(ys[:, None] - ys)) @ ns) / 2
            continue
        mid = lo + int(np.searchsorted(x[lo:hi], x[(lo + hi) // 2]))
        if mid == lo:
            mid = lo + int(np.searchsorted(x[lo:hi], x[lo], side="right"))
        low = lo + np.argsort(y[lo:mid], kind="stable")
        ahead = np.concatenate([[0.0], np.cumsum(n[low])])
        less, upto = (ahead[np.searchsorted(y[low], y[mid:hi], side=side)] for side in ("left", "right"))
        total += float((n[mid:hi] * (less - (ahead[-1] - upto))).sum())
        todo += [(lo, mid), (mid, hi)]
    return total


def _kendall(cells: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b per group from the counts of distinct (x, y), which lie in range partitions of x and of y.

    Pairs in one partition of x are counted there; pairs in one partition of y but not of x there, by the number of the x
    partition; all others from the counts per pair of partitions. No cell meets more than the cells of its partitions.
    """
    types = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _s DOUBLE"

    def counted(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            total = signed_pairs(part[a].to_numpy(dtype=float), part[b].to_numpy(dtype=float), part["_n"].to_numpy(dtype=float))
            return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "_s": [total]})

        return rows.groupBy(*keys, *by).applyInPandas(run, schema)

    blocks = cells.groupBy(*keys, "_px", "_py").agg(F.sum("_n").alias("_n"))
    signed = counted(cells, ["_px"], x, y).unionByName(counted(cells, ["_py"], "_px", y)).unionByName(counted(blocks, [], "_px", "_py"))

    def ties(*by: str) -> DataFrame:
        c = cells.groupBy(*keys, *by).agg(F.sum("_n").alias("_c"))
        return c.groupBy(*keys).agg((F.sum(F.col("_c") * (F.col("_c") - 1)) / 2).alias("_t" + "".join(by)))

    joined = signed.groupBy(*keys).agg(F.sum("_s").alias("_s")).join(ties(), keys).join(ties(x), keys).join(ties(y), keys)
    scale = F.sqrt((F.col("_t") - F.col(f"_t{x}")) * (F.col("_t") - F.col(f"_t{y}")))
    return joined.select(*keys, F.when(scale > 0, F.col("_s") / scale).otherwise(F.lit(float("nan"))).alias("kendall"))


def correlations(df: DataFrame, keys: list[str], x: str, y: str, kendall: bool = True) -> DataFrame:
    """(keys..., n, pearson, spearman[, kendall]) of x and y per group.

    All three come from the counts of distinct (x, y), written out once: the rows are never joined with their ranks, and
    nothing depends on ``df`` giving the same last bits twice.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    cells = pairs.groupBy(*keys, "_x", "_y").agg(F.count("*").cast("double").alias("_n"))
    cells = _range_parts(_range_parts(cells, keys, "_x", "_px"), keys, "_y", "_py")
    ranked = cells.join(_average_ranks(cells, keys, "_x", "_px", "_rx"), [*keys, "_x"]).join(_average_ranks(cells, keys, "_y", "_py", "_ry"), [*keys, "_y"])
    mean = lambda c: (F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"_m{c}")
    means = ranked.groupBy(*keys).agg(F.sum("_n").cast("long").alias("n"), *[mean(c) for c in ("_x", "_y", "_rx", "_ry")])

    def weighted(a: str, b: str) -> Column:
        da, db = F.col(a) - F.col(f"_m{a}"), F.col(b) - F.col(f"_m{b}")
        r = F.sum(F.col("_n") * da * db) / F.sqrt(F.sum(F.col("_n") * da * da)) / F.sqrt(F.sum(F.col("_n") * db * db))
        constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
        return F.when(constant, F.lit(float("nan"))).otherwise(F.coalesce(r, F.lit(float("nan"))))

    out = ranked.join(means, keys).groupBy(*keys, "n").agg(weighted("_x", "_y").alias("pearson"), weighted("_rx", "_ry").alias("spearman"))
    return out.join(_kendall(cells, keys, "_x", "_y"), keys, "left") if kendall else out


def one_sided_p(r: float, n: int) -> float:
    """P(a correlation of n unrelated pairs exceeds r), by Student's t and the incomplete beta function's continued fraction."""
    import math

    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0 if r > 0 else 1.0
    v = n - 2
    t = r * math.sqrt(v / (1 - r * r))
    x, a, b = v / (v + t * t), v / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h *= c * d
        return h

    tail = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return tail / 2 if t > 0 else 1 - tail / 2


def kendall_p(x: list[float], y: list[float]) -> float:
    """P(Kendall's tau of unrelated pairs is at least that of x and y): exact without ties, else by the normal limit."""
    import math
    from collections import Counter

    n = len(x)
    sign = lambda d: (d > 0) - (d < 0)
    s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i in range(n) for j in range(i))
    tx, ty = Counter(x).values(), Counter(y).values()
    if n < 2 or len(tx) < 2 or len(ty) < 2:
        return float("nan")
    if len(tx) == len(ty) == n:
        ways = [1]  # orders of k values by their number of concordant pairs
        for k in range(2, n + 1):
            ways = [sum(ways[max(0, c - k + 1) : c + 1]) for c in range(len(ways) + k - 1)]
        return sum(ways[(s + n * (n - 1) // 2) // 2 :]) / math.factorial(n)
    m = n * (n - 1)
    term = lambda f: [sum(f(t) for t in g) for g in (tx, ty)]
    (x1, y1), (x0, y0), (xt, yt) = term(lambda t: t * (t - 1) * (2 * t + 5)), term(lambda t: t * (t - 1) * (t - 2)), term(lambda t: t * (t - 1) / 2)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(s / math.sqrt(2 * var)) / 2


def small_correlation(kind: str, x: list[float], y: list[float]) -> tuple[float, float]:
    """(coefficient, one-sided p) of a few pairs, such as one for each metric; NaN as in ``correlations``."""
    nan = float("nan")
    if len(x) < 2 or len(set(x)) < 2 or len(set(y)) < 2:
        return nan, nan
    a, b = np.array(x, float), np.array(y, float)
    if kind == "kendall":
        signs = lambda v: np.sign(v[:, None] - v[None, :])
        sa, sb = signs(a), signs(b)
        return float((sa * sb).sum() / np.sqrt((sa**2).sum() * (sb**2).sum())), kendall_p(x, y)
    if kind == "spearman":
        ranks = lambda v: (v[:, None] > v[None, :]).sum(1) + ((v[:, None] == v[None, :]).sum(1) + 1) / 2
        a, b = ranks(a), ranks(b)
    r = float(np.corrcoef(a, b)[0, 1])
    return r, one_sided_p(r, len(x))
