"""Consensus grades from raters who disagree: latent ability and difficulty, fitted together by gradient EM.

Model: an item deserves a score t; rater j gives ``a_j t + b_j`` plus noise of spread ``s_j`` (the inverse of ability)
times the item's difficulty ``d``. The habits a, b cover lenient, strict, compressed and reversed use of the scale, a
large spread covers careless raters. The E-step is the posterior of t, a normal one whose precision is the sum of
``a^2 / (s d)^2`` over the item's ratings, made robust by Student weights. In every round the items climb the gradient
of the expected log-likelihood in log-difficulty and the raters that in a, b and log-spread. At the end the scale is
the one of the typical careful rater; the posterior's mass in the four grade bands is the label posterior, and the
grade is the band in which half of that mass is reached.

Ratings are first summed per item and rater, so that an item has at most as many cells as there are raters, and laid
out by item once. A round is one pass over these partitions in Arrow batches, which brings back six sums per rater and
task, and one small shuffle of those sums. Raters are handed to the tasks by a broadcast join while they are at most
``BROADCAST_RATERS``; beyond that by a shuffled join and a new layout by item in each round.

Rater codes are compared without case and surrounding blanks; ratings without a rater form one rater "(unknown)". Null
scores and scores outside 0-100 are no ratings. Repeated rows count each. An item without any rating gets the prior.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmeta.session import cut_lineage

CUTS = (50.0, 70.0, 85.0)
CENTER = 75.0
NU = 4.0
ROUNDS = 14
#: Gradient steps of an item's difficulty in each round, and the ratings' worth of prior that holds it to 1.
STEPS, HELD = 4, 8.0
BROADCAST_RATERS = 200_000


def ratings(cross: DataFrame) -> DataFrame:
    """Long form: (id, system_id, rater, y), y being the score less CENTER."""
    both = cross.selectExpr("id", "system_id", "stack(2, primary_rater, primary_score, cross_rater, cross_score) AS (rater, score)")
    code = F.upper(F.regexp_replace("rater", r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return both.where("score BETWEEN 0 AND 100").select(
        "id", "system_id", F.when(code.isNull() | (code == ""), "(unknown)").otherwise(code).alias("rater"), (F.col("score") - CENTER).alias("y")
    )


def item_posteriors(item: np.ndarray, k: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray, prior: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """Of each item (numbered from 0): mean and variance of t - CENTER, and difficulty; of each cell its robust weight.

    A cell is k ratings of mean y by a rater of habits a, b and variance v.
    """
    mean, var = prior
    n_items = int(item.max()) + 1 if len(item) else 0
    sums = lambda x: np.bincount(item, weights=x, minlength=n_items)
    n, d2, w = sums(k), np.ones(n_items), np.ones(len(k))
    for step in range(STEPS + 1):
        p = w * k / (v * d2[item])
        precision = sums(p * a * a) + 1 / var
        m = (sums(p * a * (y - b)) + mean / var) / precision
        e2 = (y - b - a * m[item]) ** 2
        w = (NU + 1) / (NU + e2 / (v * d2[item]))
        if step:
            # The gradient in log d of the expected log-likelihood and its prior, as far as a step may go.
            chi = sums(w * k * (e2 + a * a / precision[item]) / v) / d2
            log_d = 0.5 * np.log(d2)
            d2 = np.exp(2 * np.clip(log_d + 0.5 * (chi - n - 2 * HELD * log_d) / (n + HELD), -0.7, 1.0))
    p = w * k / (v * d2[item])
    precision = sums(p * a * a) + 1 / var
    m = (sums(p * a * (y - b)) + mean / var) / precision
    return m, 1 / precision, np.sqrt(d2), w


def _by_item(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.Table]]:
    """Runs of whole items of a partition that is sorted by item: (first rows, item numbers, starts, rows)."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if rest.num_rows < 20_000:
                continue
        if rest is None or rest.num_rows == 0:
            return
        keys = [rest.column(c).combine_chunks() for c in ("id", "system_id")]
        new = np.ones(rest.num_rows, dtype=bool)
        coded = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in keys]
        new[1:] = (coded[0][1:] != coded[0][:-1]) | (coded[1][1:] != coded[1][:-1])
        starts = np.flatnonzero(new)
        upto = rest.num_rows if batch is None else int(starts[-1])  # the last item may go on in the next batch
        if upto:
            starts = starts[starts < upto]
            yield starts, np.cumsum(new[:upto]) - 1, rest.slice(0, upto)
        rest = rest.slice(upto)


class Consensus:
    """The fitted model: ``raters`` (habits and reliability) and ``items`` (posterior, grade, agreement)."""

    def __init__(self, cross: DataFrame, rounds: int = ROUNDS):
        cells = ratings(cross).groupBy("id", "system_id", "rater").agg(F.count("*").cast("double").alias("k"), F.avg("y").alias("y"), F.var_pop("y").alias("within"))
        self.cells = cut_lineage(cells.repartition("id", "system_id").sortWithinPartitions("id", "system_id"))
        first = self.cells.groupBy("id", "system_id").agg((F.sum(F.col("k") * F.col("y")) / F.sum("k")).alias("m")).agg(F.avg("m"), F.var_pop("m")).first()
        self.prior = (float(first[0] or 0.0), max(float(first[1] or 0.0), 100.0) + 100.0)
        raters = cut_lineage(self.cells.groupBy("rater").agg(F.sum("k").cast("long").alias("n_ratings")).selectExpr("rater", "1.0D AS a", "0.0D AS b", "100.0D AS v_r", "n_ratings"))
        self.small = raters.count() <= BROADCAST_RATERS
        for _ in range(rounds):
            raters = cut_lineage(self._next_raters(raters))
        self.raters_raw = raters
        # The typical careful rater defines the scale: medians over the raters with a spread below the median spread.
        mid = raters.agg(F.approx_percentile("v_r", 0.5, F.lit(100_000))).first()[0]
        careful = raters.where("a > 0.6 AND a < 1.5").where(F.col("v_r") <= F.lit(mid))
        scale = careful.agg(F.approx_percentile("a", 0.5, F.lit(100_000)), F.approx_percentile("b", 0.5, F.lit(100_000))).first()
        self.slope, self.shift = float(scale[0] or 1.0), float(scale[1] or 0.0)

    def _rated(self, raters: DataFrame) -> DataFrame:
        """The cells with their raters' habits, whole items in one partition, one after the other."""
        habits = raters.select("rater", "a", "b", "v_r")
        if self.small:
            return self.cells.join(F.broadcast(habits), "rater")
        return self.cells.join(habits, "rater").repartition("id", "system_id").sortWithinPartitions("id", "system_id")

    def _next_raters(self, raters: DataFrame) -> DataFrame:
        """One round: the items' posteriors and difficulties, and a gradient step of every rater's habits and log-spread."""
        prior = self.prior
        sums = ("s0", "s1", "s2", "t0", "t1", "tt")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, item, rows in _by_item(batches):
                k, y, within, a, b, v = (rows.column(c).to_numpy() for c in ("k", "y", "within", "a", "b", "v_r"))
                m, var, d, w = item_posteriors(item, k, y, a, b, v, prior)
                codes = rows.column("rater").combine_chunks().dictionary_encode()
                who, names = codes.indices.to_numpy(), codes.dictionary
                g, x, u = w * k / d[item] ** 2, m[item], var[item]
                parts = [np.bincount(who, weights=z, minlength=len(names)) for z in (g, g * x, g * (x * x + u), g * y, g * x * y, g * (y * y + within))]
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, parts)], ["rater", *sums])

        seen = self._rated(raters).mapInArrow(run, "rater STRING, " + ", ".join(f"{c} DOUBLE" for c in sums))
        s = seen.groupBy("rater").agg(*[F.sum(c).alias(c) for c in sums]).join(raters, "rater")
        # Gradients of the expected log-likelihood (times v) with weak priors: one rating's worth at b = 0, and a slope of 1
        # seen over a variance of 500. Both are scaled by the curvature, which makes the step that of Newton.
        s = s.withColumns({"ga": F.expr("t1 - a * s2 - b * s1 + 500 * (1 - a)"), "gb": F.expr("t0 - a * s1 - b * s0 - b"), "haa": F.expr("s2 + 500"), "hbb": F.expr("s0 + 1")})
        s = s.withColumn("det", F.expr("haa * hbb - s1 * s1"))
        s = s.withColumns({"a1": F.expr("a + (hbb * ga - s1 * gb) / det"), "b1": F.expr("b + (haa * gb - s1 * ga) / det")})
        rss = F.greatest(F.expr("tt - 2 * b1 * t0 - 2 * a1 * t1 + b1 * b1 * s0 + 2 * a1 * b1 * s1 + a1 * a1 * s2"), F.lit(0.0))
        # The gradient in log-spread is (residuals - n v) / v; its step is taken in logs, towards where it vanishes.
        step = 0.8 * (F.log((rss + 100) / (F.col("n_ratings") + 2)) - F.log("v_r"))
        return s.select("rater", F.col("a1").alias("a"), F.col("b1").alias("b"), F.exp(F.log("v_r") + step).alias("v_r"), "n_ratings")

    def items(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (id, system_id) with ``score``, ``spread``, the posteriors ``p1``..``p4``, ``grade``, ``difficulty``, ``n_ratings``."""
        mean, var = prior = self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for starts, item, rows in _by_item(batches):
                k, y, a, b, v = (rows.column(c).to_numpy() for c in ("k", "y", "a", "b", "v_r"))
                m, u, d, _ = item_posteriors(item, k, y, a, b, v, prior)
                heads = rows.select(["id", "system_id"]).take(pa.array(starts)).combine_chunks().to_batches()[0]
                n = np.bincount(item, weights=k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*heads.columns, *map(pa.array, (m, u, d, n))], ["id", "system_id", "m", "v", "d", "n"])

        fitted = self._rated(self.raters_raw).mapInArrow(run, "id STRING, system_id STRING, m DOUBLE, v DOUBLE, d DOUBLE, n BIGINT")
        joined = wanted.join(fitted, ["id", "system_id"], "left")
        score = CENTER + self.shift + self.slope * F.coalesce("m", F.lit(mean))
        spread = self.slope * F.sqrt(F.coalesce("v", F.lit(var)))
        out = joined.select("id", "system_id", score.alias("score"), spread.alias("spread"), F.coalesce("d", F.lit(1.0)).alias("difficulty"), F.coalesce("n", F.lit(0)).alias("n_ratings"))
        below = [_normal_cdf((F.lit(c) - F.col("score")) / F.col("spread")) for c in CUTS]
        parts = [below[0], below[1] - below[0], below[2] - below[1], 1 - below[2]]
        out = out.withColumns({f"p{i + 1}": p for i, p in enumerate(parts)})
        # The band in which half of the posterior's mass is reached.
        reached = [F.expr(" + ".join(f"p{j + 1}" for j in range(i + 1))) <= 0.5 for i in range(3)]
        return out.withColumn("grade", F.lit(1) + sum((r.cast("int") for r in reached), F.lit(0)))

    def raters(self) -> DataFrame:
        """Per rater: slope and bias on the consensus scale, spread, and reliability (correlation with the consensus)."""
        mean, var = self.prior
        a = F.col("a") / self.slope
        reach = F.abs(F.col("a")) * F.sqrt(F.lit(var))
        return self.raters_raw.select(
            "rater", "n_ratings", a.alias("slope"), (F.col("b") - a * self.shift).alias("bias"), F.sqrt("v_r").alias("spread"),
            (F.col("a") * F.sqrt(F.lit(var)) / F.sqrt(reach * reach + F.col("v_r"))).alias("reliability"),
        )


def _normal_cdf(z: Column) -> Column:
    """The normal distribution by Zelen and Severo's five-term formula (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) * 0.3989422804014327
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def agreement(cross: DataFrame) -> DataFrame:
    """Chance-corrected agreement of the grade bands: Krippendorff's alpha (ordinal weights) over all items rated twice or more.

    Built from counts per item and band (at most four rows an item), never from pairs of ratings.
    """
    band = F.lit(1) + sum(((F.col("y") + CENTER >= c).cast("int") for c in CUTS), F.lit(0))
    counts = ratings(cross).groupBy("id", "system_id").agg(
        *[F.sum((band == g).cast("long")).alias(f"c{g}") for g in (1, 2, 3, 4)]
    ).withColumn("n", F.expr("c1 + c2 + c3 + c4")).where("n >= 2")
    seen = [F.sum(F.col(f"c{g}") * F.col(f"c{h}") / (F.col("n") - 1)).alias(f"o{g}{h}") for g in (1, 2, 3, 4) for h in (1, 2, 3, 4) if g < h]
    totals = counts.agg(*seen, *[F.sum(f"c{g}").alias(f"t{g}") for g in (1, 2, 3, 4)], F.sum("n").alias("n_ratings"), F.count("*").alias("n_items"))

    def ordinal(g: int, h: int) -> Column:
        between = sum((F.col(f"t{k}") for k in range(g, h + 1)), F.lit(0.0))
        return (between - (F.col(f"t{g}") + F.col(f"t{h}")) / 2) ** 2

    pairs = [(g, h) for g in (1, 2, 3, 4) for h in (1, 2, 3, 4) if g < h]
    observed = sum((F.col(f"o{g}{h}") * ordinal(g, h) for g, h in pairs), F.lit(0.0))
    expected = sum((F.col(f"t{g}") * F.col(f"t{h}") * ordinal(g, h) for g, h in pairs), F.lit(0.0)) / (F.col("n_ratings") - 1)
    alpha = F.when(expected > 0, 1 - observed / expected)
    return totals.select("n_items", "n_ratings", F.round(alpha, 6).alias("alpha"))
