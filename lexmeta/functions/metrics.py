"""Sentence-level text metrics, all configurations of a row from one pass over its n-grams.

Definitions of record (words are blank-separated, case and marks count):

- BLEU-n: clipped precisions (m + 1) / (t + 1) for orders 1..n, geometric mean, brevity penalty exp(1 - r/c) for c <= r;
  0 for a blank prediction or an empty reference.
- chrF(c, w): characters without blanks, orders 1..c, and words, orders 1..w; precision and recall are averaged over
  the orders present on both sides; F with beta 2; 0 without a common order or with an empty side.
- ROUGE-n: F1 of the clipped n-gram overlap; ROUGE-L: F1 of the longest common subsequence of words.
- METEOR: exact matches in order of least crossing, F = PR / (aP + (1 - a)R), penalty g * (chunks / matches) ** 3.

Null counts as empty text. The work per row is a map over Arrow batches: n-grams of a row are counted once and every
metric of the grid is taken from the counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLEU_ORDERS = (1, 2, 3, 4)
CHRF_CONFIGS = ((4, 0), (4, 2), (6, 0), (6, 2))
ROUGE_ORDERS = (1, 2, 4)
METEOR_CONFIGS = ((0.2, 0.0), (0.2, 0.5), (0.9, 0.0), (0.9, 0.5))
KEYS = (
    *(f"bleu_{n}" for n in BLEU_ORDERS), *(f"chrf_{c}_{w}" for c, w in CHRF_CONFIGS), *(f"rouge_{n}" for n in ROUGE_ORDERS), "rouge_l",
    *(f"meteor_a{round(a * 10)}_g{round(g * 10)}" for a, g in METEOR_CONFIGS),
)


def grams(units: list[str] | str, n: int) -> Counter:
    if isinstance(units, list):
        return Counter(zip(*[units[k:] for k in range(n)]))
    return Counter([units[i : i + n] for i in range(len(units) - n + 1)])


def overlap(a: Counter, b: Counter) -> int:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    find, total = large.get, 0
    for k, n in small.items():
        if m := find(k):
            total += n if n < m else m
    return total


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one row of bits per word, as integers of any size."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def _f1(hits: float, ref: int, pred: int) -> float:
    return 2 * hits / (ref + pred) if hits else 0.0


def _alignment(ref: list[str], pred: list[str]) -> tuple[int, int]:
    """Exact matches and chunks; a word takes the free place right after its neighbour's, or the first free one."""
    free: dict[str, list[int]] = {}
    for i, w in enumerate(ref):
        free.setdefault(w, []).append(i)
    matches = chunks = 0
    before, adjacent = -2, False
    for w in pred:
        places = free.get(w)
        if not places:
            adjacent = False
            continue
        at = before + 1 if adjacent and before + 1 in places else places[0]
        places.remove(at)
        chunks += not (adjacent and at == before + 1)
        matches, before, adjacent = matches + 1, at, True
    return matches, chunks


def score_row(ref: str | None, pred: str | None, keys: tuple[str, ...] = KEYS) -> list[float]:
    """The metrics ``keys`` for one pair; only what they need is counted."""
    ref, pred = ref or "", pred or ""
    r, p = ref.split(), pred.split()
    done: dict[tuple[str, int], tuple[int, int, int]] = {}

    def counted(kind: str, n: int) -> tuple[int, int, int]:
        """n-grams of the reference and of the prediction, and those in common; of words, or of characters without blanks."""
        if (kind, n) not in done:
            a, b = (r, p) if kind == "words" else ("".join(r), "".join(p))
            done[kind, n] = max(0, len(a) - n + 1), max(0, len(b) - n + 1), overlap(grams(a, n), grams(b, n))
        return done[kind, n]

    aligned: list[tuple[int, int]] = []
    out = []
    for key in keys:
        family, *config = key.split("_")
        score = 0.0
        if family == "bleu" and p and ref:
            order = int(config[0])
            logs = sum(math.log((counted("words", n)[2] + 1) / (max(0, len(p) - n + 1) + 1)) for n in range(1, order + 1)) / order
            score = math.exp(logs) * (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))
        elif family == "chrf":
            orders = [x for kind, most in zip(("chars", "words"), map(int, config)) for n in range(1, most + 1) if (x := counted(kind, n))[0] and x[1]]
            if orders:
                precision, recall = sum(h / b for _, b, h in orders) / len(orders), sum(h / a for a, _, h in orders) / len(orders)
                score = 5 * precision * recall / (4 * precision + recall) if precision + recall else 0.0
        elif key == "rouge_l":
            score = _f1(lcs(r, p), len(r), len(p)) if r and p else 0.0
        elif family == "rouge":
            n_ref, n_pred, hits = counted("words", int(config[0]))
            score = _f1(hits, n_ref, n_pred)
        elif family == "meteor":
            if not aligned:
                aligned.append(_alignment(r, p))
            m, chunks = aligned[0]
            if m:
                a, g = (int(c[1:]) / 10 for c in config)
                precision, recall = m / len(p), m / len(r)
                score = precision * recall / (a * precision + (1 - a) * recall) * (1 - g * (chunks / m) ** 3)
        out.append(score)
    return out


def add_metrics(df: DataFrame, reference: str = "reference_vi", prediction: str = "prediction_vi", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``df`` with a DOUBLE column per metric key."""
    if clash := set(keys) & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    if unknown := set(keys) - set(KEYS):
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score_row(r, p, keys) for r, p in zip(batch.column(reference).to_pylist(), batch.column(prediction).to_pylist())]
            new = [pa.array([row[i] for row in rows], pa.float64()) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *keys])

    return df.mapInArrow(run, schema)


def long_scores(scored: DataFrame, keep: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per row and metric: (keep..., metric, score)."""
    return scored.unpivot(keep, list(keys), "metric", "score")


def metric_specs(spark) -> DataFrame:
    """The catalogue of metric configurations: 28 keys in seven families; ``light`` ones need no trained weights."""
    heavy = {"bertscore": 4, "comet": 4, "bleurt": 4}
    rows = [(k, k.split("_")[0], True) for k in KEYS] + [(f"{f}_{i}", f, False) for f, n in heavy.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "metric STRING, family STRING, light BOOLEAN")


def bertscore_kernel(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Greedy-matching precision, recall and F1 from token vectors (group, token, vector) of two sides.

    Both sides of a group are token lists of one sentence, so a group is as small as a sentence; tokens are matched by a
    join on the group with the best cosine taken by aggregation.
    """

    def unit(df: DataFrame, name: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return df.select("group", F.col("token").alias(name), F.transform("vector", lambda x: x.cast("double") / norm).alias(f"v_{name}"))

    pairs = unit(candidates, "c").join(unit(references, "r"), "group")
    dot = F.aggregate(F.zip_with("v_c", "v_r", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sims = pairs.select("group", "c", "r", dot.alias("sim"))
    best_c = sims.groupBy("group", "c").agg(F.max("sim").alias("m")).groupBy("group").agg(F.avg("m").alias("precision"))
    best_r = sims.groupBy("group", "r").agg(F.max("sim").alias("m")).groupBy("group").agg(F.avg("m").alias("recall"))
    both = best_c.join(best_r, "group")
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
