import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmeta.functions import metrics as X
from lexmeta.functions.correlation import correlations, one_sided_p, signed_pairs
from lexmeta.operators import models

WORDS = st.lists(st.sampled_from("một hai ba bốn năm sáu".split()), max_size=9)


def table_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_metric_bounds_and_lcs(a, b):
    assert X.lcs(a, b) == table_lcs(a, b)
    scores = dict(zip(X.KEYS, X.score_row(" ".join(a), " ".join(b))))
    assert all(0 <= s <= 1 + 1e-12 for s in scores.values())
    if len(a) >= 4 and a == b:
        assert all(math.isclose(s, 1) for k, s in scores.items() if not k.startswith("meteor"))


def test_metric_values():
    s = dict(zip(X.KEYS, X.score_row("a b c d", "a b x d")))
    assert math.isclose(s["rouge_1"], 0.75) and math.isclose(s["rouge_2"], 1 / 3) and math.isclose(s["rouge_l"], 0.75)
    assert math.isclose(s["bleu_2"], math.sqrt((4 / 5) * (2 / 4)))
    assert math.isclose(s["meteor_a9_g0"], 0.75) and math.isclose(s["meteor_a9_g5"], 0.75 * (1 - 0.5 * (2 / 3) ** 3))
    assert set(X.score_row("", "a")) == {0.0} and set(X.score_row(None, None)) == {0.0}


def test_add_metrics_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", None, "x")], "k INT, reference_vi STRING, prediction_vi STRING, extra STRING")
    r = X.add_metrics(df).first()
    assert r.extra == "x" and r.rouge_1 == 0.0


def brute(x, y):
    n = len(x)
    s = sum(np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(n) for j in range(i))
    tx, ty = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (x, y))
    rank = lambda v: [sum(u < w for u in v) + (sum(u == w for u in v) + 1) / 2 for w in v]
    return np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1], s / math.sqrt(tx * ty)


def test_correlations_against_pairs(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 12) / 2, rng.randint(0, 5)) for g in ("a", "b") for _ in range(80)] + [("c", 1.0, 2), ("c", 1.0, 3), ("d", 1.0, 1), ("a", None, 1)]
    got = {r.g: r for r in correlations(spark.createDataFrame(rows, "g STRING, x DOUBLE, y INT"), ["g"], "x", "y").collect()}
    for g in "ab":
        want = brute(*zip(*[(x, y) for k, x, y in rows if k == g and x is not None]))
        assert np.allclose([got[g].pearson, got[g].spearman, got[g].kendall], want)
    assert all(math.isnan(v) for g in "cd" for v in (got[g].pearson, got[g].spearman, got[g].kendall))


def test_correlations_of_an_empty_table(spark):
    assert correlations(spark.createDataFrame([], "g STRING, x DOUBLE, y DOUBLE"), ["g"], "x", "y").count() == 0


def test_correlations_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [("hot", round(rng.gauss(0, 1), 2), rng.random()) for _ in range(1500)] + [("small", float(i), float(-i)) for i in range(5)]
    got = {r.g: r for r in correlations(spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE"), ["g"], "x", "y").collect()}
    want = brute(*zip(*[(x, y) for k, x, y in rows if k == "hot"]))
    assert np.allclose([got["hot"].pearson, got["hot"].spearman, got["hot"].kendall], want)
    assert np.allclose([got["small"].pearson, got["small"].spearman, got["small"].kendall], -1)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 3)), max_size=300))
@settings(deadline=None, max_examples=60)
def test_signed_pairs(cells):
    x, y, n = (np.array([c[k] for c in cells], dtype=float) for k in range(3))
    want = float(n @ (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)) @ n) / 2 if len(cells) else 0.0
    assert signed_pairs(x, y, n) == want


def test_p_value():
    assert math.isclose(one_sided_p(0.0, 10), 0.5) and math.isclose(one_sided_p(0.6319, 10), 0.025, abs_tol=2e-4)
    assert math.isclose(one_sided_p(0.5, 12) + one_sided_p(-0.5, 12), 1) and math.isnan(one_sided_p(0.5, 2))


def test_ridge_and_component(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(200, 3) * [1, 5, 0.2]
    y = x @ [2, -1, 3] + rng.randn(200) * 0.1
    rows = [(i, *map(float, r), float(t), "d" if i % 2 else "e") for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE, ds STRING")
    w, bias, oof = models.ridge_cv(df, "k", ["a", "b", "c"], "y")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(w, want) and oof.where("out_of_fold IS NULL").count() == 0
    assert models.model_bank(df, "ds", ["a", "b", "c"], "y").count() == 200
    mean, sd, v = models.first_component(df, ["a", "b", "c"])
    assert np.isclose(np.linalg.norm(v), 1) and v.sum() >= 0
