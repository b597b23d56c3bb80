"""Queries over every computed metric, against their SQL-bound forms and brute force."""

import itertools
import math
import os

import pytest

from lexmeta.functions import metrics as X
from lexmeta.functions.correlation import kendall_p, small_correlation
from lexmeta.plans import catalog
from lexmeta.plans import metric_sql as Q
from lexmeta.sources.tables import table

SMALL = os.environ.get("LEXMETA_TEST_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def made_scores(spark, *keep):
    """Usable damage rows with all scores, worked out row by row."""
    rows = table(spark, SMALL, "damage_row", *dict.fromkeys(("damage_id", "damage_level", "status", "reference_vi", "prediction_vi", *keep))).collect()
    ok = [r for r in rows if (r.status or "ok") == "ok" and (r.prediction_vi or "").strip(" ") and r.damage_level is not None]
    return [(r, dict(zip(X.KEYS, [round(v, 9) for v in X.score_row(r.reference_vi, r.prediction_vi)]))) for r in ok]


@needs_tables
@pytest.mark.parametrize("name", ["h9_score_grid", "d11_mean_of_datasets", "d12_level_means", "f6_level_diagnostics", "d6_r_syn", "d24_redundancy"])
def test_all_metrics_are_there(spark, name):
    one, whole = ({r.metric: r for r in catalog.queries()[n](spark, SMALL).collect()} for n in (name, name + "_all"))
    assert set(one) == set(Q.SQL_KEYS) and set(whole) == set(X.KEYS)
    if name != "d24_redundancy":  # rouge_l is a partner of the other ROUGE metrics there
        assert all(repr(one[k]) == repr(whole[k]) for k in one)


@needs_tables
def test_level_means_by_brute_force(spark):
    scored = made_scores(spark)
    for r in catalog.queries()["d12_level_means_all"](spark, SMALL).collect():
        for level in range(6):
            v = [s[r.metric] for row, s in scored if row.damage_level == level]
            assert math.isclose(r[f"l{level}"], sum(v) / len(v), abs_tol=2e-6)


@needs_tables
def test_meta_correlation_of_all_metrics(spark):
    r = catalog.queries()["d8_meta_with_p"](spark, SMALL).first()
    assert r.common_metrics == len(X.KEYS)
    assert all(-1 <= r[f"meta_{c}"] <= 1 and 0 <= r[f"meta_{c}_pvalue"] <= 1 for c in ("pearson", "spearman", "kendall"))
    seven = catalog.queries()["d7_meta_correlation_all"](spark, SMALL).first()
    assert seven.common_metrics == len(X.KEYS) and all(math.isclose(seven[f"meta_{c}"], r[f"meta_{c}"], abs_tol=6e-5) for c in ("pearson", "spearman", "kendall"))


def test_models_take_all_metrics(spark, monkeypatch):
    from lexmeta.operators import models
    from lexmeta.plans import reports

    seen = {}

    class Stop(Exception):
        pass

    def stop(name, at):
        def f(*args):
            seen[name] = list(args[at])
            raise Stop

        monkeypatch.setattr(models, name, f)

    monkeypatch.setattr(reports, "_light", lambda *_: None)
    for query, name, at in (("i1_ridge", "ridge_cv", 2), ("i2_model_bank", "model_bank", 2), ("i3_first_component", "first_component", 1)):
        stop(name, at)
        with pytest.raises(Stop):
            catalog.queries()[query](spark, "")
    assert all(v == list(X.KEYS) for v in seen.values()) and len(seen) == 3


def test_kendall_p():
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    sign = lambda d: (d > 0) - (d < 0)
    score = lambda y: sum(sign(i - j) * sign(y[i] - y[j]) for i in range(5) for j in range(i))
    every = [score(y) for y in itertools.permutations(x)]
    for y in ([2.0, 1.0, 4.0, 3.0, 5.0], [5.0, 3.0, 4.0, 2.0, 1.0], x):
        assert math.isclose(kendall_p(x, y), sum(s >= score(y) for s in every) / len(every))
    assert math.isnan(kendall_p([1.0, 1.0], [1.0, 2.0]))
    tied, other = [1.0, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 2.0, 3.0, 3.0]
    assert kendall_p(tied, other) < 0.1 and math.isclose(kendall_p(tied, other) + kendall_p(tied, [-v for v in other]), 1)
    assert small_correlation("kendall", x, x) == (1.0, 1 / 120) and math.isnan(small_correlation("pearson", [1.0], [2.0])[0])


@needs_tables
@pytest.mark.parametrize("name", ["d13_failure_rate", "f2_worst_failures", "f3_worst_groups", "d25_prompt_robustness"])
def test_reports_of_each_metric(spark, name):
    whole = catalog.queries()[name + "_all"](spark, SMALL)
    rows = whole.collect()
    assert {r.metric for r in rows} == set(X.KEYS)
    columns = [c for c in whole.columns if c != "metric"]
    one = catalog.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, one), key=repr) == sorted((tuple(r[c] for c in columns) for r in rows if r.metric == "rouge_1"), key=repr)


@needs_tables
def test_failures_of_each_metric_by_brute_force(spark):
    scored = made_scores(spark, "id", "prompt_type")
    got = {(r.metric, r.prompt_type): (r.comparisons, r.failures) for r in catalog.queries()["d13_failure_rate_all"](spark, SMALL).collect()}
    want = {}
    for k in X.KEYS:
        clean = {}
        for r, s in scored:
            if r.damage_level == 0:
                clean.setdefault((r.id, r.prompt_type), []).append(s[k])
        for r, s in scored:
            if r.damage_level > 0 and (c := clean.get((r.id, r.prompt_type))):
                n, bad = want.get((k, r.prompt_type), (0, 0))
                want[k, r.prompt_type] = (n + 1, bad + (s[k] > sum(c) / len(c) + 1e-9))
    assert got == want
