"""Queries of metrics and correlations (H, D1-D15, D24, F2-F6, C7, C9, C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmeta.functions import metrics as X
from lexmeta.functions.correlation import correlations, pearson
from lexmeta.operators import matching as M
from lexmeta.plans import metric_sql as Q
from lexmeta.plans.registry import Registry
from lexmeta.session import cut_lineage
from lexmeta.sources.tables import table

R = Registry()
queries, ORACLES = R.queries, R.oracles
KEYS = Q.SQL_KEYS  # what SQL can express; the queries named _all go over X.KEYS, all that is computed
_HUMAN = "SELECT row_id, reference_vi, prediction_vi FROM benchmark_row"
_MADE = "SELECT damage_id, reference_vi, prediction_vi FROM damage_row WHERE coalesce(status, 'ok') = 'ok' AND trim(coalesce(prediction_vi, '')) <> '' AND damage_level IS NOT NULL"


def over_all(query):
    """Registers ``query`` once more under its name with _all: over every computed metric, also those without SQL."""

    def whole(spark, d):
        return query(spark, d, metrics=X.KEYS)

    whole.__name__, whole.__doc__ = f"{query.__name__}_all", f"{query.__doc__.rstrip('.')}. Over all computed metrics."
    R.add()(whole)
    return query


def _human(spark, d, *keep: str, keys=KEYS) -> DataFrame:
    return X.add_metrics(table(spark, d, "benchmark_row", "row_id", "reference_vi", "prediction_vi", *keep), keys=keys)


def _made(spark, d, *keep: str, keys=KEYS) -> DataFrame:
    rows = table(spark, d, "damage_row", *dict.fromkeys(("damage_id", "reference_vi", "prediction_vi", "damage_level", "status", *keep)))
    ok = rows.where("coalesce(status, 'ok') = 'ok' AND trim(coalesce(prediction_vi, '')) <> '' AND damage_level IS NOT NULL")
    return X.add_metrics(ok, keys=keys)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _metric_query(name: str, keys: tuple[str, ...], doc: str) -> None:
    def query(spark, d):
        return _rounded(_human(spark, d, keys=keys), *keys).select("row_id", *keys)

    query.__doc__, query.__name__ = doc, name
    known = all(k in KEYS for k in keys)
    R.add(f"WITH {Q.scores(_HUMAN, 'row_id')} SELECT row_id, {', '.join(f'ROUND({k}, 6) AS {k}' for k in keys)} FROM wide" if known else None)(query)


_metric_query("h1_bleu", KEYS[:4], "Smoothed sentence BLEU of orders 1 to 4.")
_metric_query("h2_chrf", KEYS[4:8], "Character F-score with and without words.")
_metric_query("h3_rouge_n", KEYS[8:], "ROUGE-1, -2 and -4.")
_metric_query("h3_rouge_l", ("rouge_l",), "ROUGE-L (checked against a table-filling version in the tests).")
_metric_query("h4_meteor", tuple(k for k in X.KEYS if k.startswith("meteor")), "METEOR, exact stage (checked on fixtures).")


@over_all
@R.add(f"WITH {Q.scores(_MADE, 'damage_id')}, {Q.long('', 'damage_id')} SELECT metric, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean, ROUND(MIN(score), 6) AS lo, ROUND(MAX(score), 6) AS hi FROM long GROUP BY metric")
def h9_score_grid(spark, d, metrics=KEYS):
    """The grid of rows by metrics in long form, summed up per metric (d34: the range that rewards are scaled by)."""
    s = X.long_scores(_made(spark, d, keys=metrics), ["damage_id"], metrics).withColumn("score", F.round("score", 9))
    return s.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("lo"), F.round(F.max("score"), 6).alias("hi"))


@R.add("""WITH v AS (SELECT label, vec_id, vec_id % 2 AS side, embedding FROM embeddings),
  s AS (SELECT a.label, a.vec_id AS c, b.vec_id AS r, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM v a JOIN v b ON a.label = b.label AND a.side = 0 AND b.side = 1),
  p AS (SELECT label, AVG(m) AS precision FROM (SELECT label, c, MAX(sim) AS m FROM s GROUP BY ALL) GROUP BY label), r AS (SELECT label, AVG(m) AS recall FROM (SELECT label, r, MAX(sim) AS m FROM s GROUP BY ALL) GROUP BY label)
SELECT label AS "group", ROUND(precision, 5) AS precision, ROUND(recall, 5) AS recall, ROUND(2 * precision * recall / (precision + recall), 5) AS f1 FROM p JOIN r USING (label)""")
def h5_bertscore_kernel(spark, d):
    """Greedy cosine matching of two lists of vectors per label."""
    v = table(spark, d, "embeddings", "label", "vec_id", "embedding").selectExpr("label AS group", "vec_id AS token", "embedding AS vector")
    out = X.bertscore_kernel(v.where("token % 2 = 0"), v.where("token % 2 = 1"))
    return out.select("group", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")])


def _corr_select(frm: str, keys: str) -> str:
    return f"SELECT {keys}, n, ROUND(pearson, 5) AS pearson, ROUND(spearman, 5) AS spearman, ROUND(kendall, 5) AS kendall FROM {frm}"


def _hum(spark, d, *keys: str, metrics=KEYS) -> DataFrame:
    rows = _human(spark, d, "human_score", "quality_flags", *[k for k in keys if k != "metric"], keys=metrics).where("size(quality_flags) = 0 AND human_score BETWEEN 0 AND 100")
    s = X.long_scores(rows, ["row_id", "human_score", *[k for k in keys if k != "metric"]], metrics).withColumn("score", F.round("score", 9))
    return correlations(s, list(keys), "score", "human_score")


def _syn(spark, d, metrics=KEYS) -> DataFrame:
    s = X.long_scores(_made(spark, d, keys=metrics), ["damage_id", "damage_level"], metrics).withColumn("score", F.round("score", 9))
    return correlations(s.withColumn("quality", -F.col("damage_level")), ["metric"], "score", "quality")


_HUM_SQL = f"""{Q.scores(_HUMAN, 'row_id', 'h_')}, {Q.long('h_', 'row_id')},
h_in AS (SELECT l.metric, l.score, b.human_score, b.channel FROM h_long l JOIN benchmark_row b USING (row_id) WHERE len(b.quality_flags) = 0 AND b.human_score BETWEEN 0 AND 100)"""
_SYN_SQL = f"""{Q.scores(_MADE, 'damage_id', 's_')}, {Q.long('s_', 'damage_id')},
s_in AS (SELECT l.metric, l.score, -d.damage_level AS quality FROM s_long l JOIN damage_row d USING (damage_id))"""


@over_all
@R.add(f"WITH {_HUM_SQL}, {Q.correlations('h_in', ['metric'], 'score', 'human_score', 'h_')} {_corr_select('h_corr', 'metric')}")
def d5_r_hum(spark, d, metrics=KEYS):
    """How each metric goes with the human scores of clean rows."""
    return _rounded5(_hum(spark, d, "metric", metrics=metrics), "metric")


def _rounded5(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[F.round(c, 5).alias(c) for c in ("pearson", "spearman", "kendall")])


@over_all
@R.add(f"WITH {_SYN_SQL}, {Q.correlations('s_in', ['metric'], 'score', 'quality', 's_')} {_corr_select('s_corr', 'metric')}")
def d6_r_syn(spark, d, metrics=KEYS):
    """How each metric goes with the negated damage level of usable rows."""
    return _rounded5(_syn(spark, d, metrics), "metric")


@over_all
@R.add(f"""WITH {_HUM_SQL}, {Q.correlations('h_in', ['metric'], 'score', 'human_score', 'h_')}, {_SYN_SQL}, {Q.correlations('s_in', ['metric'], 'score', 'quality', 's_')},
both_ AS (SELECT h.metric, h.pearson AS hp, h.spearman AS hs, h.kendall AS hk, s.pearson AS sp, s.spearman AS ss, s.kendall AS sk FROM h_corr h JOIN s_corr s USING (metric)),
{Q.correlations('both_', [], 'ROUND(hp, 9)', 'ROUND(sp, 9)', 'p_')}, {Q.correlations('both_', [], 'ROUND(hs, 9)', 'ROUND(ss, 9)', 'r_')}, {Q.correlations('both_', [], 'ROUND(hk, 9)', 'ROUND(sk, 9)', 'k_')}
SELECT p_corr.n AS common_metrics, ROUND(p_corr.pearson, 4) AS meta_pearson, ROUND(r_corr.spearman, 4) AS meta_spearman, ROUND(k_corr.kendall, 4) AS meta_kendall FROM p_corr, r_corr, k_corr""")
def d7_meta_correlation(spark, d, metrics=KEYS):
    """Correlation of the human and the synthetic ranking of metrics: Pearson of Pearsons, Spearman of Spearmans, Kendall of Kendalls."""
    h, s = _hum(spark, d, "metric", metrics=metrics), _syn(spark, d, metrics)
    both = h.select("metric", *[F.round(c, 9).alias(f"h_{c}") for c in ("pearson", "spearman", "kendall")]).join(s.select("metric", *[F.round(c, 9).alias(f"s_{c}") for c in ("pearson", "spearman", "kendall")]), "metric")
    finite = both.where(" AND ".join(f"NOT isnan({c})" for c in both.columns[1:])).withColumn("one", F.lit(1))
    finite = cut_lineage(finite)  # one row for each metric
    parts = [correlations(finite, ["one"], f"h_{c}", f"s_{c}").select("one", "n", F.round(c, 4).alias(f"meta_{c}")) for c in ("pearson", "spearman", "kendall")]
    return parts[0].join(parts[1].drop("n"), "one").join(parts[2].drop("n"), "one").select(F.col("n").alias("common_metrics"), "meta_pearson", "meta_spearman", "meta_kendall")


def _family_pairs(metrics=KEYS):
    fams = {f: [k for k in metrics if k.startswith(f + "_")] for f in ("bleu", "chrf", "rouge", "meteor")}
    return [(f, a, b) for f, ks in fams.items() for a in ks for b in ks if a != b]


@over_all
@R.add(f"""WITH {Q.scores(_HUMAN, 'row_id')}, w AS (SELECT {", ".join(f"ROUND({k}, 9) AS {k}" for k in KEYS)} FROM wide),
p AS ({" UNION ALL ".join(f"SELECT '{f}' AS family, '{a}***{b}' AS pair, {Q.pearson(a, b)} AS pearson FROM w" for f, a, b in _family_pairs())})
SELECT family, pair, ROUND(pearson, 4) AS pearson FROM p UNION ALL SELECT family, 'mean', ROUND(AVG(pearson), 4) FROM p GROUP BY family""")
def d10_metric_pairs(spark, d, metrics=KEYS):
    """Correlation of metrics of a family, each ordered pair, and the family's mean, from one pass over the wide scores."""
    w = _human(spark, d, keys=metrics).select(*[F.round(k, 9).alias(k) for k in metrics])
    one = w.agg(*[pearson(a, b).alias(f"{f}|{a}***{b}") for f, a, b in _family_pairs(metrics)])
    p = one.unpivot([], one.columns, "name", "pearson").select(F.split_part("name", F.lit("|"), F.lit(1)).alias("family"), F.split_part("name", F.lit("|"), F.lit(2)).alias("pair"), "pearson")
    out = p.unionByName(p.groupBy("family").agg(F.lit("mean").alias("pair"), F.avg("pearson").alias("pearson")))
    return out.select("family", "pair", F.round("pearson", 4).alias("pearson"))


@over_all
@R.add(f"""WITH {Q.scores(_HUMAN, 'row_id')}, w AS (SELECT {", ".join(f"ROUND({k}, 9) AS {k}" for k in KEYS)} FROM wide),
p AS ({" UNION ALL ".join(f"SELECT '{f}' AS family, '{a}' AS m1, '{b}' AS m2, ROUND({Q.pearson(a, b)}, 9) AS r FROM w" for f, a, b in _family_pairs())})
SELECT metric, COUNT(*) AS pairs, COUNT(*) FILTER (r >= 0.98) AS redundant, ROUND(AVG(r), 5) AS mean FROM (SELECT m1 AS metric, r FROM p UNION ALL SELECT m2, r FROM p) GROUP BY metric""")
def d24_redundancy(spark, d, metrics=KEYS):
    """How many of a metric's pairs go together at 0.98 or more; every ordered pair counts for both sides."""
    w = _human(spark, d, keys=metrics).select(*[F.round(k, 9).alias(k) for k in metrics])
    one = w.agg(*[F.round(pearson(a, b), 9).alias(f"{a}|{b}") for _, a, b in _family_pairs(metrics)])
    p = one.unpivot([], one.columns, "name", "r")
    sides = p.select(F.explode(F.split("name", r"\|")).alias("metric"), "r")
    return sides.groupBy("metric").agg(F.count("*").alias("pairs"), F.count_if(F.col("r") >= 0.98).alias("redundant"), F.round(F.avg("r"), 5).alias("mean"))


@over_all
@R.add(f"""WITH {_HUM_SQL}, c AS (SELECT metric, channel, COUNT(*) AS len, {Q.pearson("score", "human_score")} AS r FROM h_in GROUP BY metric, channel)
SELECT metric, ROUND(AVG(r) FILTER (NOT isnan(r)), 5) AS mean, ROUND(SUM(CASE WHEN isnan(r) THEN 0 ELSE r * len END) / SUM(len), 5) AS weighted FROM c GROUP BY metric""")
def d11_mean_of_datasets(spark, d, metrics=KEYS):
    """Mean correlation over channels as datasets: NaN ones skipped; the weighted mean divides by all rows, also theirs."""
    rows = _human(spark, d, "human_score", "quality_flags", "channel", keys=metrics).where("size(quality_flags) = 0 AND human_score BETWEEN 0 AND 100")
    s = X.long_scores(rows, ["row_id", "human_score", "channel"], metrics).withColumn("score", F.round("score", 9))
    c = s.groupBy("metric", "channel").agg(F.count("*").alias("len"), pearson("score", "human_score").alias("r"))
    r = F.nullif(F.col("r"), F.lit(float("nan")))
    return c.groupBy("metric").agg(F.round(F.avg(r), 5).alias("mean"), F.round(F.sum(F.coalesce(r * F.col("len"), F.lit(0.0))) / F.sum("len"), 5).alias("weighted"))


@over_all
@R.add(f"""WITH {_SYN_SQL} SELECT metric, {", ".join(f"ROUND(AVG(score) FILTER (quality = -{k}), 6) AS l{k}" for k in range(6))} FROM s_in GROUP BY metric""")
def d12_level_means(spark, d, metrics=KEYS):
    """Mean score per metric and damage level, levels as columns."""
    s = X.long_scores(_made(spark, d, keys=metrics), ["damage_id", "damage_level"], metrics).withColumn("score", F.round("score", 9))
    p = s.groupBy("metric").pivot("damage_level", list(range(6))).agg(F.round(F.avg("score"), 6))
    return p.select("metric", *[F.col(str(k)).alias(f"l{k}") for k in range(6)])


@over_all
@R.add(f"""WITH {_SYN_SQL}, m AS (SELECT metric, quality, ROUND(AVG(score), 9) AS v FROM s_in GROUP BY ALL), s AS (SELECT metric, -quality AS l, v, LAG(v) OVER (PARTITION BY metric ORDER BY -quality) AS before FROM m)
SELECT metric, COUNT(*) FILTER (v > before) AS increase_steps, ROUND(MAX(v) FILTER (l = 0) - MAX(v) FILTER (l = 5), 6) AS drop_0_to_5 FROM s GROUP BY metric""")
def f6_level_diagnostics(spark, d, metrics=KEYS):
    """Steps at which the mean score rises with damage, and the fall from level 0 to 5 (six rows a metric)."""
    s = X.long_scores(_made(spark, d, keys=metrics), ["damage_id", "damage_level"], metrics).withColumn("score", F.round("score", 9))
    m = s.groupBy("metric", "damage_level").agg(F.round(F.avg("score"), 9).alias("v"))
    b = m.withColumn("before", F.lag("v").over(Window.partitionBy("metric").orderBy("damage_level")))
    at = lambda k: F.max(F.when(F.col("damage_level") == k, F.col("v")))
    return b.groupBy("metric").agg(F.count_if(F.col("v") > F.col("before")).alias("increase_steps"), F.round(at(0) - at(5), 6).alias("drop_0_to_5"))


_PAIR_SQL = f"""WITH {Q.scores(_MADE, 'damage_id', 's_')}, x AS (SELECT w.damage_id, d.id, d.prompt_type, d.damage_level, ROUND(w.rouge_1, 9) AS score FROM s_wide w JOIN damage_row d USING (damage_id)),
c AS (SELECT id, prompt_type, AVG(score) AS clean_score FROM x WHERE damage_level = 0 GROUP BY ALL),
p AS (SELECT x.*, c.clean_score FROM x JOIN c ON x.id = c.id AND x.prompt_type = c.prompt_type WHERE x.damage_level > 0)"""


def _pairs(spark, d) -> DataFrame:
    rows = _made(spark, d, "id", "prompt_type", keys=("rouge_1",)).withColumn("score", F.round("rouge_1", 9))
    return M.self_level_pairs(rows.select("damage_id", "id", "prompt_type", "damage_level", "score"), ["id", "prompt_type"], "damage_level", "score")


@R.add(_PAIR_SQL + " SELECT prompt_type, COUNT(*) AS comparisons, COUNT(*) FILTER (score > clean_score + 1e-9) AS failures, ROUND(COUNT(*) FILTER (score > clean_score + 1e-9) / COUNT(*), 6) AS failure_rate FROM p GROUP BY prompt_type")
def d13_failure_rate(spark, d):
    """How often a damaged text scores above its clean one."""
    worse = F.col("score") > F.col("clean_score") + 1e-9
    return _pairs(spark, d).groupBy("prompt_type").agg(F.count("*").alias("comparisons"), F.count_if(worse).alias("failures"), F.round(F.count_if(worse) / F.count("*"), 6).alias("failure_rate"))


@R.add(_PAIR_SQL + " SELECT damage_id, ROUND(score - clean_score, 6) AS gap FROM p ORDER BY ROUND(score - clean_score, 6) DESC, damage_id LIMIT 3")
def f2_worst_failures(spark, d):
    """The three damaged texts that gain most over their clean ones."""
    return _pairs(spark, d).select("damage_id", F.round(F.col("score") - F.col("clean_score"), 6).alias("gap")).orderBy(F.desc("gap"), "damage_id").limit(3)


@R.add(f"""WITH {Q.scores(_MADE, 'damage_id', 's_')}, x AS (SELECT d.id, d.prompt_type, d.damage_level, ROUND(w.rouge_1, 9) AS score FROM s_wide w JOIN damage_row d USING (damage_id)),
r AS (SELECT *, RANK() OVER (PARTITION BY id, prompt_type ORDER BY score) + (COUNT(*) OVER (PARTITION BY id, prompt_type, score) - 1) / 2.0 AS rx,
  RANK() OVER (PARTITION BY id, prompt_type ORDER BY damage_level) + (COUNT(*) OVER (PARTITION BY id, prompt_type, damage_level) - 1) / 2.0 AS ry FROM x),
g AS (SELECT id, prompt_type, COUNT(*) AS n, {Q.pearson("rx", "ry")} AS rho FROM r GROUP BY id, prompt_type HAVING COUNT(*) >= 2)
SELECT id, prompt_type, n, ROUND(CASE WHEN isnan(rho) THEN 1.0 ELSE rho END, 6) AS spearman FROM g ORDER BY ROUND(CASE WHEN isnan(rho) THEN 1.0 ELSE rho END, 6) DESC, id, prompt_type LIMIT 5""")
def f3_worst_groups(spark, d):
    """The groups whose score goes most with damage; a constant group counts as worst (1)."""
    rows = _made(spark, d, "id", "prompt_type", keys=("rouge_1",)).select("id", "prompt_type", "damage_level", F.round("rouge_1", 9).alias("score"))
    c = correlations(rows, ["id", "prompt_type"], "score", "damage_level", kendall=False).where("n >= 2")
    return c.select("id", "prompt_type", "n", F.round(F.nanvl("spearman", F.lit(1.0)), 6).alias("spearman")).orderBy(F.desc("spearman"), "id", "prompt_type").limit(5)


@R.add(r"""WITH w AS (SELECT damage_level, len(string_split(trim(regexp_replace(prediction_vi, '\s+', ' ', 'g')), ' ')) AS p, CASE WHEN trim(coalesce(reference_vi, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(reference_vi, '\s+', ' ', 'g')), ' ')) END AS r
  FROM damage_row WHERE damage_level IS NOT NULL AND trim(coalesce(prediction_vi, '')) <> '' AND coalesce(status, 'ok') = 'ok'), m AS (SELECT damage_level, COUNT(*) AS n, AVG(p / r::DOUBLE) AS ratio FROM w WHERE r > 0 GROUP BY damage_level)
SELECT damage_level, n, ROUND(ratio, 6) AS ratio, CASE WHEN ratio < 0.95 THEN 'shorter' WHEN ratio > 1.05 THEN 'longer' ELSE 'same' END AS label FROM m""")
def d15_length_ratio(spark, d):
    """Mean ratio of predicted to reference words per level, labelled with a band of 95 to 105 %."""
    rows = table(spark, d, "damage_row", "damage_level", "prediction_vi", "reference_vi", "status")
    rows = rows.where("damage_level IS NOT NULL AND trim(coalesce(prediction_vi, '')) <> '' AND coalesce(status, 'ok') = 'ok'")
    n = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")))
    m = rows.select("damage_level", n("prediction_vi").alias("p"), n("reference_vi").alias("r")).where("r > 0").groupBy("damage_level").agg(F.count("*").alias("n"), F.avg(F.col("p") / F.col("r")).alias("ratio"))
    label = F.when(F.col("ratio") < 0.95, "shorter").when(F.col("ratio") > 1.05, "longer").otherwise("same")
    return m.select("damage_level", "n", F.round("ratio", 6).alias("ratio"), label.alias("label"))


@R.add(f"""WITH {Q.scores(_MADE, 'damage_id')}, x AS (SELECT d.prompt_type, d.model_name, ROUND(w.rouge_1, 9) AS score FROM wide w JOIN damage_row d USING (damage_id))
SELECT prompt_type, COUNT(*) AS n_models, ROUND(AVG(m), 6) AS mean, ROUND(coalesce(stddev_samp(m), 0), 6) AS spread FROM (SELECT prompt_type, model_name, AVG(score) AS m FROM x GROUP BY ALL) GROUP BY prompt_type""")
def d25_prompt_robustness(spark, d):
    """Mean and sample spread of the models' mean scores per prompt (0 for one model)."""
    m = _made(spark, d, "prompt_type", "model_name", keys=("rouge_1",)).groupBy("prompt_type", "model_name").agg(F.avg(F.round("rouge_1", 9)).alias("m"))
    return m.groupBy("prompt_type").agg(F.count("*").alias("n_models"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("spread"))


def _made_long(spark, d, *keep: str) -> DataFrame:
    rows = _made(spark, d, *keep, keys=X.KEYS)
    return X.long_scores(rows, list(dict.fromkeys(("damage_id", "damage_level", *keep))), X.KEYS).withColumn("score", F.round("score", 9))


def _pairs_all(spark, d) -> DataFrame:
    return M.self_level_pairs(_made_long(spark, d, "id", "prompt_type"), ["metric", "id", "prompt_type"], "damage_level", "score")


def _first(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each metric; Spark keeps no more than k a metric in each task before it shuffles."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy("metric").orderBy(*order))).where(F.col("_place") <= k).drop("_place")


@R.add()
def d13_failure_rate_all(spark, d):
    """How often a damaged text scores above its clean one, by each metric."""
    worse = F.col("score") > F.col("clean_score") + 1e-9
    return _pairs_all(spark, d).groupBy("metric", "prompt_type").agg(F.count("*").alias("comparisons"), F.count_if(worse).alias("failures"), F.round(F.count_if(worse) / F.count("*"), 6).alias("failure_rate"))


@R.add()
def f2_worst_failures_all(spark, d):
    """The three damaged texts that gain most over their clean ones, by each metric."""
    gaps = _pairs_all(spark, d).select("metric", "damage_id", F.round(F.col("score") - F.col("clean_score"), 6).alias("gap"))
    return _first(gaps, 3, F.desc("gap"), "damage_id")


@R.add()
def f3_worst_groups_all(spark, d):
    """The groups whose score goes most with damage, by each metric; a constant group counts as worst (1)."""
    rows = _made_long(spark, d, "id", "prompt_type").select("metric", "id", "prompt_type", "damage_level", "score")
    c = correlations(rows, ["metric", "id", "prompt_type"], "score", "damage_level", kendall=False).where("n >= 2")
    return _first(c.select("metric", "id", "prompt_type", "n", F.round(F.nanvl("spearman", F.lit(1.0)), 6).alias("spearman")), 5, F.desc("spearman"), "id", "prompt_type")


@R.add()
def d25_prompt_robustness_all(spark, d):
    """Mean and sample spread of the models' mean scores per prompt and metric (0 for one model)."""
    m = _made_long(spark, d, "prompt_type", "model_name").groupBy("metric", "prompt_type", "model_name").agg(F.avg("score").alias("m"))
    return m.groupBy("metric", "prompt_type").agg(F.count("*").alias("n_models"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("spread"))
