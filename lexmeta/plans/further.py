"""Further queries: cache checks, lookups, metric grids, ranks and small text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmeta.functions import metrics as X
from lexmeta.functions import text as T
from lexmeta.functions.correlation import small_correlation
from lexmeta.operators import selection as S
from lexmeta.plans import metric_sql as Q
from lexmeta.plans import metrics as P
from lexmeta.plans.registry import Registry
from lexmeta.session import scratch_path
from lexmeta.sources import files
from lexmeta.sources.tables import table

R = Registry()
queries, ORACLES = R.queries, R.oracles


@R.add("""WITH p AS (SELECT id, COUNT(damage_level) AS n, COUNT(DISTINCT damage_level) AS k, MIN(damage_level) AS lo, MAX(damage_level) AS hi FROM damage_row GROUP BY id)
SELECT COUNT(*) AS n_keys, COUNT(*) FILTER (k <> 6 OR lo <> 0 OR hi <> 5) AS odd_keys, COUNT(*) FILTER (n > k) AS repeated_keys FROM p""")
def a17_level_cache(spark, d):
    """Constraints of a cached branch: each sentence has the levels 0 to 5 once."""
    return files.level_cache_checks(table(spark, d, "damage_row", "id", "damage_level"))


@R.add("""SELECT row_id, metric, score FROM (SELECT row_id, 'primary' AS metric, metadata.primary_score AS score FROM benchmark_row UNION ALL SELECT row_id, 'final', human_score FROM benchmark_row)
  WHERE score IS NOT NULL AND isfinite(score)""")
def a17_wide_to_long(spark, d):
    """Score columns as rows; what is not finite is left out (g23)."""
    rows = table(spark, d, "benchmark_row", "row_id", "metadata", "human_score").selectExpr("row_id", "metadata.primary_score AS metric__primary", "human_score AS metric__final")
    return files.wide_to_long(rows, ["row_id"]).where(S.is_finite("score"))


_DAMAGE = [c.split(" ")[0] for c in files.DAMAGE_ROW.split(", ")]


@R.add(f"SELECT {', '.join(_DAMAGE)} FROM damage_row")
def a2_jsonl_round_trip(spark, d):
    """Rows written as JSON lines and read again under the declared schema (a1, a3, a14)."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(table(spark, d, "damage_row", *_DAMAGE), path)
    return files.read_jsonl(spark, path, files.DAMAGE_ROW)


@R.add("SELECT damage_id, damage_level, coalesce(prediction_vi, '') AS prediction_vi FROM damage_row")
def a18_csv_round_trip(spark, d):
    """Rows written as CSV with byte-order marks and read again; a null text comes back as an empty one."""
    path = scratch_path(spark, "csv")
    files.write_csv_bom(table(spark, d, "damage_row", "damage_id", "damage_level", "prediction_vi"), path)
    rows = files.read_csv(spark, path, "damage_id BIGINT, damage_level INT, prediction_vi STRING")
    return rows.withColumn("prediction_vi", F.coalesce("prediction_vi", F.lit("")))


@R.add("SELECT batch, COUNT(*) AS n, MIN(damage_id) AS first_id FROM (SELECT damage_id, (ROW_NUMBER() OVER (ORDER BY damage_id) - 1) // 64 AS batch FROM damage_row) GROUP BY batch")
def f12_batches(spark, d):
    """Rows in batches of 64, in the order of their keys."""
    rows = S.with_ordinal(table(spark, d, "damage_row", "damage_id"), ["damage_id"], "ordinal")
    return rows.groupBy(F.expr("ordinal div 64").alias("batch")).agg(F.count("*").alias("n"), F.min("damage_id").alias("first_id"))


@R.add(f"""WITH {Q.scores("SELECT damage_id, reference_vi, prediction_vi FROM damage_row WHERE coalesce(status, 'ok') = 'ok' AND trim(coalesce(prediction_vi, '')) <> ''", 'damage_id', 'u_')}, {Q.long('u_', 'damage_id')},
t AS (SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (coalesce(status, 'ok') = 'ok' AND trim(coalesce(prediction_vi, '')) <> '') AS n_usable FROM damage_row)
SELECT metric, n_rows, n_usable, COUNT(*) AS n_scored, COUNT(*) FILTER (NOT isfinite(score)) AS n_errors, COUNT(*) = n_usable AS complete, ROUND(AVG(score), 6) AS mean FROM u_long, t GROUP BY metric, n_rows, n_usable""")
def h9_run_status(spark, d):
    """A run of the metric grid: per metric the rows it was given, those it scored and those it failed on, and whether the
    vector has the length it should."""
    rows = table(spark, d, "damage_row", "damage_id", "reference_vi", "prediction_vi", "status")
    marked = rows.withColumn("usable", F.expr("coalesce(status, 'ok') = 'ok' AND trim(coalesce(prediction_vi, '')) <> ''"))
    scores = X.long_scores(X.add_metrics(marked, keys=P.KEYS), ["damage_id", "usable"], P.KEYS).withColumn("score", F.when(F.col("usable"), F.col("score")))
    finite = S.is_finite("score")
    each = scores.groupBy("metric").agg(
        F.count("*").alias("n_rows"), F.count_if("usable").alias("n_usable"), F.count("score").alias("n_scored"), F.count_if(F.col("score").isNotNull() & ~finite).alias("n_errors"), F.round(F.avg("score"), 6).alias("mean")
    )
    return each.withColumn("complete", F.col("n_scored") == F.col("n_usable"))


@R.add("""WITH m AS (SELECT id, MIN(metadata.stt) AS stt FROM benchmark_row GROUP BY id)
SELECT COUNT(*) AS n, COUNT(DISTINCT m.id) AS n_ids, COUNT(*) FILTER (right(d.id, 4)::INT <> m.stt) AS other_stt FROM damage_row d JOIN m USING (id)""")
def c2_lookup(spark, d):
    """Lookup of sentence numbers by id, and whether they agree with the ids."""
    m = table(spark, d, "benchmark_row", "id", "metadata").groupBy("id").agg(F.min("metadata.stt").alias("stt"))
    j = table(spark, d, "damage_row", "id").join(m, "id")
    return j.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.right("id", F.lit(4)).cast("int") != F.col("stt")).alias("other_stt"))


@R.add("SELECT x.cross_id, m.stt FROM human_cross x JOIN (SELECT id, system_id, MIN(metadata.stt) AS stt FROM benchmark_row GROUP BY ALL) m ON x.id = m.id AND x.system_id = m.system_id")
def c4_remap(spark, d):
    """Ratings under the sentence number of their item."""
    m = table(spark, d, "benchmark_row", "id", "system_id", "metadata").groupBy("id", "system_id").agg(F.min("metadata.stt").alias("stt"))
    return table(spark, d, "human_cross", "cross_id", "id", "system_id").join(m, ["id", "system_id"]).select("cross_id", "stt")


@R.add(f"""WITH {Q.scores(P._HUMAN, 'row_id')}, o AS (SELECT ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS ordinal, bleu_1, rouge_1 FROM wide)
SELECT ordinal, ROUND(bleu_1, 6) AS bleu_1, ROUND(rouge_1, 6) AS rouge_1 FROM o""")
def c6_align_by_position(spark, d):
    """Two score vectors, each by position, side by side again."""
    rows = S.with_ordinal(table(spark, d, "benchmark_row", "row_id", "reference_vi", "prediction_vi"), ["row_id"])
    a = X.add_metrics(rows, keys=("bleu_1",)).select("ordinal", F.round("bleu_1", 6).alias("bleu_1"))
    b = X.add_metrics(rows, keys=("rouge_1",)).select("ordinal", F.round("rouge_1", 6).alias("rouge_1"))
    return a.join(b, "ordinal")


@R.add("""SELECT f.family, COUNT(*) AS cells FROM benchmark_row, (SELECT unnest(['bleu', 'bleu', 'bleu', 'bleu', 'chrf', 'chrf', 'chrf', 'chrf', 'rouge', 'rouge', 'rouge', 'rouge', 'meteor', 'meteor', 'meteor', 'meteor']) AS family) f
WHERE prediction_vi IS NOT NULL GROUP BY f.family""")
def c19_grid_by_family(spark, d):
    """Cells of the rows by light configurations grid, per family: an explode of the catalogue (b16, b20, h10)."""
    rows = table(spark, d, "benchmark_row", "prediction_vi").where("prediction_vi IS NOT NULL")
    family = F.explode(F.array(*[F.lit(k.split("_")[0]) for k in X.KEYS])).alias("family")
    return rows.select(family).groupBy("family").agg(F.count("*").alias("cells"))


@R.add()
def d8_meta_with_p(spark, d):
    """Meta-correlation with the sign on the synthetic side: all three coefficients with their one-sided p-values, over
    all computed metrics; those that are NaN on either side are left out per coefficient."""
    from lexmeta.plans.metrics import _hum, _syn

    h, s = _hum(spark, d, "metric", metrics=X.KEYS), _syn(spark, d, X.KEYS)
    kinds = ("pearson", "spearman", "kendall")
    both = h.select("metric", *[F.round(c, 9).alias(f"h_{c}") for c in kinds]).join(s.select("metric", *[F.round(c, 9).alias(f"s_{c}") for c in kinds]), "metric")
    finite = [F.collect_list(F.when(~F.isnan(f"h_{c}") & ~F.isnan(f"s_{c}"), F.struct(F.col(f"h_{c}").alias("x"), F.col(f"s_{c}").alias("y")))).alias(c) for c in kinds]
    row = both.agg(F.count("*").alias("n"), *finite)  # one row; a pair for each metric
    for c in kinds:
        tested = F.udf(lambda pairs, c=c: small_correlation(c, [p.x for p in pairs], [p.y for p in pairs]), "r DOUBLE, p DOUBLE")
        row = row.withColumn(f"t_{c}", tested(c))
    status = F.when(F.least(*[F.size(c) for c in kinds]) < 2, "partial").otherwise("ready")
    shown = [F.round(f"t_{c}.{v}", 6).alias(f"meta_{c}" + ("_pvalue" if v == "p" else "")) for c in kinds for v in "rp"]
    return row.select(F.col("n").alias("common_metrics"), *shown, status.alias("status"))


@P.over_all
@R.add(f"""WITH {P._SYN_SQL}, {Q.correlations('s_in', ['metric'], 'score', 'quality', 's_')} SELECT metric, RANK() OVER (ORDER BY ROUND(spearman, 6) DESC) AS place FROM s_corr""")
def f4_rank_metrics(spark, d, metrics=P.KEYS):
    """Metrics by how well they follow damage (one row a metric)."""
    from lexmeta.plans.metrics import _syn

    c = _syn(spark, d, metrics).select("metric", F.round("spearman", 6).alias("s"))
    return c.select("metric", F.rank().over(Window.orderBy(F.desc("s"))).alias("place"))


@R.add("SELECT id, ROW_NUMBER() OVER (ORDER BY MIN(damage_id)) - 1 AS appearance FROM damage_row GROUP BY id")
def f11_first_appearance(spark, d):
    """Sentences in order of first appearance."""
    first = table(spark, d, "damage_row", "id", "damage_id").groupBy("id").agg(F.min("damage_id").alias("first"))
    return S.with_ordinal(first, ["first"], "appearance").select("id", "appearance")


@R.add("SELECT CASE WHEN starts_with(source, 'tin-') THEN 'news' WHEN starts_with(source, 'bao-') THEN 'paper' WHEN source IS NULL THEN 'none' ELSE 'other' END AS kind, COUNT(*) AS n FROM documents GROUP BY ALL")
def f13_label_prefix(spark, d):
    """Sources grouped by the prefix of their name."""
    s = F.col("source")
    kind = F.when(s.startswith("tin-"), "news").when(s.startswith("bao-"), "paper").when(s.isNull(), "none").otherwise("other")
    return table(spark, d, "documents", "source").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@R.add(r"""SELECT word, COUNT(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(lower(reference_vi), '[\s\p{Z}]+', ' ', 'g')), ' ')) AS word FROM benchmark_row) WHERE word <> '' GROUP BY word""")
def g4_syllable_counts(spark, d):
    """Syllables, split at blanks, and their counts."""
    words = table(spark, d, "benchmark_row", "reference_vi").select(F.explode(T.words(F.regexp_replace(F.lower("reference_vi"), r"[\s\p{Z}]+", " "))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@R.add("""SELECT split_part(id, '-', 1) || '-' || split_part(id, '-', 2) AS pair, split_part(id, '-', 3)::INT AS year, split_part(id, '-', 4) AS part, COUNT(*) AS n FROM damage_row GROUP BY ALL""")
def g13_key_parts(spark, d):
    """Ids taken apart by place (g10)."""
    parts = F.split("id", "-")
    cols = [F.array_join(F.slice(parts, 1, 2), "-").alias("pair"), F.get(parts, F.lit(2)).cast("int").alias("year"), F.get(parts, F.lit(3)).alias("part")]
    return table(spark, d, "damage_row", "id").groupBy(*cols).agg(F.count("*").alias("n"))


@R.add("SELECT row_id FROM benchmark_row WHERE regexp_matches(prediction_vi, '[一-鿿]')")
def g17_has_han(spark, d):
    """Predictions with Han letters."""
    return table(spark, d, "benchmark_row", "row_id", "prediction_vi").where(F.col("prediction_vi").rlike("[一-鿿]")).select("row_id")


@R.add(r"SELECT model_name, regexp_replace(regexp_replace(model_name, '^gen-', ''), '-([a-z])$', ' \1') AS label, COUNT(*) AS n FROM damage_row GROUP BY ALL")
def g25_short_label(spark, d):
    """Model names by a chain of rewrites."""
    label = F.regexp_replace(F.regexp_replace("model_name", "^gen-", ""), "-([a-z])$", " $1")
    return table(spark, d, "damage_row", "model_name").groupBy("model_name", label.alias("label")).agg(F.count("*").alias("n"))
