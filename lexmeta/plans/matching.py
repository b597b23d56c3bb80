"""Queries of joins, set comparisons, dedupe and audits (C, D16-D23, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmeta.operators import matching as M
from lexmeta.operators import selection as S
from lexmeta.plans.registry import Registry
from lexmeta.sources.tables import table

R = Registry()
queries, ORACLES = R.queries, R.oracles

# Talk about the task at the start of an answer.
_META = r"(?i)^\s*(?:(?:level|damage_level)\s*[:=]|(?:here is|bản viết lại|rewritten summary)(?:[^\p{L}\p{N}_]|$)|đây là bản (?:viết lại|tóm tắt)(?:[^\p{L}\p{N}_]|$))"


@R.add("""WITH a AS (SELECT id, COUNT(*) AS n_left FROM benchmark_row WHERE id IS NOT NULL GROUP BY id), b AS (SELECT id, COUNT(*) AS n_right FROM damage_row WHERE id IS NOT NULL GROUP BY id)
SELECT COUNT(*) FILTER (n_left IS NOT NULL AND n_right IS NOT NULL) AS matched, COUNT(*) FILTER (n_right IS NULL) AS left_only, COUNT(*) FILTER (n_left IS NULL) AS right_only,
  COUNT(*) FILTER (n_left > 1) AS left_repeated, COUNT(*) FILTER (n_right > 1) AS right_repeated FROM a FULL JOIN b USING (id)""")
def c1_outer_merge_audit(spark, d):
    """Full outer merge of benchmark and damage sentences with a one-to-one check."""
    return M.one_to_one_audit(table(spark, d, "benchmark_row", "id"), table(spark, d, "damage_row", "id"), "id")


@R.add("""WITH h AS (SELECT id, arg_min(source_zh, row_id) AS zh, arg_min(reference_vi, row_id) AS vi FROM benchmark_row GROUP BY id)
SELECT COUNT(*) AS n, COUNT(*) FILTER (d.source_zh IS DISTINCT FROM h.zh) AS other_source, COUNT(*) FILTER (d.reference_vi IS DISTINCT FROM h.vi) AS other_reference FROM damage_row d JOIN h USING (id)""")
def c3_text_equality(spark, d):
    """Whether the damaged rows' texts are those of the first benchmark row of their sentence."""
    first = table(spark, d, "benchmark_row", "row_id", "id", "source_zh", "reference_vi").groupBy("id").agg(F.min_by("source_zh", "row_id").alias("zh"), F.min_by("reference_vi", "row_id").alias("vi"))
    j = table(spark, d, "damage_row", "id", "source_zh", "reference_vi").join(first, "id")
    return j.agg(F.count("*").alias("n"), F.count_if(~F.col("source_zh").eqNullSafe(F.col("zh"))).alias("other_source"), F.count_if(~F.col("reference_vi").eqNullSafe(F.col("vi"))).alias("other_reference"))


@R.add("SELECT damage_id, d.id FROM damage_row d WHERE NOT EXISTS (SELECT 1 FROM benchmark_row b WHERE b.id = d.id)")
def c5_unmatched_ids(spark, d):
    """Damaged rows of sentences that the benchmark lacks."""
    return table(spark, d, "damage_row", "damage_id", "id").join(table(spark, d, "benchmark_row", "id"), "id", "left_anti").select("damage_id", "id")


@R.add("SELECT id FROM damage_row WHERE damage_level IS NOT NULL GROUP BY id HAVING COUNT(DISTINCT damage_level) = 6")
def c8_complete_ids(spark, d):
    """Sentences that have all six levels."""
    return M.complete_keys(table(spark, d, "damage_row", "id", "damage_level"), "id", "damage_level", 6)


@R.add("""SELECT damage_id FROM damage_row d WHERE NOT EXISTS (SELECT 1 FROM benchmark_row b
  WHERE b.source_zh IS NOT DISTINCT FROM d.source_zh AND b.reference_vi IS NOT DISTINCT FROM d.reference_vi AND b.id IS NOT DISTINCT FROM d.id)""")
def c12_expected_found(spark, d):
    """Damaged rows whose (source, reference, id) is no benchmark triplet, nulls being equal."""
    keys = ["source_zh", "reference_vi", "id"]
    return M.unmatched(table(spark, d, "damage_row", "damage_id", *keys), table(spark, d, "benchmark_row", *keys), keys).select("damage_id")


@R.add("""WITH a AS (SELECT DISTINCT id FROM benchmark_row), b AS (SELECT DISTINCT id FROM damage_row)
SELECT id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def c13_missing_extra(spark, d):
    """Sentences without damage, and damage without sentence."""
    return M.both_differences(table(spark, d, "benchmark_row", "id"), table(spark, d, "damage_row", "id"))


@R.add("""WITH g AS (SELECT DISTINCT id, prompt_type, backend, model_name, unnest(range(6))::INT AS damage_level FROM damage_row),
  k AS (SELECT *, concat_ws('|', id, prompt_type, damage_level::VARCHAR) AS run_key FROM g)
SELECT run_key, backend, model_name FROM k WHERE NOT EXISTS (SELECT 1 FROM damage_row o WHERE coalesce(o.status, 'ok') = 'ok' AND o.run_key = k.run_key
  AND o.backend IS NOT DISTINCT FROM k.backend AND o.model_name IS NOT DISTINCT FROM k.model_name)""")
def c14_resume_pending(spark, d):
    """Grid cells without a successful run by the same backend and model."""
    runs = table(spark, d, "damage_row", "id", "prompt_type", "run_key", "status", "backend", "model_name")
    grid = M.damage_grid(runs.select("id", "prompt_type", "backend", "model_name").distinct())
    keyed = grid.withColumn("run_key", M.run_key("id", "prompt_type", "damage_level"))
    return M.pending(keyed, runs, ["run_key", "backend", "model_name"]).select("run_key", "backend", "model_name")


@R.add("""WITH p AS (SELECT damage_id, source_zh, reference_vi, ROW_NUMBER() OVER (PARTITION BY source_zh, reference_vi ORDER BY damage_id) AS n FROM damage_row)
SELECT damage_id FROM p WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM benchmark_row b WHERE b.source_zh IS NOT DISTINCT FROM p.source_zh AND b.reference_vi IS NOT DISTINCT FROM p.reference_vi)""")
def c15_parallel_dedupe(spark, d):
    """Parallel pairs, first of each, that aren't among the human-scored ones."""
    keys = ["source_zh", "reference_vi"]
    first = M.first_wins(table(spark, d, "damage_row", "damage_id", *keys), keys, "damage_id")
    return M.unmatched(first, table(spark, d, "benchmark_row", *keys), keys).select("damage_id")


@R.add("""WITH r AS (SELECT id, arg_min(reference_vi, row_id) AS vi FROM benchmark_row GROUP BY id)
SELECT prompt_type, COUNT(*) AS n, COUNT(DISTINCT d.id) AS n_ids, COUNT(*) FILTER (r.id IS NULL) AS unknown_id, COUNT(*) FILTER (r.id IS NOT NULL AND d.reference_vi IS DISTINCT FROM r.vi) AS other_text
FROM damage_row d LEFT JOIN r USING (id) GROUP BY prompt_type""")
def c16_branch_audit(spark, d):
    """Per branch, whether ids and texts are those of the references."""
    refs = table(spark, d, "benchmark_row", "row_id", "id", "reference_vi").groupBy("id").agg(F.min_by("reference_vi", "row_id").alias("vi"), F.lit(1).alias("known"))
    j = table(spark, d, "damage_row", "id", "prompt_type", "reference_vi").join(refs, "id", "left")
    return j.groupBy("prompt_type").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("known").isNull()).alias("unknown_id"),
        F.count_if(F.col("known").isNotNull() & ~F.col("reference_vi").eqNullSafe(F.col("vi"))).alias("other_text"),
    )


@R.add("SELECT damage_level, COUNT(*) AS n, COUNT(DISTINCT id) AS n_ids FROM (SELECT id, unnest(range(6))::INT AS damage_level FROM benchmark_row) GROUP BY damage_level")
def c18_damage_grid(spark, d):
    """Rows by levels, as an explode rather than a cross join."""
    return M.damage_grid(table(spark, d, "benchmark_row", "id")).groupBy("damage_level").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def _first_wins(keys):
    sql = f"SELECT row_id FROM (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY row_id) AS n FROM benchmark_row) WHERE n = 1"

    def query(spark, d):
        return M.first_wins(table(spark, d, "benchmark_row", "row_id", *keys), keys, "row_id").select("row_id")

    query.__doc__ = f"The first row of each ({', '.join(keys)})."
    return query, sql


for _name, _keys in {"e1_unique_triplet": ["reference_vi", "source_zh", "channel"], "e2_unique_source": ["source_zh"], "e3_unique_reference": ["reference_vi"], "e4_unique_pair": ["source_zh", "reference_vi"]}.items():
    _q, _sql = _first_wins(_keys)
    _q.__name__ = _name
    R.add(_sql)(_q)


@R.add(r"""WITH x AS (SELECT cross_id, list_filter([upper(regexp_replace(primary_rater, '[\s\p{Z}]', '', 'g')), upper(regexp_replace(cross_rater, '[\s\p{Z}]', '', 'g'))], lambda v: v IS NOT NULL AND v <> '') AS l FROM human_cross)
SELECT cross_id, array_to_string(CASE WHEN len(l) = 2 AND l[1] = l[2] THEN [l[1]] ELSE l END, '|') AS raters FROM x""")
def e5_ordered_unique(spark, d):
    """Trimmed, non-empty, distinct codes in their order."""
    codes = F.array(*[F.upper(F.regexp_replace(c, r"[\s\p{Z}]", "")) for c in ("primary_rater", "cross_rater")])
    return table(spark, d, "human_cross", "cross_id", "primary_rater", "cross_rater").select("cross_id", F.array_join(F.array_distinct(F.filter(codes, lambda v: v.isNotNull() & (v != ""))), "|").alias("raters"))


@R.add("""SELECT dataset, COUNT(*) AS n, MIN(ordinal) AS lo, MAX(ordinal) AS hi FROM (SELECT 'human' AS dataset, row_id AS ordinal FROM benchmark_row UNION ALL
  SELECT coalesce(prompt_type, 'none'), damage_id FROM damage_row) GROUP BY dataset""")
def e6_concat(spark, d):
    """Bag union of the human and the damaged sets, each row with its set and place."""
    human = table(spark, d, "benchmark_row", "row_id").selectExpr("'human' AS dataset", "row_id AS ordinal")
    made = table(spark, d, "damage_row", "damage_id", "prompt_type").selectExpr("coalesce(prompt_type, 'none') AS dataset", "damage_id AS ordinal")
    return human.unionByName(made).groupBy("dataset").agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))


@R.add("""SELECT run_key, COUNT(*) AS n, COUNT(DISTINCT prediction_vi) AS n_texts, bool_or(coalesce(status, 'ok') = 'ok') AS succeeded FROM damage_row WHERE run_key IS NOT NULL
GROUP BY run_key HAVING COUNT(*) > 1""")
def e7_checkpoint_merge(spark, d):
    """Run keys met more than once: whether their texts agree, and whether one of them succeeded (which clears errors)."""
    runs = table(spark, d, "damage_row", "run_key", "prediction_vi", "status").where("run_key IS NOT NULL")
    return runs.groupBy("run_key").agg(F.count("*").alias("n"), F.count_distinct("prediction_vi").alias("n_texts"), F.bool_or(F.coalesce("status", F.lit("ok")) == "ok").alias("succeeded")).where("n > 1")


@R.add("SELECT COUNT(*) AS n, COUNT(DISTINCT (id, system_id)) AS n_keys, COUNT(*) - COUNT(DISTINCT (id, system_id)) AS repeated FROM benchmark_row")
def e8_duplicate_keys(spark, d):
    """Rows beyond one per sentence and system."""
    rows = table(spark, d, "benchmark_row", "id", "system_id")
    return rows.groupBy("id", "system_id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_keys"), (F.sum("c") - F.count("*")).alias("repeated"))


@R.add("SELECT prompt_type, COUNT(DISTINCT backend) AS n_backends, COUNT(DISTINCT model_name) AS n_models, COUNT(DISTINCT backend) <= 1 AND COUNT(DISTINCT model_name) <= 1 AS uniform FROM damage_row GROUP BY prompt_type")
def e9_mixing_guard(spark, d):
    """Whether a branch was made by one backend and one model."""
    b, m = F.count_distinct("backend"), F.count_distinct("model_name")
    return table(spark, d, "damage_row", "prompt_type", "backend", "model_name").groupBy("prompt_type").agg(b.alias("n_backends"), m.alias("n_models"), ((b <= 1) & (m <= 1)).alias("uniform"))


@R.add("""SELECT prompt_type, COUNT(*) AS n, COUNT(*) FILTER (status = 'error') AS errors, COUNT(*) FILTER (damage_level IS NULL) AS no_level,
  COUNT(*) FILTER (trim(coalesce(prediction_vi, '')) = '') AS blank, COUNT(*) FILTER (backend = 'remote_api') AS remote FROM damage_row GROUP BY prompt_type""")
def d16_damage_counts(spark, d):
    """Counts of an audit; a missing status is ok."""
    rows = table(spark, d, "damage_row", "prompt_type", "status", "damage_level", "prediction_vi", "backend")
    return rows.groupBy("prompt_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("damage_level").isNull()).alias("no_level"),
        F.count_if(F.trim(F.coalesce("prediction_vi", F.lit(""))) == "").alias("blank"), F.count_if(F.col("backend") == "remote_api").alias("remote"),
    )


@R.add("SELECT run_key, COUNT(*) AS n FROM damage_row WHERE run_key IS NOT NULL GROUP BY run_key HAVING COUNT(*) > 1")
def d17_duplicate_run_keys(spark, d):
    return table(spark, d, "damage_row", "run_key").where("run_key IS NOT NULL").groupBy("run_key").agg(F.count("*").alias("n")).where("n > 1")


@R.add("""WITH l AS (SELECT id, prompt_type, list_sort(list_distinct(list(damage_level) FILTER (damage_level IS NOT NULL))) AS present, COUNT(damage_level) AS n FROM damage_row GROUP BY id, prompt_type)
SELECT id, prompt_type, array_to_string(list_filter([0, 1, 2, 3, 4, 5], lambda x: NOT coalesce(list_contains(present, x), false)), ',') AS missing, n > coalesce(len(present), 0) AS repeated FROM l
WHERE coalesce(len(present), 0) < 6 OR n > len(present)""")
def d18_missing_levels(spark, d):
    """Levels that a sentence lacks or has twice; level sets have at most six members."""
    g = table(spark, d, "damage_row", "id", "prompt_type", "damage_level").groupBy("id", "prompt_type").agg(F.collect_set("damage_level").alias("present"), F.count("damage_level").alias("n"))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(5)), F.col("present"))
    out = g.select("id", "prompt_type", F.array_join(missing.cast("array<string>"), ",").alias("missing"), (F.col("n") > F.size("present")).alias("repeated"), F.size("present").alias("k"))
    return out.where("k < 6 OR repeated").drop("k")


@R.add(r"SELECT damage_id FROM damage_row WHERE regexp_matches(prediction_vi, '" + _META + "')")
def d19_meta_text(spark, d):
    """Predictions with labels or talk about the task left in the text."""
    return table(spark, d, "damage_row", "damage_id", "prediction_vi").where(F.col("prediction_vi").rlike(_META)).select("damage_id")


_B = "CASE WHEN {c} < 50 THEN 1 WHEN {c} < 70 THEN 2 WHEN {c} < 85 THEN 3 ELSE 4 END"


@R.add(f"""SELECT p, SUM((c = 1)::INT)::BIGINT AS c1, SUM((c = 2)::INT)::BIGINT AS c2, SUM((c = 3)::INT)::BIGINT AS c3, SUM((c = 4)::INT)::BIGINT AS c4, ROUND(AVG((p = c)::INT), 6) AS exact, ROUND(AVG(abs(p - c)), 6) AS mae
FROM (SELECT {_B.format(c="primary_score")} AS p, {_B.format(c="cross_score")} AS c FROM human_cross WHERE primary_score BETWEEN 0 AND 100 AND cross_score BETWEEN 0 AND 100) GROUP BY p""")
def d20_confusion(spark, d):
    """Primary against cross grade: confusion counts, exact agreement and mean distance by primary grade."""
    rows = table(spark, d, "human_cross", "primary_score", "cross_score").where("primary_score BETWEEN 0 AND 100 AND cross_score BETWEEN 0 AND 100")
    g = rows.selectExpr(f"{_B.format(c='primary_score')} AS p", f"{_B.format(c='cross_score')} AS c")
    cells = [F.count_if(F.col("c") == k).alias(f"c{k}") for k in (1, 2, 3, 4)]
    return g.groupBy("p").agg(*cells, F.round(F.avg((F.col("p") == F.col("c")).cast("int")), 6).alias("exact"), F.round(F.avg(F.abs(F.col("p") - F.col("c"))), 6).alias("mae"))


@R.add("""SELECT system_id, COUNT(*) AS n, COUNT(human_score) AS scored, COUNT(*) FILTER (off AND len(quality_flags) > 0) AS off_flagged, COUNT(*) FILTER (off AND len(quality_flags) = 0) AS off_unflagged FROM (
  SELECT *, coalesce(abs(human_score - (metadata.primary_score + metadata.cross_score) / 2) > 0.5, false) AS off FROM benchmark_row) GROUP BY system_id""")
def d21_score_arithmetic(spark, d):
    """Final scores that aren't the mean of primary and cross score, by flag."""
    rows = table(spark, d, "benchmark_row", "system_id", "human_score", "quality_flags", "metadata")
    off = F.coalesce(F.abs(F.col("human_score") - (F.col("metadata.primary_score") + F.col("metadata.cross_score")) / 2) > 0.5, F.lit(False))
    return rows.groupBy("system_id").agg(
        F.count("*").alias("n"), F.count("human_score").alias("scored"), F.count_if(off & (F.size("quality_flags") > 0)).alias("off_flagged"), F.count_if(off & (F.size("quality_flags") == 0)).alias("off_unflagged")
    )


@R.add("SELECT flag, COUNT(*) AS n FROM (SELECT unnest(list_distinct(quality_flags)) AS flag FROM benchmark_row) GROUP BY flag")
def d22_flag_histogram(spark, d):
    return table(spark, d, "benchmark_row", "quality_flags").select(F.explode(F.array_distinct("quality_flags")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@R.add(r"""SELECT rater, COUNT(*) AS n FROM (SELECT upper(regexp_replace(unnest([primary_rater, cross_rater]), '[\s\p{Z}]', '', 'g')) AS rater FROM human_cross)
  WHERE rater <> '' GROUP BY rater""")
def d23_raters(spark, d):
    """Raters by their trimmed, upper-case code."""
    both = table(spark, d, "human_cross", "primary_rater", "cross_rater").selectExpr("stack(2, primary_rater, cross_rater) AS code")
    return both.select(F.upper(F.regexp_replace("code", r"[\s\p{Z}]", "")).alias("rater")).where("rater <> ''").groupBy("rater").agg(F.count("*").alias("n"))
