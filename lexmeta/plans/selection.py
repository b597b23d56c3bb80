"""Queries of scans, projections, filters, sampling and splits (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmeta.operators import selection as S
from lexmeta.plans.registry import Registry
from lexmeta.sources.tables import table

R = Registry()
queries, ORACLES = R.queries, R.oracles
ID_FIELDS = ("row_id", "id", "system_id")


@R.add("""SELECT row_id, role, rater, score FROM (SELECT row_id, 'primary' AS role, metadata.primary_rater AS rater, metadata.primary_score AS score FROM benchmark_row
  UNION ALL SELECT row_id, 'cross', metadata.cross_rater, metadata.cross_score FROM benchmark_row)""")
def a4_unpivot_raters(spark, d):
    """Wide rater columns to one row per role."""
    m = table(spark, d, "benchmark_row", "row_id", "metadata")
    return m.selectExpr("row_id", "stack(2, 'primary', metadata.primary_rater, metadata.primary_score, 'cross', metadata.cross_rater, metadata.cross_score) AS (role, rater, score)")


@R.add(r"""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT metadata.stt) AS n_stt, MIN(metadata.stt) AS min_stt, MAX(metadata.stt) AS max_stt,
  COUNT(*) FILTER (metadata.stt IS NULL) AS no_stt, COUNT(*) FILTER (regexp_replace(coalesce(prediction_vi, ''), '[\s\p{Z}]', '', 'g') = '') AS blank_predictions,
  COUNT(DISTINCT id) AS n_ids FROM benchmark_row""")
def a5_translation_checks(spark, d):
    """Constraints of a translation table as one row of violation counts."""
    rows = table(spark, d, "benchmark_row", "id", "metadata", "prediction_vi")
    stt = F.col("metadata.stt")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct(stt).alias("n_stt"), F.min(stt).alias("min_stt"), F.max(stt).alias("max_stt"),
        F.count_if(stt.isNull()).alias("no_stt"), F.count_if(F.regexp_replace(F.coalesce("prediction_vi", F.lit("")), r"[\s\p{Z}]", "") == "").alias("blank_predictions"),
        F.count_distinct("id").alias("n_ids"),
    )


@R.add("""SELECT cross_id, kind, score FROM (SELECT cross_id, unnest(['primary', 'cross']) AS kind, unnest([primary_score, cross_score]) AS score FROM human_cross)
  WHERE score IS NOT NULL""")
def a6_explode_scores(spark, d):
    """A map of named scores, exploded to rows."""
    rows = table(spark, d, "human_cross", "cross_id", "primary_score", "cross_score")
    named = rows.select("cross_id", F.explode(F.create_map(F.lit("primary"), "primary_score", F.lit("cross"), "cross_score")).alias("kind", "score"))
    return named.where("score IS NOT NULL")


@R.add("SELECT row_id AS ordinal, source_zh AS input, reference_vi AS reference, prediction_vi AS prediction, system_id AS model_name, human_score AS processed_human_score FROM benchmark_row")
def a7_as_examples(spark, d):
    """Benchmark columns under the names of generic examples."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "reference_vi", "prediction_vi", "system_id", "human_score")
    return rows.toDF("ordinal", "input", "reference", "prediction", "model_name", "processed_human_score")


@R.add("SELECT row_id, (human_score >= 85)::INT AS is_top FROM benchmark_row WHERE human_score BETWEEN 0 AND 100")
def a8_binary_scores(spark, d):
    """A graded score as a binary one."""
    return table(spark, d, "benchmark_row", "row_id", "human_score").where("human_score BETWEEN 0 AND 100").selectExpr("row_id", "CAST(human_score >= 85 AS INT) AS is_top")


@R.add(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (p - 1)::INT AS pos, segment FROM (SELECT doc_id, unnest(lines) AS segment, generate_subscripts(lines, 1) AS p FROM l WHERE len(lines) > 1)""")
def a9_segments(spark, d):
    """Documents of several non-blank lines, one row per line."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t\r]")).alias("lines"))
    return lines.where(F.size("lines") > 1).select("doc_id", F.posexplode("lines").alias("pos", "segment"))


@R.add("""SELECT a.ordinal, a.doc_id, b.row_id FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) a
  JOIN (SELECT row_id, ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS ordinal FROM benchmark_row) b USING (ordinal)""")
def a10_positional_zip(spark, d):
    """Two tables side by side by position."""
    docs = S.with_ordinal(table(spark, d, "documents", "doc_id"), ["doc_id"])
    return docs.join(S.with_ordinal(table(spark, d, "benchmark_row", "row_id"), ["row_id"]), "ordinal").select("ordinal", "doc_id", "row_id")


@R.add("""SELECT prompt_type, COUNT(*) AS n FROM damage_row WHERE created_at >= TIMESTAMP '2022-01-01' AND created_at < TIMESTAMP '2023-01-01' AND prompt_type IN ('zero_shot', 'few_shot')
  AND source_zh IS NOT NULL AND reference_vi IS NOT NULL AND prediction_vi IS NOT NULL GROUP BY prompt_type""")
def a11_year_filter(spark, d):
    """A range of time and some kinds, rows with a null text left out."""
    rows = table(spark, d, "damage_row", "prompt_type", "created_at", "source_zh", "reference_vi", "prediction_vi")
    chosen = rows.where("created_at >= TIMESTAMP '2022-01-01' AND created_at < TIMESTAMP '2023-01-01'").where(F.col("prompt_type").isin("zero_shot", "few_shot"))
    return chosen.na.drop(subset=["source_zh", "reference_vi", "prediction_vi"]).groupBy("prompt_type").agg(F.count("*").alias("n"))


@R.add("""WITH s AS (SELECT * FROM benchmark_row WHERE human_score BETWEEN 0 AND 100 AND prediction_vi IS NOT NULL),
  b AS (SELECT id, arg_min(prediction_vi, (-human_score, row_id)) AS best, MAX(human_score) AS best_score, COUNT(*) AS n, COUNT(DISTINCT source_zh) AS n_sources FROM s GROUP BY id)
SELECT id, best, best_score, n, n_sources FROM b WHERE n > 1""")
def a12_best_of_group(spark, d):
    """The best-scored text of each group, and a check of what should be constant in it."""
    rows = table(spark, d, "benchmark_row", "row_id", "id", "source_zh", "prediction_vi", "human_score").where("human_score BETWEEN 0 AND 100 AND prediction_vi IS NOT NULL")
    best = F.min_by("prediction_vi", F.struct((-F.col("human_score")).alias("s"), "row_id"))
    return rows.groupBy("id").agg(
        best.alias("best"), F.max("human_score").alias("best_score"), F.count("*").alias("n"), F.count_distinct("source_zh").alias("n_sources")
    ).where("n > 1")


@R.add("SELECT event_type, SUM(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, COUNT(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS no_k FROM events GROUP BY event_type")
def a13_decode_json(spark, d):
    """JSON in a string column, decoded as a variant."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("no_k"))


@R.add("""WITH a AS (SELECT *, coalesce(len(list_filter(quality_flags, lambda f: f IN ('reference_alignment_issue', 'missing_text') OR starts_with(f, 'invalid_score_'))), 0) > 0 AS listed,
    coalesce(len(quality_flags), 0) > 0 OR human_score IS NULL AS any_flag FROM benchmark_row)
SELECT system_id, COUNT(*) AS n_rows, COUNT(*) FILTER (NOT listed) AS kept_by_list, COUNT(*) FILTER (NOT any_flag) AS kept_by_any FROM a GROUP BY system_id""")
def a19_export_summary(spark, d):
    """Rows kept for export, by both rules in use: listed flags, or any flag or missing score."""
    rows = table(spark, d, "benchmark_row", "system_id", "quality_flags", "human_score")
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    listed = F.exists(flags, lambda f: f.isin("reference_alignment_issue", "missing_text") | f.startswith("invalid_score_"))
    any_flag = (F.size(flags) > 0) | F.col("human_score").isNull()
    return rows.groupBy("system_id").agg(F.count("*").alias("n_rows"), F.count_if(~listed).alias("kept_by_list"), F.count_if(~any_flag).alias("kept_by_any"))


@R.add("""SELECT id, arg_min(prediction_vi, row_id) FILTER (system_id = 'A') AS prediction_a, arg_min(prediction_vi, row_id) FILTER (system_id = 'B') AS prediction_b,
  COUNT(DISTINCT reference_vi) AS n_references FROM benchmark_row GROUP BY id""")
def a20_pivot_systems(spark, d):
    """One row per sentence with both systems' first texts, and a check of the shared reference."""
    rows = table(spark, d, "benchmark_row", "row_id", "id", "system_id", "reference_vi", "prediction_vi").where("true")
    pick = lambda s: F.min_by("prediction_vi", F.when((F.col("system_id") == s) & F.col("prediction_vi").isNotNull(), F.col("row_id")))
    return rows.groupBy("id").agg(pick("A").alias("prediction_a"), pick("B").alias("prediction_b"), F.count_distinct("reference_vi").alias("n_references"))


@R.add("""WITH s AS (SELECT NOT list_contains(quality_flags, 'reference_alignment_issue') AS clean, human_score IS NOT NULL AND len(list_filter(quality_flags, lambda f: starts_with(f, 'invalid_score_'))) = 0 AS ok,
    metadata.cross_score IS NOT NULL AS crossed FROM benchmark_row)
SELECT COUNT(*) AS n_all, COUNT(*) FILTER (clean) AS n_clean, COUNT(*) FILTER (clean AND ok) AS n_scored, COUNT(*) FILTER (clean AND crossed) AS n_cross FROM s""")
def b10_split_counts(spark, d):
    """The splits of the benchmark: all, clean, scored, cross-scored, in one pass."""
    rows = table(spark, d, "benchmark_row", "quality_flags", "human_score", "metadata").withColumn("cross_score", F.col("metadata.cross_score"))
    s = S.split_flags(rows)
    return s.agg(F.count("*").alias("n_all"), F.count_if("is_clean").alias("n_clean"), F.count_if("is_scored").alias("n_scored"), F.count_if("is_cross").alias("n_cross"))


@R.add("(SELECT 'head' AS part, doc_id FROM documents ORDER BY doc_id LIMIT 5) UNION ALL (SELECT 'tail', doc_id FROM documents ORDER BY doc_id DESC LIMIT 5)")
def b1_head_tail(spark, d):
    """The first and last rows by key."""
    ids = table(spark, d, "documents", "doc_id")
    ends = (S.head(ids, ["doc_id"], 5).withColumn("part", F.lit("head")), S.tail(ids, ["doc_id"], 5).withColumn("part", F.lit("tail")))
    return ends[0].unionByName(ends[1]).select("part", "doc_id")


@R.add("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR)), doc_id LIMIT 100")
def b2_hash_sample(spark, d):
    """A sample without replacement that every engine draws alike."""
    return S.hash_sample(table(spark, d, "documents", "doc_id"), "doc_id", 100, 42)


@R.add("SELECT doc_id, lang FROM documents WHERE lang IN ('vi', 'zh') AND n_chars >= 100")
def b3_filter(spark, d):
    """A predicate and a projection, both pushed into the scan."""
    return table(spark, d, "documents", "doc_id", "lang", "n_chars").where("lang IN ('vi', 'zh') AND n_chars >= 100").select("doc_id", "lang")


@R.add("""WITH o AS (SELECT row_id, id, ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS ordinal FROM benchmark_row)
SELECT w.position::INT AS position, o.row_id FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) w(position, ordinal) JOIN o USING (ordinal)""")
def b5_gather(spark, d):
    """Rows at given positions, repeated as asked."""
    return S.gather(S.with_ordinal(table(spark, d, "benchmark_row", "row_id"), ["row_id"]), "ordinal", [7, 3, 7, 0]).select("position", "row_id")


@R.add("""WITH f AS (SELECT id, ROW_NUMBER() OVER (ORDER BY MIN(row_id)) AS sentence_no FROM benchmark_row GROUP BY id)
SELECT row_id, id, sentence_no FROM benchmark_row JOIN f USING (id) WHERE sentence_no BETWEEN 101 AND 200""")
def b7_sentence_range(spark, d):
    """All rows of the 101st to 200th sentence in order of first appearance."""
    return S.sentence_range(table(spark, d, "benchmark_row", "row_id", "id"), "id", "row_id", 101, 200).select("row_id", "id", "sentence_no")


@R.add("SELECT row_id, human_score FROM benchmark_row WHERE len(quality_flags) = 0 AND human_score IS NOT NULL AND isfinite(human_score)")
def b9_clean_rows(spark, d):
    """Rows without flags and with a finite score."""
    return S.clean_rows(table(spark, d, "benchmark_row", "row_id", "quality_flags", "human_score")).select("row_id", "human_score")


_WORDS = r"CASE WHEN trim(regexp_replace(coalesce(prediction_vi, ''), '[\s\p{Z}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(prediction_vi, '[\s\p{Z}]+', ' ', 'g')), ' ')) END"


@R.add(f"SELECT n_words <= 30 AS is_short, COUNT(*) AS n, SUM(n_words)::BIGINT AS words FROM (SELECT {_WORDS} AS n_words FROM benchmark_row) GROUP BY ALL")
def b11_word_mask(spark, d):
    """Rows by whether the prediction has at most 30 words."""
    n = S.word_count(F.regexp_replace("prediction_vi", r"[\s\p{Z}]+", " "))
    rows = table(spark, d, "benchmark_row", "prediction_vi").select(n.alias("n_words"))
    return rows.groupBy((F.col("n_words") <= 30).alias("is_short")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


@R.add("""SELECT damage_id, run_key FROM damage_row WHERE (run_key LIKE '%zero_shot%' OR run_key LIKE '%few_shot%') AND run_key LIKE '%test-05%'
  AND NOT (run_key LIKE '%|0' OR run_key LIKE '%|5')""")
def b12_run_filter(spark, d):
    """Runs with any of some words, all of others and none of the rest in their key."""
    k = F.col("run_key")
    rows = table(spark, d, "damage_row", "damage_id", "run_key")
    return rows.where((k.contains("zero_shot") | k.contains("few_shot")) & k.contains("test-05") & ~(k.endswith("|0") | k.endswith("|5")))


@R.add("SELECT lang, COUNT(*) AS n FROM documents WHERE length(text) <= 320 AND NOT coalesce(source LIKE '%backup%', false) GROUP BY lang")
def b15_length_filter(spark, d):
    """Texts within a prompt's length, backups skipped."""
    rows = table(spark, d, "documents", "lang", "text", "source").where(F.length("text") <= 320)
    return rows.where(~F.coalesce(F.col("source").contains("backup"), F.lit(False))).groupBy("lang").agg(F.count("*").alias("n"))


@R.add("""WITH r AS (SELECT damage_id, damage_level, ROW_NUMBER() OVER (PARTITION BY damage_level ORDER BY md5(concat_ws('|', '42', damage_id::VARCHAR)), damage_id) AS turn
  FROM damage_row WHERE damage_level IS NOT NULL) SELECT damage_id, damage_level, turn::INT AS turn FROM r ORDER BY turn, damage_level LIMIT 60""")
def b17_stratified_audit(spark, d):
    """A manual-audit sample, taken in turn from the damage levels."""
    rows = table(spark, d, "damage_row", "damage_id", "damage_level").where("damage_level IS NOT NULL")
    return S.stratified(rows, "damage_level", "damage_id", 60, 42).select("damage_id", "damage_level", "turn")


@R.add("""SELECT h.channel AS held_out, COUNT(*) AS n_train FROM (SELECT DISTINCT channel FROM benchmark_row WHERE channel IS NOT NULL) h,
  (SELECT channel, COUNT(*) AS n FROM benchmark_row GROUP BY channel) t, range(0, t.n) WHERE t.channel <> h.channel GROUP BY h.channel""")
def b18_leave_one_out(spark, d):
    """Training rows left when one channel is held out: total less own, no pairing of channels."""
    n = table(spark, d, "benchmark_row", "channel").where("channel IS NOT NULL").groupBy("channel").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(total, how="cross").select(F.col("channel").alias("held_out"), (F.col("total") - F.col("n")).alias("n_train"))
