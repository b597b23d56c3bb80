"""Queries of reports, windows, text functions, parsing, models and work planning (D26-D37, F, G, I, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmeta.functions import metrics as X
from lexmeta.functions import text as T
from lexmeta.operators import damage, matching, models, parsing, rewards, scheduling
from lexmeta.operators import selection as S
from lexmeta.plans import metric_sql as Q
from lexmeta.plans.registry import Registry
from lexmeta.sources.tables import table

R = Registry()
queries, ORACLES = R.queries, R.oracles


@R.add("""WITH o AS (SELECT damage_id, split_part(id, '-', 5) AS g, prediction_vi FROM damage_row), c AS (SELECT *, coalesce(g <> LAG(g) OVER (ORDER BY damage_id), true) AS new FROM o),
i AS (SELECT *, SUM(new::INT) OVER (ORDER BY damage_id) AS island FROM c), n AS (SELECT island, COUNT(*) - COUNT(DISTINCT prediction_vi) AS repeats FROM i GROUP BY island)
SELECT repeats, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS share FROM n GROUP BY repeats""")
def d26_duplicate_islands(spark, d):
    """Repeated predictions inside consecutive runs of a sentence, as a histogram. Runs are found from neighbours by position."""
    rows = S.with_ordinal(table(spark, d, "damage_row", "damage_id", "id", "prediction_vi"), ["damage_id"]).withColumn("g", F.split_part("id", F.lit("-"), F.lit(5)))
    before = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.col("g").alias("g0"))
    marked = rows.join(before, "ordinal", "left").withColumn("new", F.coalesce(F.col("g") != F.col("g0"), F.lit(True)).cast("int"))
    islands = scheduling.running_sum(marked, "ordinal", "new", "island")
    n = islands.groupBy("island").agg((F.count("*") - F.count_distinct("prediction_vi")).alias("repeats")).groupBy("repeats").agg(F.count("*").alias("n"))
    return n.select("repeats", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("share"))


@R.add("""SELECT doc_kind, COUNT(*) AS n, ROUND(100.0 * AVG((len(string_split(text, ':')) <> 3)::INT), 2) AS odd_format, ROUND(100.0 * AVG((len(string_split(text, chr(10) || chr(10))) > 1)::INT), 2) AS multi_paragraph
FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (doc_kind)""")
def d27_format_stats(spark, d):
    """Share of texts with an odd number of marked parts (d27) or several paragraphs (d28), per kind and overall."""
    docs = table(spark, d, "documents", "doc_kind", "text").where("text IS NOT NULL")
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 2)
    return docs.rollup("doc_kind").agg(
        F.count("*").alias("n"), share(F.size(F.split("text", ":")) != 3).alias("odd_format"), share(F.size(F.split("text", "\n\n")) > 1).alias("multi_paragraph")
    )


@R.add("SELECT source, COUNT(*) AS n, COUNT(DISTINCT text) AS n_unique, ROUND(COUNT(DISTINCT text) / COUNT(*), 6) AS share FROM documents GROUP BY source")
def d29_unique_size(spark, d):
    docs = table(spark, d, "documents", "source", "text")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_unique"), F.round(F.count_distinct("text") / F.count("*"), 6).alias("share"))


@R.add("""SELECT lang, COUNT(n) AS n, ROUND(AVG(n), 4) AS mean, ROUND(stddev_samp(n), 4) AS std, MIN(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, MAX(n) AS max
FROM (SELECT lang, length(text)::INT AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang""")
def d30_length_describe(spark, d):
    """Text lengths with exact, interpolated quartiles."""
    n = table(spark, d, "documents", "lang", "text").where("text IS NOT NULL").select("lang", F.length("text").alias("n"))
    q = lambda p: F.percentile("n", p)
    return n.groupBy("lang").agg(
        F.count("n").alias("n"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"), F.min("n").alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("n").alias("max"),
    )


@R.add("""WITH p AS (SELECT id, arg_min(prediction_vi, row_id) FILTER (system_id = 'A') AS a, arg_min(prediction_vi, row_id) FILTER (system_id = 'B') AS b FROM benchmark_row GROUP BY id)
SELECT COUNT(*) AS n, COUNT(*) FILTER (a = b) AS identical, COUNT(*) FILTER (a IS NULL OR b IS NULL) AS one_sided FROM p""")
def d31_identical_systems(spark, d):
    """Sentences to which both systems gave the same text."""
    pick = lambda s: F.min_by("prediction_vi", F.when((F.col("system_id") == s) & F.col("prediction_vi").isNotNull(), F.col("row_id")))
    p = table(spark, d, "benchmark_row", "row_id", "id", "system_id", "prediction_vi").groupBy("id").agg(pick("A").alias("a"), pick("B").alias("b"))
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_sided"))


@R.add("SELECT file_name, MAX(line_no) - MIN(line_no) + 1 AS expected, COUNT(*) AS found, COUNT(DISTINCT line_no) AS n_distinct FROM raw_row GROUP BY file_name")
def d32_length_check(spark, d):
    """Lines that a file should have by its numbers, and has."""
    return table(spark, d, "raw_row", "file_name", "line_no").groupBy("file_name").agg(
        (F.max("line_no") - F.min("line_no") + 1).alias("expected"), F.count("*").alias("found"), F.count_distinct("line_no").alias("n_distinct")
    )


@R.add("""SELECT model_name, COUNT(*) AS n, ROUND(60.0 * COUNT(*) / greatest(1, date_diff('second', MIN(created_at), MAX(created_at))), 6) AS per_minute,
  ROUND(COUNT(DISTINCT id) * 6 * greatest(1, date_diff('second', MIN(created_at), MAX(created_at))) / COUNT(*), 2) AS est_seconds FROM damage_row GROUP BY model_name""")
def d33_throughput(spark, d):
    """Results a minute by the clock of the runs (l6), and seconds for a whole grid at that rate."""
    span = F.greatest(F.lit(1), F.unix_timestamp(F.date_trunc("second", F.max("created_at"))) - F.unix_timestamp(F.date_trunc("second", F.min("created_at"))))
    g = table(spark, d, "damage_row", "model_name", "id", "created_at").groupBy("model_name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), span.alias("s"))
    return g.select("model_name", "n", F.round(60.0 * F.col("n") / F.col("s"), 6).alias("per_minute"), F.round(F.col("ids") * 6 * F.col("s") / F.col("n"), 2).alias("est_seconds"))


@R.add("SELECT id, system_id, ROUND(AVG(s), 6) AS mean_score, COUNT(s) AS n FROM (SELECT id, system_id, unnest([primary_score, cross_score]) AS s FROM human_cross) WHERE s BETWEEN 0 AND 100 GROUP BY ALL")
def d35_human_mean(spark, d):
    """Mean of all raters' scores per item."""
    both = table(spark, d, "human_cross", "id", "system_id", "primary_score", "cross_score").selectExpr("id", "system_id", "stack(2, primary_score, cross_score) AS s").where("s BETWEEN 0 AND 100")
    return both.groupBy("id", "system_id").agg(F.round(F.avg("s"), 6).alias("mean_score"), F.count("s").alias("n"))


@R.add("""WITH m AS (SELECT id, system_id, AVG((primary_score + cross_score) / 2) AS again FROM human_cross WHERE primary_score BETWEEN 0 AND 100 AND cross_score BETWEEN 0 AND 100 GROUP BY ALL)
SELECT b.system_id, COUNT(*) AS n, ROUND(MAX(abs(b.human_score - m.again)), 6) AS max_diff, ROUND(AVG(abs(b.human_score - m.again)), 6) AS mean_diff FROM benchmark_row b JOIN m ON b.id = m.id AND b.system_id = m.system_id
WHERE b.human_score BETWEEN 0 AND 100 GROUP BY b.system_id""")
def d36_archived_diff(spark, d):
    """Archived scores against recomputed ones."""
    ok = table(spark, d, "human_cross", "id", "system_id", "primary_score", "cross_score").where("primary_score BETWEEN 0 AND 100 AND cross_score BETWEEN 0 AND 100")
    m = ok.groupBy("id", "system_id").agg(F.avg((F.col("primary_score") + F.col("cross_score")) / 2).alias("again"))
    diff = F.abs(F.col("human_score") - F.col("again"))
    j = table(spark, d, "benchmark_row", "id", "system_id", "human_score").where("human_score BETWEEN 0 AND 100").join(m, ["id", "system_id"])
    return j.groupBy("system_id").agg(F.count("*").alias("n"), F.round(F.max(diff), 6).alias("max_diff"), F.round(F.avg(diff), 6).alias("mean_diff"))


@R.add("""SELECT rank, event_type, n FROM (SELECT event_type, COUNT(*) AS n, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS grp,
  ROW_NUMBER() OVER (ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_type) AS rank FROM events GROUP BY event_type)""")
def f1_custom_order(spark, d):
    """Groups in an order of their own (few rows after the aggregate)."""
    g = table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    order = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return g.select(F.row_number().over(Window.orderBy(order, "event_type")).alias("rank"), "event_type", "n")


@R.add("""SELECT event_id, ROUND(CASE WHEN n < 5 THEN value ELSE m END, 6) AS moving FROM (SELECT event_id, value, AVG(value) OVER w AS m, COUNT(*) OVER w AS k, COUNT(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE k = 5 OR n < 5""")
def f7_moving_average(spark, d):
    """Mean over five steps per series, only where the window is full; series of fewer steps stay as they are.

    Every row is added to the windows of its own step and of the four after it, so a long series is spread over all tasks.
    """
    rows = S.with_ordinal(table(spark, d, "events", "event_id", "user_id", "ts", "value"), ["user_id", "ts", "event_id"], "step")
    each = rows.select("user_id", "value", "event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "step")
    own = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).alias(c)
    windows = each.groupBy("user_id", (F.col("step") + F.col("k")).alias("at")).agg(F.avg("value").alias("m"), F.count("*").alias("n"), own("event_id"), own("value")).where("event_id IS NOT NULL")
    short = rows.groupBy("user_id").agg(F.count("*").alias("steps")).where("steps < 5").select("user_id")
    full = windows.where("n = 5").select("event_id", F.round("m", 6).alias("moving"))
    return full.unionByName(windows.where("n < 5").join(short, "user_id", "left_semi").select("event_id", F.round("value", 6).alias("moving")))


@R.add("""SELECT user_id, ROUND(CASE WHEN AVG(value) = 0 THEN 0 ELSE stddev_pop(value) / abs(AVG(value)) END, 6) AS cv, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id""")
def f8_reward_cv(spark, d):
    """Spread over mean per series (0 at mean 0), and the last step (f9)."""
    m = F.avg("value")
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").groupBy("user_id").agg(
        F.round(F.when(m == 0, 0.0).otherwise(F.stddev_pop("value") / F.abs(m)), 6).alias("cv"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")
    )


@R.add(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g')) AS squeezed FROM documents")
def g1_squeeze(spark, d):
    """All texts composed (NFC), runs of blanks of any kind as one, none at the ends."""
    return T.add_mapped(table(spark, d, "documents", "doc_id", "text"), "text", "squeezed", T.normal).select("doc_id", "squeezed")


@R.add()
def g1_squeeze_all(spark, d):
    """All texts composed (NFC), runs of blanks of any kind as one, none at the ends."""
    return T.add_mapped(table(spark, d, "documents", "doc_id", "text"), "text", "squeezed", T.normal).select("doc_id", "squeezed")


@R.add("SELECT row_id, strip_accents(nfc_normalize(prediction_vi)) AS plain FROM benchmark_row")
def g3_strip_marks(spark, d):
    """All texts, of any script, without any marks."""
    return T.add_mapped(table(spark, d, "benchmark_row", "row_id", "prediction_vi"), "prediction_vi", "plain", T.plain).select("row_id", "plain")


@R.add()
def g3_strip_marks_all(spark, d):
    """All texts, of any script, without any marks."""
    return T.add_mapped(table(spark, d, "benchmark_row", "row_id", "prediction_vi"), "prediction_vi", "plain", T.plain).select("row_id", "plain")


@R.add(f"SELECT row_id, nfc_normalize(regexp_replace(translate(nfc_normalize(reference_vi), '{T.NO_TONE[0]}', '{T.NO_TONE[1]}'), '[{T.TONES}]', '', 'g')) AS toneless FROM benchmark_row")
def g2_strip_tone(spark, d):
    """Texts without tone marks; vowel marks stay."""
    return T.add_mapped(table(spark, d, "benchmark_row", "row_id", "reference_vi"), "reference_vi", "toneless", T.toneless).select("row_id", "toneless")


_N = r"trim(regexp_replace(nfc_normalize(reference_vi), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g'))"
_W = f"CASE WHEN {_N} = '' THEN []::VARCHAR[] ELSE string_split({_N}, ' ') END"
_PLACES = "list_sort(list_transform(range(0, len(w)), lambda i: {{'h': md5(concat_ws('|', row_id::VARCHAR, '{n}', i::VARCHAR)), 'i': i}}))"
_KEEP = "greatest(1, round_even(len(w) * {f}::DOUBLE, 0)::INT)"


def _dropped(n: int, f: float) -> str:
    chosen = f"list_sort(list_transform({_PLACES.format(n=n)}[1:{_KEEP.format(f=f)}], lambda s: s.i))"
    return f"CASE WHEN len(w) < 3 THEN w ELSE list_transform({chosen}, lambda i: w[i + 1]) END"


_DAMAGED_SQL = rf"""WITH b AS (SELECT row_id, reference_vi, {_W} AS w FROM benchmark_row), p AS (SELECT *, list_transform(w, lambda x: strip_accents(x)) AS plain, {_dropped(3, 0.85)} AS k3, {_dropped(4, 0.7)} AS k4, {_dropped(5, 0.5)} AS k5 FROM b),
 f AS (SELECT *, coalesce(list_position(list_transform(range(1, len(w) + 1), lambda i: w[i] <> plain[i]), true), 0) AS first FROM p)
SELECT row_id, l AS damage_level, CASE l WHEN 0 THEN array_to_string(w, ' ') WHEN 1 THEN array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = first THEN plain[i] ELSE w[i] END), ' ')
  WHEN 2 THEN array_to_string(CASE WHEN len(w) > 4 THEN plain[:len(w) // 2] || plain[len(w) // 2 + 2:] ELSE plain END, ' ') WHEN 3 THEN array_to_string(k3, ' ')
  WHEN 4 THEN array_to_string(CASE WHEN len(k4) > 3 THEN [k4[1], k4[3], k4[2]] || k4[4:] ELSE k4 END, ' ') ELSE trim(regexp_replace(array_to_string(k5, ' '), '[,.!?;:]+', '', 'g')) END AS damaged_vi
FROM f, range(6) r(l)"""


@R.add(_DAMAGED_SQL)
def g7_rule_damage(spark, d):
    """Six damage levels of all references by rule, of any script."""
    return _damaged(spark, d).select("row_id", F.col("damage_level").cast("long").alias("damage_level"), "damaged_vi")


def _damaged(spark, d):
    rows = T.add_mapped(table(spark, d, "benchmark_row", "row_id", "reference_vi"), "reference_vi", "normal_vi", T.normal).withColumn("words", damage.words(F.col("normal_vi")))
    return damage.damaged(matching.damage_grid(T.add_mapped(rows, "words", "plain_words", T.plain)), "row_id", "normal_vi", plain_words="plain_words")


@R.add()
def g7_rule_damage_all(spark, d):
    """Six damage levels of all references by rule, of any script."""
    return g7_rule_damage(spark, d)


@R.add(f"""WITH {Q.scores(f"SELECT d.row_id * 6 + d.damage_level AS cell, b.reference_vi, d.damaged_vi AS prediction_vi FROM ({_DAMAGED_SQL}) d JOIN benchmark_row b USING (row_id) WHERE b.reference_vi IS NOT NULL", 'cell')}
SELECT (cell % 6)::INT AS damage_level, COUNT(*) AS n, ROUND(AVG(rouge_1), 6) AS mean FROM wide GROUP BY 1""")
def g8_rule_baseline(spark, d):
    """The rule-based branch over the whole benchmark: mean ROUGE-1 of each level."""
    made = _damaged(spark, d).where("reference_vi IS NOT NULL").select("row_id", "damage_level", "reference_vi", F.col("damaged_vi").alias("prediction_vi"))
    return X.add_metrics(made, keys=("rouge_1",)).groupBy("damage_level").agg(F.count("*").alias("n"), F.round(F.avg("rouge_1"), 6).alias("mean"))


@R.add(r"""SELECT damage_id, CASE WHEN regexp_matches(run_key, '^.*\|[0-9]+$') THEN regexp_extract(run_key, '^(.*)\|[0-9]+$', 1) ELSE 'unknown' END AS stem,
  CASE WHEN regexp_matches(run_key, '^.*\|[0-9]+$') THEN regexp_extract(run_key, '\|([0-9]+)$', 1)::INT ELSE -1 END AS level FROM damage_row WHERE run_key IS NOT NULL""")
def g9_parse_run_key(spark, d):
    """A key split at its last bar into stem and level; ('unknown', -1) where it has none."""
    return parsing.split_key(table(spark, d, "damage_row", "damage_id", "run_key").where("run_key IS NOT NULL"), "run_key", r"\|").select("damage_id", "stem", "level")


@R.add(r"""SELECT file_name, regexp_extract(file_name, '^([a-z_]+)_(\d+)_(\d+)_([a-z]+)\.txt$', 1) AS stem, regexp_extract(file_name, '^([a-z_]+)_(\d+)_(\d+)_([a-z]+)\.txt$', 4) AS kind,
  CASE WHEN file_name LIKE '%scsv%' THEN 'semicolon' WHEN file_name LIKE '%tsv%' THEN 'tab' WHEN file_name LIKE '%csv%' THEN 'comma' ELSE 'unknown' END AS target, COUNT(*) AS n FROM raw_row GROUP BY ALL""")
def c17_resolve_target(spark, d):
    """File names taken apart, and resolved to a target by an ordered cascade of rules (g12)."""
    return parsing.resolve(table(spark, d, "raw_row", "file_name")).groupBy("file_name", "stem", "kind", "target").agg(F.count("*").alias("n"))


@R.add(r"""SELECT doc_id, trim(split_part(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), 'Note:', 1), ' ' || chr(10) || chr(9) || chr(13)) AS clean FROM documents WHERE text IS NOT NULL""")
def g14_clean_note(spark, d):
    """Texts up to a note (g14), thinking blocks removed (g15)."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", parsing.before_note(parsing.strip_thinking("text")).alias("clean"))


@R.add(r"""WITH c AS (SELECT damage_id, damage_level, reference_vi, trim(regexp_replace(coalesce(prediction_vi, ''), '^[\s"“”`]+|[\s"“”`]+$', '', 'g')) AS v FROM damage_row)
SELECT damage_id, CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '(?i)^(level|mức hư hại|damage)\s*\d') THEN 'label' WHEN damage_level >= 1 AND v = trim(reference_vi) THEN 'unchanged' ELSE 'ok' END AS class FROM c""")
def g16_parse_prediction(spark, d):
    """Model output stripped of fences and quotes, classed as ok, empty, label or unchanged."""
    rows = table(spark, d, "damage_row", "damage_id", "damage_level", "reference_vi", "prediction_vi")
    return parsing.classify_prediction(rows).select("damage_id", "class")


@R.add("""SELECT error, CASE WHEN error IS NULL THEN 'none' WHEN error LIKE '%rate%' THEN 'rate_limit' WHEN error LIKE '%quota%' OR error LIKE '%billing%' THEN 'quota' WHEN error LIKE '%timeout%' THEN 'retry' ELSE 'unknown' END AS class, COUNT(*) AS n FROM damage_row GROUP BY ALL""")
def g18_classify_errors(spark, d):
    """Errors of runs by what to do about them."""
    e = table(spark, d, "damage_row", "error")
    return e.groupBy("error", parsing.error_class("error").alias("class")).agg(F.count("*").alias("n"))


@R.add("SELECT row_id, sha256(concat_ws('|', row_id::VARCHAR, 'zero_shot', '3')) AS digest, 'Level 3: ' || coalesce(source_zh, '') || ' / ' || coalesce(reference_vi, '') AS prompt FROM benchmark_row")
def g21_prompts(spark, d):
    """Prompts by template with null guards (g19), and the digest of their run key (g22)."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "reference_vi")
    key = F.concat_ws("|", F.col("row_id").cast("string"), F.lit("zero_shot"), F.lit("3"))
    return rows.select("row_id", F.sha2(key, 256).alias("digest"), parsing.render("Level 3: {source_zh} / {reference_vi}").alias("prompt"))


@R.add(f"""WITH {Q.scores("SELECT damage_id, reference_vi, prediction_vi FROM damage_row WHERE damage_level IS NOT NULL", "damage_id", "r_")}, s AS (SELECT w.damage_id, d.damage_level, d.prediction_vi, d.reference_vi, ROUND(w.rouge_1, 9) AS score FROM r_wide w JOIN damage_row d USING (damage_id)),
m AS (SELECT MIN(score) AS lo, MAX(score) - MIN(score) AS span FROM s)
SELECT damage_id, CASE WHEN trim(coalesce(prediction_vi, '')) = '' THEN 0.0 ELSE ROUND(3 * (1 - abs(least(1, greatest(0, (score - lo) / span)) - greatest(0, 1 - damage_level / 5.0))), 6) END AS reward FROM s, m""")
def g26_reward(spark, d):
    """Reward for a score at the height that the damage level asks for."""
    rows = table(spark, d, "damage_row", "damage_id", "reference_vi", "prediction_vi", "damage_level").where("damage_level IS NOT NULL")
    s = X.add_metrics(rows, keys=("rouge_1",)).withColumn("score", F.round("rouge_1", 9))
    return rewards.reward(s, "score", "damage_level", "prediction_vi").select("damage_id", F.round("reward", 6).alias("reward"))


@R.add(r"""WITH w AS (SELECT damage_id, CASE WHEN trim(coalesce(prediction_vi, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(prediction_vi, '\s+', ' ', 'g')), ' ')) END AS p,
  CASE WHEN trim(coalesce(reference_vi, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(reference_vi, '\s+', ' ', 'g')), ' ')) END AS r FROM damage_row)
SELECT damage_id, ROUND(greatest(-3.0, -2.0 * greatest(0.0, p / greatest(1, r)::DOUBLE - 1.2)), 6) AS penalty FROM w""")
def g27_length_penalty(spark, d):
    """Penalty for predictions much longer than their reference."""
    rows = table(spark, d, "damage_row", "damage_id", "prediction_vi", "reference_vi")
    n = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")))
    return rows.select("damage_id", F.round(rewards.length_penalty(n("prediction_vi"), n("reference_vi")), 6).alias("penalty"))


@R.add("SELECT row_id, CASE WHEN human_score IS NULL THEN '' ELSE regexp_replace(format('{:.5f}', human_score / 1000), '^0\\.', '.') END AS shown FROM benchmark_row")
def g28_number_format(spark, d):
    """Scores with five digits and no leading zero."""
    return table(spark, d, "benchmark_row", "row_id", "human_score").select("row_id", parsing.short_number(F.col("human_score") / 1000).alias("shown"))


def _light(spark, d):
    rows = table(spark, d, "benchmark_row", "row_id", "reference_vi", "prediction_vi", "human_score", "quality_flags", "channel").where("size(quality_flags) = 0 AND human_score BETWEEN 0 AND 100")
    return X.add_metrics(rows)


@R.add()
def i1_ridge(spark, d):
    """Ridge of the human score on the metric grid: in-fold free predictions and how they go with the scores."""
    from lexmeta.functions.correlation import pearson

    _, _, oof = models.ridge_cv(_light(spark, d), "row_id", list(X.KEYS), "human_score")
    return oof.agg(F.count("*").alias("n"), F.round(pearson("out_of_fold", "human_score"), 4).alias("pearson"), F.round(F.avg(F.abs(F.col("out_of_fold") - F.col("human_score"))), 4).alias("mae"))


@R.add()
def i2_model_bank(spark, d):
    """One ridge model per channel, mean score of each."""
    scored = models.model_bank(_light(spark, d), "channel", list(X.KEYS), "human_score")
    return scored.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("bank_score"), 4).alias("mean_predicted"), F.round(F.avg("human_score"), 4).alias("mean_human"))


@R.add()
def i3_first_component(spark, d):
    """Range of the first principal component of the metric grid, per channel (d37: its sign goes with the mean metric)."""
    keys = list(X.KEYS)
    rows = _light(spark, d)
    mean, sd, v = models.first_component(rows, keys)
    pc = sum(((F.col(k) - float(m)) / float(s) * float(w) for k, m, s, w in zip(keys, mean, sd, v)), F.lit(0.0))
    return rows.withColumn("pc", pc).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.min("pc"), 4).alias("lo"), F.round(F.avg("pc"), 4).alias("mean"), F.round(F.max("pc"), 4).alias("hi"))


@R.add("""WITH o AS (SELECT DISTINCT id, prompt_type, damage_level FROM damage_row WHERE coalesce(status, 'ok') = 'ok' AND damage_level IS NOT NULL)
SELECT prompt_type, COUNT(*) AS n_ids, COUNT(*) FILTER (k = 6) AS complete, SUM(6 - k)::BIGINT AS missing FROM (SELECT id, prompt_type, COUNT(*) AS k FROM o GROUP BY ALL) GROUP BY prompt_type""")
def l7_finalise(spark, d):
    """Sentences with all six levels done, and what is missing, per branch."""
    o = table(spark, d, "damage_row", "id", "prompt_type", "damage_level", "status").where("coalesce(status, 'ok') = 'ok' AND damage_level IS NOT NULL").select("id", "prompt_type", "damage_level").distinct()
    k = o.groupBy("id", "prompt_type").agg(F.count("*").alias("k"))
    return k.groupBy("prompt_type").agg(F.count("*").alias("n_ids"), F.count_if(F.col("k") == 6).alias("complete"), F.sum(6 - F.col("k")).alias("missing"))


@R.add("""WITH h AS (SELECT DISTINCT prompt_type, md5(concat_ws('|', coalesce(id, ''), coalesce(source_zh, ''), coalesce(reference_vi, ''))) AS h FROM damage_row),
b AS (SELECT prompt_type, h[:4] AS b, sha256(string_agg(h, '' ORDER BY h)) AS t FROM h GROUP BY ALL)
SELECT prompt_type, sha256(string_agg(t, '' ORDER BY b)) AS contract FROM b GROUP BY prompt_type""")
def l8_contract(spark, d):
    """A fingerprint of each branch's input."""
    return scheduling.contract(table(spark, d, "damage_row", "prompt_type", "id", "source_zh", "reference_vi"), "prompt_type", ["id", "source_zh", "reference_vi"])
