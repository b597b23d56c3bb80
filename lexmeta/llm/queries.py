"""The queries of problems 2 to 9 over the benchmark's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmeta.llm import confusables, consensus, leakage, mojibake, pairs, tokenizer, toxicity, truncation
from lexmeta.llm.charmodel import PairModel
from lexmeta.session import cut_lineage
from lexmeta.sources.tables import table

KEYS = ["row_id"]


def _models(spark: SparkSession, d: str) -> dict[str, PairModel]:
    """Pair models of Chinese and Vietnamese text, counted over all documents and held-out items."""
    items = table(spark, d, "heldout_item", "source_zh", "reference_vi")
    texts = table(spark, d, "documents", "text").union(items.select(F.explode(F.array("source_zh", "reference_vi")).alias("text")))
    han, other = PairModel.fit_by_script(texts)
    return {"source_zh": han, "reference_vi": other}


def _garbled(spark: SparkSession, d: str, values: DataFrame, models: dict[str, PairModel] | None = None) -> DataFrame:
    return mojibake.find_garbled(values, models or _models(spark, d), KEYS)


def _values(rows: DataFrame, *fields: str) -> DataFrame:
    pieces = ", ".join(f"'{f}', {f}" for f in fields)
    return rows.selectExpr("row_id", f"stack({len(fields)}, {pieces}) AS (field, value)")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled values with the original as far as it can be given back."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "reference_vi")
    return _garbled(spark, d, _values(rows, "source_zh", "reference_vi"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("row_id", "field")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cross = table(spark, d, "human_cross", "id", "system_id", "round_no", "primary_rater", "primary_score", "cross_rater", "cross_score")
    wanted = cross.groupBy("id", "system_id").agg(F.min("round_no").alias("lo"), F.max("round_no").alias("hi")).where("lo < hi")
    return consensus.Consensus(cross).items(wanted).select("id", "system_id", "grade")


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item's consensus: score, label posteriors, difficulty."""
    cross = table(spark, d, "human_cross", "id", "system_id", "primary_rater", "primary_score", "cross_rater", "cross_score")
    out = consensus.Consensus(cross).items(cross.select("id", "system_id").distinct())
    return out.select("id", "system_id", "grade", "n_ratings", *[F.round(c, 4).alias(c) for c in ("score", "spread", "difficulty", "p1", "p2", "p3", "p4")])


def p3_raters(spark: SparkSession, d: str) -> DataFrame:
    cross = table(spark, d, "human_cross", "id", "system_id", "primary_rater", "primary_score", "cross_rater", "cross_score")
    return consensus.Consensus(cross).raters().select("rater", "n_ratings", *[F.round(c, 4).alias(c) for c in ("slope", "bias", "spread", "reliability")])


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "human_cross", "id", "system_id", "primary_rater", "primary_score", "cross_rater", "cross_score"))


def _counts(rows: DataFrame) -> DataFrame:
    """Trigram counts of all answers, written out, for they are read more than once."""
    return cut_lineage(truncation.count_grams(rows.select(F.explode(F.array("prediction_vi", "reference_vi")).alias("text")), "text"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heldout_item", "item_id", "source_zh", "reference_vi").toDF("item_id", "src", "value")


def _not_garbled(spark: SparkSession, d: str, found: DataFrame, models: dict[str, PairModel] | None = None) -> DataFrame:
    """References that were read with a wrong encoding have a defect of another kind."""
    rows = table(spark, d, "benchmark_row", "row_id", "reference_vi")
    suspects = found.where("field = 'reference_vi'").join(rows, "row_id").select("row_id", "field", F.col("reference_vi").alias("value"))
    return found.join(_garbled(spark, d, suspects, models).select("row_id", "field"), ["row_id", "field"], "left_anti")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """All labels of the defective answers."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "prediction_vi", "reference_vi")
    values = rows.selectExpr("row_id", "source_zh AS src", "stack(2, 'prediction_vi', prediction_vi, 'reference_vi', reference_vi) AS (field, value)")
    found = pairs.label_values(values, ["row_id", "field"], _clean(spark, d), _counts(rows)).where("size(labels) > 0")
    return _not_garbled(spark, d, found).select("row_id", "field", "labels")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_labels(spark, d).select("row_id", "field", F.get("labels", F.lit(0)).alias("defect"))


def p5_regular(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every value."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "reference_vi", "prediction_vi")
    return confusables.regularize(_values(rows, "source_zh", "reference_vi", "prediction_vi")).select("row_id", "field", "regular")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Only the values that have another regular form are held against problems 2 and 4, by models of all texts."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "reference_vi", "prediction_vi")
    values = rows.selectExpr("row_id", "source_zh AS src", "stack(3, 'source_zh', source_zh, 'reference_vi', reference_vi, 'prediction_vi', prediction_vi) AS (field, value)")
    changed = cut_lineage(confusables.regularize(values).where("NOT value <=> regular"))
    garbled = _garbled(spark, d, changed.where("field <> 'prediction_vi'")).select("row_id", "field")
    counts = _counts(rows)
    defective = pairs.label_values(changed.where("field <> 'source_zh'"), ["row_id", "field"], _clean(spark, d), counts).where("size(labels) > 0").select("row_id", "field")
    return changed.select("row_id", "field").join(garbled.union(defective), ["row_id", "field"], "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cut predictions; those with a defect that comes first (nothing to read, refusal, copy, other language) are no cuts."""
    rows = table(spark, d, "benchmark_row", "row_id", "source_zh", "prediction_vi", "reference_vi")
    counts = _counts(rows)
    values = rows.selectExpr("row_id", "source_zh AS src", "prediction_vi AS value")
    return pairs.label_values(values, ["row_id"], _clean(spark, d), counts).where("get(labels, 0) = 'truncated'").select("row_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "benchmark_row", "row_id", "channel"), p6_found(spark, d), "row_id", "channel")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "heldout_item")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the longest passage in tokens."""
    found = leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "heldout_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest").alias("longest"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose leaked spans exceed the limits, without these spans."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return leakage.strip_leaks(docs, table(spark, d, "heldout_item")).where("removed_chars > 0")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents", "doc_id", "text"), toxicity.train(table(spark, d, "toxic_sample", "text", "toxic")))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score and its offending sentences."""
    return _scored(spark, d).withColumn("score", F.round("score", 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("toxic").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, toxic documents and their share per source."""
    hit = p9_found(spark, d).withColumn("hit", F.lit(1))
    docs = table(spark, d, "documents", "doc_id", "source").join(hit, "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_toxic"), F.round(F.count("hit") / F.count("*"), 6).alias("toxic_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p2_found, p2_restored, p3_found, p3_items, p3_raters, p3_agreement, p4_found, p4_labels, p5_found, p5_regular,
        p6_found, p6_rates, p7_ids, p8_found, p8_items, p8_cleaned, p9_found, p9_scores, p9_rates,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from lexmeta.llm.sql import ORACLES

    return ORACLES
