"""File sources and sinks: JSON lines, CSV with a byte-order mark, generic examples, score vectors.

Readers take a declared schema and never infer one. Blank lines are no records. A malformed line either stops the load
(``strict``) or comes out in ``_corrupt`` beside the good ones. Writers replace their target by Spark's commit protocol,
so no half-written file is ever seen. Text is UTF-8 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas as DDL.
EXAMPLE = (
    "id STRING, input STRING, context STRING, reference STRING, prediction STRING, model_name STRING, original_human_score STRING, processed_human_score DOUBLE, extra STRING"
)
BENCHMARK_ROW = (
    "id STRING, source_zh STRING, reference_vi STRING, system_id STRING, prediction_vi STRING, human_score DOUBLE, quality_flags ARRAY<STRING>, "
    "metadata STRUCT<stt: INT, common_note: STRING, ai_note: STRING, primary_rater: STRING, primary_score: DOUBLE, cross_rater: STRING, cross_score: DOUBLE>"
)
DAMAGE_ROW = (
    "run_key STRING, id STRING, source_zh STRING, reference_vi STRING, prediction_vi STRING, damage_level INT, prompt_type STRING, model_name STRING, backend STRING, "
    "temperature DOUBLE, status STRING, error STRING, operation STRING, generation_protocol STRING"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line. Not strict: lines that don't parse keep their text in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST", encoding="UTF-8")
    return spark.read.schema(schema + ", _corrupt STRING").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", encoding="UTF-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; a byte-order mark before it is no part of the first name."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", encoding="UTF-8", quote='"', escape='"', multiLine=True)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """A CSV whose parts each begin with a byte-order mark and the header, as spreadsheet programs want it. Partitions
    without rows write none; an empty table gives one part with the header."""
    names = df.columns
    head = "\ufeff" + ",".join('"' + n.replace('"', '""') + '"' for n in names)
    line = F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]), {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = True
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([head, *lines] if waits else lines, pa.string())], ["value"])
                waits = False

    lines = df.select(line.alias("value")).mapInArrow(run, "value STRING")
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([(head,)], "value STRING").coalesce(1)
    lines.write.mode("overwrite").text(path)


def first_present(df: DataFrame, out: str, *aliases: str) -> DataFrame:
    """``out`` from the first of the aliased columns that is there and not blank."""
    there = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in aliases if a in df.columns]
    return df.withColumn(out, F.coalesce(*there) if there else F.lit(None).cast("string"))


def explode_vectors(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Score vectors {metric: [score by position]} to rows (metric, ordinal, score)."""
    keep = [c for c in df.columns if c != scores]
    return df.select(*keep, F.explode(scores).alias("metric", "_v")).select(*keep, "metric", F.posexplode("_v").alias("ordinal", "score"))


def wide_to_long(df: DataFrame, keys: list[str], prefix: str = "metric__") -> DataFrame:
    """Columns ``metric__<key>`` to rows (keys, metric, score)."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(keys, columns, "metric", "score").withColumn("metric", F.substring("metric", len(prefix) + 1, 1000))


def level_cache_checks(df: DataFrame, key: str = "id", level: str = "damage_level", levels: int = 6) -> DataFrame:
    """One row: keys, keys with other levels than 0 to ``levels`` - 1 once each, and repeated (key, level)."""
    per = df.groupBy(key).agg(F.count(level).alias("n"), F.count_distinct(level).alias("k"), F.min(level).alias("lo"), F.max(level).alias("hi"))
    odd = (F.col("k") != levels) | (F.col("lo") != 0) | (F.col("hi") != levels - 1)
    return per.agg(F.count("*").alias("n_keys"), F.count_if(odd).alias("odd_keys"), F.count_if(F.col("n") > F.col("k")).alias("repeated_keys"))
