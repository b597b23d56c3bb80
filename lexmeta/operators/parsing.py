"""Parsing of keys, file names, model output and errors. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_key(df: DataFrame, key: str, bar: str) -> DataFrame:
    """``stem`` and ``level`` of a key at its last ``bar`` (a pattern); 'unknown' and -1 where no number follows one."""
    pattern = f"^(.*){bar}([0-9]+)$"
    ok = F.col(key).rlike(pattern)
    return df.withColumns({
        "stem": F.when(ok, F.regexp_extract(key, pattern, 1)).otherwise("unknown"), "level": F.when(ok, F.regexp_extract(key, pattern, 2).cast("int")).otherwise(-1)
    })


FILE_NAME = r"^([a-z_]+)_(\d+)_(\d+)_([a-z]+)\.txt$"
#: The cascade: the first rule whose word is in the name wins.
TARGETS = (("scsv", "semicolon"), ("tsv", "tab"), ("csv", "comma"))


def resolve(df: DataFrame, name: str = "file_name") -> DataFrame:
    """``stem``, ``kind`` and ``target`` of export file names."""
    target = F.lit("unknown")
    for word, value in reversed(TARGETS):
        target = F.when(F.col(name).contains(word), value).otherwise(target)
    return df.withColumns({"stem": F.regexp_extract(name, FILE_NAME, 1), "kind": F.regexp_extract(name, FILE_NAME, 4), "target": target})


def strip_thinking(text: str | Column) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?s)<think>.*?</think>", "")


def before_note(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit("Note:"), F.lit(1)), r"^[ \n\t\r]+|[ \n\t\r]+$", "")


def classify_prediction(df: DataFrame, prediction: str = "prediction_vi", reference: str = "reference_vi", level: str = "damage_level") -> DataFrame:
    """``value`` without fences and quotes, and ``class``: empty, label, unchanged (at level 1 or more), or ok."""
    v = F.trim(F.regexp_replace(F.coalesce(prediction, F.lit("")), r'^[\s"“”`]+|[\s"“”`]+$', ""))
    kind = (
        F.when(F.col("value") == "", "empty").when(F.col("value").rlike(r"(?i)^(level|mức hư hại|damage)\s*\d"), "label")
        .when((F.col(level) >= 1) & (F.col("value") == F.trim(reference)), "unchanged").otherwise("ok")
    )
    return df.withColumn("value", v).withColumn("class", kind)


def error_class(error: str) -> Column:
    """rate_limit, quota, retry, unknown, or none."""
    e = F.col(error)
    return F.when(e.isNull(), "none").when(e.contains("rate"), "rate_limit").when(e.contains("quota") | e.contains("billing"), "quota").when(e.contains("timeout"), "retry").otherwise("unknown")


def render(template: str) -> Column:
    """A template with {column} places; null columns give nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def redact(text: str, secrets: list[str]) -> Column:
    """The text without the given secrets."""
    out = F.col(text)
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("***"))
    return out


def normal_key(key: str) -> Column:
    """A metric key without its device part."""
    return F.regexp_replace(key, r",device=[^,]*", "")


def prefer_no_device(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per normalised key; of several, the one measured without a device wins, then the smallest key."""
    order = F.struct((~F.col(key).contains("device=None")).alias("other"), F.col(key))
    return df.groupBy(normal_key(key).alias(key)).agg(F.min_by(value, order).alias(value))


def short_number(value: Column, digits: int = 5) -> Column:
    """``digits`` digits and no leading zero; null gives an empty text."""
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.format_string(f"%.{digits}f", value), r"^0\.", "."))
