"""Rewards for generated damage. Empty text earns nothing; a constant score is at the lower end of its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reward(df: DataFrame, score: str, level: str, text: str, levels: int = 5, scale: float = 3.0) -> DataFrame:
    """Adds ``reward``: scale x (1 - distance of the range-scaled score from what the level asks for)."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()  # one row
    lo, span = ends["lo"] or 0.0, (ends["hi"] or 0.0) - (ends["lo"] or 0.0)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) - lo) / span)) if span else F.lit(0.0)
    wanted = F.greatest(F.lit(0.0), 1 - F.col(level) / float(levels))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return df.withColumn("reward", F.when(blank, 0.0).otherwise(scale * (1 - F.abs(scaled - wanted))))


def length_penalty(predicted: Column, reference: Column, alpha: float = 2.0, most: float = 1.2, floor: float = -3.0) -> Column:
    """max(floor, -alpha x words beyond ``most`` times the reference)."""
    return F.greatest(F.lit(floor), -alpha * F.greatest(F.lit(0.0), predicted / F.greatest(F.lit(1), reference) - most))
