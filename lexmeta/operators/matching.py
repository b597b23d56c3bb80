"""Joins and set comparisons with their checks.

Keys compare null-safe where a null is a value of its own (texts), plainly where it is none (ids). Sides are joined by
hash or sort, never by nested loops; the optimiser broadcasts what is small by its own measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row by ``ordinal`` of each combination of ``keys`` (nulls are equal to nulls); ties keep one row.

    An aggregate with map-side combine, so a key with a third of all rows is no burden.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def one_to_one_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge on a key that should be unique: counts of matched, one-sided and repeated keys."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_right"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias("matched"),
        F.count_if(F.col("n_right").isNull()).alias("left_only"), F.count_if(F.col("n_left").isNull()).alias("right_only"),
        F.count_if(F.col("n_left") > 1).alias("left_repeated"), F.count_if(F.col("n_right") > 1).alias("right_repeated"),
    )


def unmatched(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` whose keys, nulls being equal, are nowhere in ``expected``."""
    on = [found[k].eqNullSafe(expected[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return found.join(expected.select(*keys), condition, "left_anti")


def both_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in only one of two sets of equal columns, with ``side``: missing (in a) or extra (in b)."""
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def damage_grid(rows: DataFrame, levels: int = 6) -> DataFrame:
    """Every row at each damage level, 0 to levels - 1."""
    return rows.withColumn("damage_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))


def run_key(*parts: str):
    """The parts, joined by a pipe (a null part is left out)."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def pending(grid: DataFrame, done: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Grid rows without a successful run under the same keys: resumed work. Runs without a status count as ok; a null
    first key is no run, other null keys equal each other."""
    ok = done.where((F.coalesce(F.col(status), F.lit("ok")) == "ok") & F.col(keys[0]).isNotNull()).select(*keys).distinct()
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return grid.alias("g").join(ok.alias("o"), same, "left_anti")


def complete_keys(df: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """Keys that occur with all n members."""
    return df.where(F.col(member).isNotNull()).groupBy(key).agg(F.count_distinct(member).alias("n")).where(F.col("n") == n).select(key)


def self_level_pairs(scored: DataFrame, group: list[str], level: str, score: str) -> DataFrame:
    """Each damaged row beside its group's clean score (the mean of level 0), for groups that have one."""
    clean = scored.where(F.col(level) == 0).groupBy(*group).agg(F.avg(score).alias("clean_score"))
    return scored.where(F.col(level) > 0).join(clean, group)
