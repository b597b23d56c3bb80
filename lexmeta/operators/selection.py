"""Positional selection, sampling and splits over tables whose order is a key column, not the scan's.

Nulls in a selection key sort first and count as any other value; n beyond the table takes all of it; empty tables stay
empty. No operator needs the whole table in one task: the first or last n rows are a top-k, positions come from
``with_ordinal``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmeta.session import cut_lineage


def with_ordinal(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """0-based positions by ``order`` (which must be unique), without a single-task sort: rows are range-partitioned,
    numbered inside their partition, and shifted by the rows of the partitions before."""
    if out in df.columns:
        raise ValueError(f"column in the way: {out}")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, "_part")
    return numbered.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows. As in the list slice it stands for, ``tail(0)`` is everything."""
    return df if n == 0 else df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def hash_order(*parts: str | Column) -> Column:
    """A fixed pseudo-random order: md5 of the parts, joined by a pipe."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones for the same seed."""
    return df.orderBy(hash_order(str(seed), F.col(key)), key).limit(n)


def gather(df: DataFrame, ordinal: str, indices: list[int]) -> DataFrame:
    """Rows at the given positions, in that order and as often as named; ``position`` is the place in the list."""
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in indices])).alias("position", ordinal))
    return wanted.join(df, ordinal)


def sentence_range(df: DataFrame, key: str, ordinal: str, start: int, end: int) -> DataFrame:
    """All rows of the start-th to end-th key (1-based, inclusive) in order of first appearance, with ``sentence_no``."""
    if not 1 <= start <= end:
        raise ValueError(f"not a range: {start}-{end}")
    first = with_ordinal(df.groupBy(key).agg(F.min(ordinal).alias("_first")), ["_first"], "_no")
    chosen = first.select(key, (F.col("_no") + 1).alias("sentence_no")).where(F.col("sentence_no").between(start, end))
    return df.join(chosen, key)


def is_finite(x: str) -> Column:
    c = F.col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clean_rows(df: DataFrame, flags: str = "quality_flags", score: str = "human_score") -> DataFrame:
    """Rows without flags and with a finite score (null flags count as none)."""
    return df.where((F.coalesce(F.size(flags), F.lit(0)) <= 0) & is_finite(score))


def split_flags(df: DataFrame, flags: str = "quality_flags", score: str = "human_score", cross: str = "cross_score") -> DataFrame:
    """Adds ``is_clean``, ``is_scored`` and ``is_cross``."""
    f = F.coalesce(F.col(flags), F.array().cast("array<string>"))
    clean = ~F.array_contains(f, "reference_alignment_issue")
    scored = clean & F.col(score).isNotNull() & ~F.exists(f, lambda x: x.startswith("invalid_score_"))
    return df.withColumns({"is_clean": clean, "is_scored": scored, "is_cross": clean & F.col(cross).isNotNull()})


def word_count(text: str | Column) -> Column:
    """Blank-separated words; 0 for null and blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, taken in turn from the strata in hash order: the k-th rows of all strata come before any k+1-st.

    Only the first n rows of a stratum can be chosen, so each is first cut to a top-n in parallel parts.
    """
    order = hash_order(str(seed), F.col(key))
    salted = df.withColumn("_h", order).withColumn("_salt", F.pmod(F.hash(key), F.lit(64)))
    part = Window.partitionBy(stratum, "_salt").orderBy("_h", key)
    few = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    ranked = few.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    return ranked.orderBy("turn", stratum).limit(n).drop("_h", "_salt", "_r")
