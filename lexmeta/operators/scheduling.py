"""Running sums over whole tables, and fingerprints of a branch's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmeta.session import cut_lineage


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The running sum of ``value`` by a unique ``order`` over the whole table: sums inside range partitions, shifted by
    the sums of the partitions before (one row each)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_in", F.sum(value).over(inside)).join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def contract(df: DataFrame, branch: str, columns: list[str]) -> DataFrame:
    """(branch, contract): a digest of the distinct rows' digests, in their order. The rows' digests are gathered in 65,536
    buckets per branch and digested there; a branch's digest is made of its buckets' digests, so no task holds all rows."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    rows = df.select(branch, h.alias("h")).distinct()
    buckets = rows.groupBy(branch, F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("t"))
    joined = buckets.groupBy(branch).agg(F.array_sort(F.collect_list(F.struct("b", "t"))).alias("l"))
    return joined.select(branch, F.sha2(F.array_join(F.transform("l", lambda s: s["t"]), ""), 256).alias("contract"))
