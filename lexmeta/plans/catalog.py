"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmeta.plans import further, matching, metrics, records, reports, selection

MODULES = [records, selection, matching, metrics, reports, further]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.ORACLES.items()}
FLAGSHIP = "d6_r_syn"
