"""Problem 1: the records of the score export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmeta.operators import raw_records
from lexmeta.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return raw_records.invalid_rows(table(spark, d, "raw_row", "line_id", "delim", "raw_text")).select("line_id", "reason")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid records, typed; the flags as one string, so that both engines compare them alike."""
    rows = raw_records.valid_rows(table(spark, d, "raw_row", "line_id", "delim", "raw_text"))
    return rows.withColumn("quality_flags", F.concat_ws("|", "quality_flags"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Records and faults per file."""
    checked = raw_records.check_records(table(spark, d, "raw_row", "file_name", "delim", "raw_text"))
    return checked.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n_records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rows, p1_report)}


def _record(delim: str) -> tuple[str, str]:
    """The pattern of one field, and of a well-quoted record, for a delimiter."""
    field = rf'(?:"(?:[^"]|"")*"|[^"{delim}\r\n]*)'
    return field, rf"^{field}(?:[{delim}\n]{field})*\r?$"


_CASES = {",": ",", ";": ";", "chr(9)": r"\t"}


def _by_delim(make: Callable[[str], str]) -> str:
    whens = " ".join(f"WHEN delim = {k if k.startswith('chr') else repr(k)} THEN {make(v)}" for k, v in _CASES.items())
    return f"CASE {whens} END"


_WELL = _by_delim(lambda v: f"regexp_full_match(raw_text, '{_record(v)[1]}')")
_COLUMNS = _by_delim(lambda v: f"""length(regexp_replace(regexp_replace(raw_text, '"(?:[^"]|"")*"', 'Q', 'g'), '[^{v}]', '', 'g'))""") + " + 1"
_BREAKS = r"""length(regexp_replace(regexp_replace(raw_text, '"(?:[^"]|"")*"', 'Q', 'g'), '[^\n]', '', 'g'))"""


def _nth(n: int) -> str:
    raw = _by_delim(lambda v: f"regexp_extract(raw_text, '^(?:{_record(v)[0]}{v}){{{n}}}({_record(v)[0]})', 1)")
    return f"""CASE WHEN starts_with(f{n}_, '"') THEN replace(f{n}_[2:-2], '""', '"') ELSE f{n}_ END""", f"{raw} AS f{n}_"


_FIELDS = {c: _nth(i) for i, c in enumerate(raw_records.COLUMNS)}
_NAMES = "|".join(raw_records.FLAGS)
_BASE = f"""WITH b AS (SELECT line_id, file_name, raw_text, {_WELL} AS well, {_COLUMNS} AS n_cols, {_BREAKS} AS breaks,
    {", ".join(raw for _, raw in _FIELDS.values())} FROM raw_row),
  u AS (SELECT line_id, file_name, well, n_cols, breaks, {", ".join(f"{v} AS {c}" for c, (v, _) in _FIELDS.items())} FROM b),
  t AS (SELECT *, trim(human_score) AS bare, regexp_extract_all(quality_flags, '"([A-Za-z_]+)"', 1) AS names FROM u),
  r AS (SELECT *, CASE WHEN NOT coalesce(well, false) THEN 'broken_quoting' WHEN n_cols <> 9 OR breaks > 0 THEN 'column_count'
    WHEN NOT (bare = '' OR (regexp_full_match(bare, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND TRY_CAST(bare AS DOUBLE) BETWEEN 0 AND 100))
      THEN 'invalid_score'
    WHEN NOT (regexp_full_match(quality_flags, '[ \\t\\r\\n]*\\[[ \\t\\r\\n]*("(?:{_NAMES})"([ \\t\\r\\n]*,[ \\t\\r\\n]*"(?:{_NAMES})")*[ \\t\\r\\n]*)?\\][ \\t\\r\\n]*')
      AND names = list_sort(list_distinct(names))) THEN 'invalid_flags' END AS reason FROM t)
"""
ORACLES = {
    "p1_found": _BASE + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_rows": _BASE + """SELECT line_id, id, system_id, source_zh, reference_vi, prediction_vi, TRY_CAST(bare AS DOUBLE) AS human_score,
  array_to_string(names, '|') AS quality_flags, primary_rater, cross_rater FROM r WHERE reason IS NULL""",
    "p1_report": _BASE + "SELECT file_name, coalesce(reason, 'valid') AS outcome, count(*) AS n_records FROM r GROUP BY ALL",
}
