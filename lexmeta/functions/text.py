"""Text functions: Unicode-aware normalisation, tone and mark stripping, tokens, fingerprints.

Most are column expressions that stay in the JVM. They read composed (NFC) text; decomposed marks are handled where the
docstring says so. Null gives null. What needs the Unicode tables whole runs in Arrow batches (``add_mapped``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TONES = "̣̀́̃̉"


def _table(drop: str | None) -> tuple[str, str]:
    """Built by rule: composed letters, and what is left of them without the given marks (None: all marks, of Latin letters)."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if drop is None else range(0xC0, 0x3100):
        parts = unicodedata.normalize("NFD", chr(c))
        if drop is not None and not any(p in drop for p in parts):
            continue
        kept = "".join(p for p in parts if not (unicodedata.combining(p) if drop is None else p in drop))
        form = unicodedata.normalize("NFC", kept)
        if form != chr(c) and len(form) == 1:
            pairs.append((chr(c), form))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


NO_TONE, _NO_MARKS = _table(TONES), _table(None)


def squeeze(text: str | Column) -> Column:
    """Runs of white space (of any script) become one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\s+", " "))


def strip_tone(text: str | Column) -> Column:
    """Without the five Vietnamese tone marks; vowel marks stay. Decomposed tone marks go as well."""
    t = F.col(text) if isinstance(text, str) else text
    return F.translate(F.regexp_replace(t, f"[{TONES}]", ""), *NO_TONE)


def strip_marks(text: str | Column) -> Column:
    """Without any combining mark; the barred d stays a letter of its own."""
    t = F.col(text) if isinstance(text, str) else text
    return F.translate(F.regexp_replace(t, r"\p{Mn}+", ""), *_NO_MARKS)


def words(text: str | Column) -> Column:
    """Blank-separated words; blank text has none."""
    t = squeeze(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def finite_or_null(value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def normal(text: str) -> str:
    """NFC, runs of white space as one blank, none at the ends."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


def plain(text: str) -> str:
    """Without any combining mark, of any script; composed or not."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def toneless(text: str) -> str:
    """Without the five tone marks, composed; vowel marks stay."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if c not in TONES))


def add_mapped(df: DataFrame, value: str, out: str, f: Callable[[str], str]) -> DataFrame:
    """``df`` with ``f`` of the texts (or of each text of the arrays) of ``value`` as ``out``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[value].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(value)
            made = [None if v is None else [f(x) for x in v] if isinstance(v, list) else f(v) for v in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, column.type)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
