"""Loading delimited records: valid rows come out typed, all others with the reason and the place of the fault.

A record is tokenised by a small finite-state machine over its UTF-8 bytes. Records are cut into chunks of equal
length; for every chunk the machine's *transition map* (end state for each start state) is worked out for all chunks
of an Arrow batch at once, the maps of a record's chunks are composed from left to right, and with the start state of
each chunk known the states inside all chunks are filled in, again for all chunks at once. No chunk waits for the
text before it, so very long records cost no more per byte than short ones.

Edge cases: a null record counts as a record without fields (``column_count``), an empty one holds one empty field.
A line feed outside quotes ends a record too early and counts as ``column_count``, a carriage return there as
``broken_quoting``; one carriage return may end the record.
Further columns of the input pass through ``parse_records`` untouched; a clash with an output name raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = (
    "id", "system_id", "source_zh", "reference_vi", "prediction_vi",
    "human_score", "quality_flags", "primary_rater", "cross_rater",
)
FLAGS = ("invalid_score_A", "invalid_score_B", "missing_text", "reference_alignment_issue", "sheet_alignment_mismatch")

# Byte classes and machine states.
OTHER, DELIM, QUOTE, CR, LF, PAD = range(6)
FIELD_START, PLAIN, QUOTED, CLOSED, ENDING, BROKEN = range(6)
TRANSITIONS = np.array(
    [
        #  OTHER   DELIM        QUOTE   CR      LF      PAD
        [PLAIN, FIELD_START, QUOTED, ENDING, FIELD_START, FIELD_START],
        [PLAIN, FIELD_START, BROKEN, ENDING, FIELD_START, PLAIN],
        [QUOTED, QUOTED, CLOSED, QUOTED, QUOTED, QUOTED],
        [BROKEN, FIELD_START, QUOTED, ENDING, FIELD_START, CLOSED],
        [BROKEN, BROKEN, BROKEN, BROKEN, BROKEN, ENDING],
        [BROKEN, BROKEN, BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    dtype=np.uint8,
)
CHUNK = 256


def _classes(buffer: np.ndarray, delims: np.ndarray) -> np.ndarray:
    """The class of each byte, given the delimiter byte that holds for it."""
    out = np.zeros(len(buffer), dtype=np.uint8)
    out[buffer == 34] = QUOTE
    out[buffer == 13] = CR
    out[buffer == 10] = LF
    out[buffer == delims] = DELIM
    return out


def tokenize(records: list[bytes], delims: list[int], chunk: int = CHUNK) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each record: the byte offsets of its field separators, its end state, the offset of its first fault or -1,
    and the number of line feeds outside quotes."""
    n = len(records)
    lengths = np.fromiter(map(len, records), dtype=np.int64, count=n)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    buffer = np.frombuffer(b"".join(records), dtype=np.uint8)
    classes = _classes(buffer, np.repeat(np.asarray(delims, dtype=np.uint8), lengths))

    per = np.maximum(1, -(-lengths // chunk))
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    of = np.repeat(np.arange(n), per)
    at = starts[of] + (np.arange(len(of)) - first[of]) * chunk
    left = np.minimum(chunk, starts[of] + lengths[of] - at)
    grid = np.full((len(of), chunk), PAD, dtype=np.uint8)
    inside = np.arange(chunk) < left[:, None]
    grid[inside] = classes

    maps = np.tile(np.arange(6, dtype=np.uint8), (len(of), 1))
    for j in range(chunk):
        maps = TRANSITIONS[maps, grid[:, j : j + 1]]
    entry = np.zeros(len(of), dtype=np.uint8)
    state = np.zeros(n, dtype=np.uint8)
    for k in range(int(per.max()) if n else 0):  # composition: the k-th chunk of all records that have one
        some = np.flatnonzero(per > k)
        entry[first[some] + k] = state[some]
        state[some] = maps[first[some] + k, state[some]]
    states = np.empty_like(grid)
    current = entry
    for j in range(chunk):
        current = TRANSITIONS[current, grid[:, j]]
        states[:, j] = current
    flat = states[inside]

    separators = np.flatnonzero(((classes == DELIM) | (classes == LF)) & (flat == FIELD_START))
    breaks = np.add.reduceat(np.append((classes == LF) & (flat == FIELD_START), False).astype(np.int64), starts) if n else starts
    breaks[lengths == 0] = 0
    cuts = np.searchsorted(separators, np.concatenate((starts, [len(buffer)])))
    fields = [separators[cuts[i] : cuts[i + 1]] - starts[i] for i in range(n)]
    bad = np.flatnonzero(flat == BROKEN)
    where = np.searchsorted(bad, starts)
    fault = np.full(n, -1, dtype=np.int64)
    has = where < len(bad)
    has[has] = bad[where[has]] < (starts + lengths)[has]
    fault[has] = bad[where[has]] - starts[has]
    open_end = state == QUOTED
    fault[open_end] = lengths[open_end]
    return fields, state, fault, breaks


def _unquote(field: bytes) -> str:
    if field[:1] == b'"':
        field = field[1:-1].replace(b'""', b'"')
    return field.decode("utf-8")


def _split(record: bytes, separators: np.ndarray, state: int) -> list[str]:
    end = len(record) - 1 if state == ENDING else len(record)
    edges = [-1, *separators.tolist(), end]
    return [_unquote(record[a + 1 : b]) for a, b in zip(edges, edges[1:])]


def parse_records(df: DataFrame, text: str = "raw_text", delim: str = "delim", width: int = len(COLUMNS)) -> DataFrame:
    """Adds ``structure_reason``, ``error_offset`` (bytes), ``n_fields`` and, for sound records, ``fields``."""
    new = T.StructType.fromDDL("structure_reason STRING, error_offset BIGINT, n_fields INT, fields ARRAY<STRING>")
    if clash := {f.name for f in new} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = T.StructType(df.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(text).cast(pa.binary()), batch.column(delim).to_pylist()
            reasons, offsets, counts, values = [], [], [], []
            for lo in range(0, len(texts), 2000):
                raw = texts.slice(lo, 2000).to_pylist()
                records = [r or b"" for r in raw]
                found, states, faults, breaks = tokenize(records, [ord((d or ",")[0]) for d in marks[lo : lo + 2000]])
                for r, record, seps, state, fault, cut in zip(raw, records, found, states.tolist(), faults.tolist(), breaks.tolist()):
                    n = 0 if r is None else len(seps) + 1
                    broken, wrong = fault >= 0, n != width or cut > 0
                    reasons.append("broken_quoting" if broken else "column_count" if wrong else None)
                    offsets.append(fault if broken else len(record) if wrong else None)
                    counts.append(None if broken else n)
                    values.append(None if broken or wrong else _split(record, seps, state))
            more = [
                pa.array(reasons, pa.string()), pa.array(offsets, pa.int64()),
                pa.array(counts, pa.int32()), pa.array(values, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *new.names])

    return df.mapInArrow(run, schema)


def _score_ok(raw: Column) -> Column:
    bare = F.trim(raw)
    number = F.expr("try_cast(trim(_score) AS DOUBLE)")
    return (bare == "") | (bare.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & number.between(0.0, 100.0))


_NAME = '"(?:' + "|".join(FLAGS) + ')"'
_FLAG_ARRAY = rf"^[ \t\r\n]*\[[ \t\r\n]*(?:{_NAME}(?:[ \t\r\n]*,[ \t\r\n]*{_NAME})*[ \t\r\n]*)?\][ \t\r\n]*$"


def check_records(df: DataFrame, text: str = "raw_text", delim: str = "delim") -> DataFrame:
    """``parse_records`` plus typed values and ``reason``: the first of broken_quoting, column_count, invalid_score and
    invalid_flags, or null for a valid record. ``human_score`` may be empty; blanks around a number are allowed."""
    parsed = parse_records(df, text, delim)
    f = {c: F.col("fields")[i] for i, c in enumerate(COLUMNS)}
    typed = parsed.withColumns({"_score": f["human_score"], "_flags": f["quality_flags"]})
    names = F.regexp_extract_all("_flags", F.lit('"([A-Za-z_]+)"'), 1)
    flags_ok = F.col("_flags").rlike(_FLAG_ARRAY) & (names == F.array_sort(F.array_distinct(names)))
    return typed.withColumn(
        "reason",
        F.when(F.col("structure_reason").isNotNull(), F.col("structure_reason"))
        .when(~_score_ok(F.col("_score")), "invalid_score")
        .when(~flags_ok, "invalid_flags"),
    ).withColumn("_names", names)


def valid_rows(df: DataFrame) -> DataFrame:
    """The valid records as typed benchmark rows, with ``line_id``."""
    ok = check_records(df).where("reason IS NULL")
    plain = [F.col("fields")[i].alias(c) for i, c in enumerate(COLUMNS) if c not in ("human_score", "quality_flags")]
    return ok.select("line_id", *plain, F.expr("try_cast(trim(_score) AS DOUBLE)").alias("human_score"), F.col("_names").alias("quality_flags"))


def invalid_rows(df: DataFrame) -> DataFrame:
    """``line_id``, ``reason`` and ``error_offset`` of each record that doesn't load."""
    return check_records(df).where("reason IS NOT NULL").select("line_id", "reason", "error_offset")
