"""One consistent form for texts that look the same, made by DuckDB inside Arrow partitions.

The regular form is NFC with usual spaces, Latin letters and digits. Full-width Chinese punctuation, typographic quotes
and ellipses, words or symbols truly of another script, and joiners inside emoji are regular and stay. Each Arrow batch
is handed to an in-process DuckDB, where one SQL expression with nfc_normalize, translate and regular expressions maps
compatibility forms, invisible characters and look-alikes. Null gives null, empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, for words that hold Latin letters as well.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјкорсухһԁԛԝѵӏүгвнтмп", "ABESIJKMHOPCTYXaesijkopcyxhdqwvlyrBHTMn")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχηϲϳ", "ABEZHIKMNOPTYXayikvoptuxncj")
ARMENIAN = ("օոսհցՕՍ", "onuhgOU")
LATIN = ("ÐƉðɖɑɡıȷ", "ĐĐđđagij")

INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ"
SPACES = "               　"
HYPHENS = "‐‑"


def _compatibility() -> tuple[str, str]:
    """Built by rule: the compatibility forms of one letter, digit or mark, and their usual form."""
    out: dict[str, str] = {}
    wide = {0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F, 0xFF05, 0xFF5E}
    back = {"!": "！", "(": "（", ")": "）", ",": "，", ":": "：", ";": "；", "?": "？", "%": "％", "~": "～"}
    ranges = [(0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0xFE10, 0xFE19), (0xFE30, 0xFE6F), (0xFF10, 0xFF19), (0xFF21, 0xFF3A),
              (0xFF41, 0xFF5A), (0xFF61, 0xFF9F), (0x1D400, 0x1D7FF), (0x2100, 0x2121), (0x2160, 0x217F), (0x24B6, 0x24E9)]
    for lo, hi in ranges:
        for c in range(lo, hi + 1):
            ch = chr(c)
            form = unicodedata.normalize("NFKC", ch)
            if c in wide or form == ch or len(form) != 1 or 0x24B6 <= c <= 0x24E9:
                continue
            if 0xFE10 <= c <= 0xFE6F:  # vertical and small marks stand for the full-width ones
                form = back.get(form, form)
            if form.isalnum() or unicodedata.category(form)[0] in "PS":
                out[ch] = form
    return "".join(out), "".join(out.values())


COMPAT = _compatibility()
#: What reading the text with other eyes can turn up; values without any of it are regular and skip the rest.
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{2640}\x{2642}]"
_WORD = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{M}]+"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regular_sql(value: str) -> str:
    """The DuckDB expression for the regular form of the column ``value``."""
    mark = ""
    keep = value
    for _ in range(2):  # joiners between emoji; neighbours may share one
        keep = f"regexp_replace({keep}, {_lit('(' + _EMOJI + ')' + chr(0x200D) + '(' + _EMOJI + ')')}, {_lit(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"
    bare = f"regexp_replace({keep}, {_lit('[' + INVISIBLE + ']')}, '', 'g')"
    shown = f"translate({bare}, {_lit(mark + SPACES + HYPHENS)}, {_lit(chr(0x200D) + ' ' * len(SPACES) + '-' * len(HYPHENS))})"
    usual = f"translate({shown}, {_lit(COMPAT[0])}, {_lit(COMPAT[1])})"
    foreign, latin = (a + b + c for a, b, c in zip(CYRILLIC, GREEK, ARMENIAN))
    words = f"regexp_extract_all({usual}, {_lit(_WORD + '|' + '[^' + _WORD[1:-2] + ']+')})"
    mixed = f"regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '[\\p{{Greek}}\\p{{Cyrillic}}\\p{{Armenian}}]')"
    mapped = f"list_transform({words}, lambda w: CASE WHEN {mixed} THEN translate(w, {_lit(foreign)}, {_lit(latin)}) ELSE w END)"
    joined = f"array_to_string({mapped}, '')"
    barred = f"regexp_replace(regexp_replace({joined}, 'd\\x{{0335}}', 'đ', 'g'), 'D\\x{{0335}}', 'Đ', 'g')"
    return f"nfc_normalize(translate({barred}, {_lit(LATIN[0])}, {_lit(LATIN[1])}))"


# Characters of usual texts, less every key of the mapping tables.
_USUAL = ((0x00, 0x7E), (0xC0, 0xCF), (0xD1, 0xEF), (0xF1, 0x17F), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x1EA0, 0x1EF9), (0x2013, 0x2026), (0x3001, 0x3011), (0x4E00, 0x9FFF))
_MAPPED = set(CYRILLIC[0] + GREEK[0] + ARMENIAN[0] + LATIN[0] + COMPAT[0] + INVISIBLE + SPACES.replace(" ", "") + HYPHENS)


def _plain_class() -> str:
    """Built by rule: the ranges of _USUAL, split at the mapped characters."""
    out = []
    for lo, hi in _USUAL:
        for c in [*(c for c in range(lo, hi + 1) if chr(c) in _MAPPED), hi + 1]:
            if lo < c:
                out.append(rf"\x{{{lo:X}}}-\x{{{c - 1:X}}}")
            lo = c + 1
    return "^[" + "".join(out) + r"，：；？！（）％]*\z"


_PLAIN = _plain_class()


def regularize(df: DataFrame, value: str = "value", out: str = "regular", more: tuple[str, Callable[[pa.Array], list[pa.Array]]] | None = None) -> DataFrame:
    """Adds the regular form of ``value`` as ``out``; all other columns pass through.

    Values of usual characters only (and nulls) keep their form; the others go to DuckDB. ``more`` (columns as in a schema,
    and a function that makes them of an array of regular forms) adds what else is read off the regular form, in the same pass.
    """
    further, make = T.StructType.fromDDL(more[0]) if more else T.StructType(), more[1] if more else None
    fields = [*df.schema.fields, T.StructField(out, T.StringType()), *further.fields]
    names = [f.name for f in fields]
    if taken := {out, *further.names} & set(df.columns):
        raise ValueError(f"column in the way: {', '.join(sorted(taken))}")
    sql, usual = f"SELECT {regular_sql('v')} AS r FROM batch ORDER BY i", _PLAIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            texts = batch.column(value).cast(pa.string())
            odd = pc.invert(pc.fill_null(pc.match_substring_regex(texts, usual), True))
            rest = texts.filter(odd)
            if len(rest):
                if con is None:
                    import duckdb

                    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
                con.register("batch", pa.table({"v": rest, "i": pa.array(range(len(rest)), pa.int64())}))
                done = con.sql(sql).to_arrow_table().column("r").combine_chunks().cast(pa.string())
                con.unregister("batch")
                texts = pc.replace_with_mask(texts, odd, done)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, *(make(texts) if make else ())], names)
        if con is not None:
            con.close()

    return df.mapInArrow(run, T.StructType(fields))
