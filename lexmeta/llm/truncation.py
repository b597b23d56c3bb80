"""Text cut off by field limits or in transfer, found with word trigrams in pure SQL.

The word trigrams of all texts are counted twice: *terminal* where a sentence mark follows, *internal* where more text
does. Each also counts as a *longer* form of every trigram whose last word is a proper beginning of its own. A text that
closes with no sentence mark, or with an ellipsis, is looked up by its final trigram: seen often, as it stands or
longer, and almost never terminal means cut. Numbers are ``#``, commas and opening quotes words of their own (so a text
that ends in one is cut by its trigram), marks and capitals don't matter. Trigrams with names are also counted with
``*`` for each name. Pairs are counted likewise; the share of terminal ends is that of the pair, corrected by that of
the trigram, each as far as it was seen (no form needs a least number of occurrences). Single words only tell whether
the last one is hardly ever whole (a comma or opening mark at the end counts as such); that speaks for a cut where pair and trigram say nothing.

A missing final mark alone is no cut: the final trigram is then one that often ends sentences elsewhere. Null, empty
and blank texts are not cut. Repeated rows count as often as they come. Other columns don't matter.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "".join(chr(c) for c in range(0xC0, 0x1EFA) if unicodedata.category(chr(c)) in ("Lu", "Ll"))
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PAIRS = [(ch, {"đ": "d", "Đ": "D"}.get(ch) or unicodedata.normalize("NFKD", ch)[0]) for ch in LETTERS + WIDE]
FROM = "".join(a for a, b in _PAIRS if b.isascii() and b not in "'\\")
TO = "".join(b for a, b in _PAIRS if b.isascii() and b not in "'\\")

#: Share of terminal ends below which an end is surely a cut, and probably one; occurrences that the next shorter form weighs; the share of
#: ends that are terminal, for pairs never seen. Share of whole words below which a last word is a part of one.
NEVER_ENDS, SELDOM_ENDS, BACKING, ANY_WORD, BROKEN = 0.02, 0.08, 1.0, 0.1, 0.002
#: A sentence mark with no letter, digit or further mark after it; an ellipsis at the end.
CLOSED, ELLIPSIS = r"[.!?。！？．][^\p{L}\p{N}.!?…。！？．]*$", r"(?:\.\.|…)[^\p{L}\p{N}]*$"


def fold(text: str) -> str:
    """SQL for the text without marks, joiners, wide forms and odd spaces."""
    bare = rf"regexp_replace(regexp_replace({text}, '[\\p{{Mn}}\\p{{Cf}}]', ''), '[\\p{{Z}}\\s&&[^ ]]+', ' ')"
    return f"translate({bare}, '{FROM}', '{TO}')"


def _sql(pattern: str) -> str:
    """A string literal, in a query that holds tables in braces."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def words(text: str) -> str:
    """SQL for the words of a text as an array of strings: as written, but for numbers (``#``), sentence marks (``.``) and
    commas, colons and opening marks (``,``). Texts without small letters are read as if written in small ones."""
    out = f"IF(regexp_like({text}, {_sql(chr(92) + 'p{Ll}')}), {text}, lower({text}))"
    for pattern, by in ((r"[\p{Mn}\p{Cf}]+", ""), (r"[0-9]+(?:[.,][0-9]+)*", "#"), (r"[.!?…。！？．]+[^\p{L}\p{N}#]*", " . "), (r"[,;:–—“‘«(，；：、（][^\p{L}\p{N}#.]*", " , "), (r"[^\p{L}\p{N}#.,]+", " ")):
        out = f"regexp_replace({out}, {_sql(pattern)}, '{by}')"
    return f"split(trim({out}), ' ')"


def open_ended(text: str) -> str:
    """SQL for whether a text ends in no sentence mark, or in an ellipsis."""
    plain = lambda p: _sql(p).replace("{{", "{").replace("}}", "}")
    return f"(NOT regexp_like({text}, {plain(CLOSED)}) OR (contains({text}, '..') OR contains({text}, '…')) AND regexp_like({text}, {plain(ELLIPSIS)}))"


CAPITAL = _sql(r"(^| )\p{Lu}[^ ]*")

# Shifted arrays side by side give every word with the two before it and the next one, without a function per word.
GRAMS = """
SELECT g.a, g.b, g.c, count_if(g.n = '.') AS terminal, count_if(g.n <> '.') AS internal
FROM (SELECT explode(arrays_zip(a, b, c, n)) AS g
  FROM (SELECT concat(array('^', '^'), w) AS a, concat(array('^'), w) AS b, w AS c, slice(w, 2, size(w)) AS n
    FROM (SELECT {words} AS w FROM {corpus} WHERE {text} IS NOT NULL)))
WHERE g.n IS NOT NULL AND g.c <> '.'
GROUP BY g.a, g.b, g.c
"""

# A form and its level: 5 and 4 trigrams with names as they are and as *, 3 and 2 pairs likewise, 1 the word with its marks.
FORMS = """
SELECT *, inline(array_compact(array(named_struct('level', 5, 'gram', concat('3 ', plain)), IF(named = plain, NULL, named_struct('level', 4, 'gram', concat('3 ', named))),
    named_struct('level', 3, 'gram', concat('2 ', substring_index(plain, ' ', -2))), IF(substring_index(named, ' ', -2) = substring_index(plain, ' ', -2), NULL, named_struct('level', 2, 'gram', concat('2 ', substring_index(named, ' ', -2)))),
    named_struct('level', 1, 'gram', concat('1 ', lower(c))))))
FROM (SELECT * EXCEPT (a, b), translate(lower(concat(a, ' ', b, ' ', c)), {source}, {target}) AS plain,
    translate(lower(regexp_replace(concat(a, ' ', b, ' ', c), {capital}, '$1*')), {source}, {target}) AS named FROM {grams})
"""

COUNTS = """
SELECT gram, sum(terminal) AS terminal, sum(internal) AS internal, sum(longer) AS longer
FROM (SELECT substring(gram, 1, length(gram) - k) AS gram, IF(k = 0, terminal, 0) AS terminal, IF(k = 0, internal, 0) AS internal, IF(k = 0, 0, terminal + internal) AS longer
  FROM (SELECT *, explode(sequence(0, length(substring_index(gram, ' ', -1)) - 1)) AS k
    FROM (SELECT gram, sum(terminal) AS terminal, sum(internal) AS internal FROM {forms} GROUP BY gram)))
GROUP BY gram
"""

# An array of one, transformed, binds a value that is used in several places; a plain column would be worked out in each.
FINALS = """
SELECT {key}, g.*
FROM (SELECT {key}, explode(filter(transform(transform(array({words}), w -> struct(w, size(w) - IF(size(w) > 1 AND w[size(w) - 1] = '.', 1, 0) AS k)),
    x -> struct(IF(x.k > 2, x.w[x.k - 3], '^') AS a, IF(x.k > 1, x.w[x.k - 2], '^') AS b, x.w[x.k - 1] AS c)), x -> x.c NOT IN ('', '.'))) AS g
  FROM {open_ended})
"""

# Each level's share, corrected by the next longer form as far as it was seen; a broken word starts from none.
VERDICT = """
SELECT {key}, final_trigram, broken, aggregate(array(2, 3, 4, 5), IF(broken, 0, CAST({any_word} AS DOUBLE)), (share, i) -> (coalesce(seen[i].terminal, 0) + {backing} * share) / (coalesce(seen[i].whole + seen[i].longer, 0) + {backing})) AS share
FROM (SELECT f.{key}, max(IF(f.level = 5, substring(f.gram, 3), NULL)) AS final_trigram, bool_or(f.level = 1 AND (f.gram = '1 ,' OR coalesce(c.terminal + c.internal < {broken} * c.longer, false))) AS broken,
    map_from_entries(collect_list(struct(f.level, struct(c.terminal, c.terminal + c.internal AS whole, c.longer)))) AS seen
  FROM {forms} f LEFT JOIN {counts} c ON c.gram = f.gram
  GROUP BY f.{key})
"""


def count_grams(corpus: DataFrame, text: str) -> DataFrame:
    """(gram, terminal, internal, longer) over all texts: trigrams, pairs and words; see the module's text."""
    spark = corpus.sparkSession
    grams = spark.sql(GRAMS.format(words=words(text), text=text, corpus="{corpus}"), corpus=corpus.select(text))
    return spark.sql(COUNTS, forms=spark.sql(FORMS.format(source=_sql(FROM), target=_sql(TO), capital=CAPITAL, grams="{grams}"), grams=grams))


def final_shares(df: DataFrame, key: str, text: str, counts: DataFrame) -> DataFrame:
    """(``key``, ``final_trigram``, ``share``, ``broken``) of the open-ended texts: how often such an end is terminal in the
    corpus, and whether the last word is hardly ever a whole one.

    Counting shuffles (trigram, counts) after a map-side sum, and the join shuffles at most five rows per open-ended
    text; no text is broadcast, collected or sent to one task.
    """
    spark = df.sparkSession
    still_open = df.where(open_ended(text)).select(key, text)
    finals = spark.sql(FINALS.format(words=words(text), key=key, open_ended="{open_ended}"), open_ended=still_open)
    forms = spark.sql(FORMS.format(source=_sql(FROM), target=_sql(TO), capital=CAPITAL, grams="{grams}"), grams=finals)
    return spark.sql(VERDICT.format(key=key, any_word=ANY_WORD, backing=BACKING, broken=BROKEN, forms="{forms}", counts="{counts}"), forms=forms, counts=counts)


def find_cut(df: DataFrame, key: str, text: str, counts: DataFrame) -> DataFrame:
    """(``key``, ``final_trigram``) of the cut texts, by the counts of a corpus (usually of the texts themselves)."""
    return final_shares(df, key, text, counts).where(F.col("share") < SELDOM_ENDS).select(key, "final_trigram")


def cut_rates(rows: DataFrame, cut: DataFrame, key: str, source: str) -> DataFrame:
    """Rows, cut rows and their share per source (a null source is one of its own)."""
    flagged = rows.select(key, source).join(cut.select(key, F.lit(1).alias("_cut")), key, "left")
    return flagged.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.count("_cut").alias("n_cut"), F.round(F.count("_cut") / F.count("*"), 6).alias("cut_share")
    )
