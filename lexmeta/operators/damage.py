"""Rule-based damage of reference texts at levels 0 to 5, and the audit of damaged sets.

Level 0 is the text with single blanks; 1 strips the marks of the first word that has any; 2 strips all marks and drops the middle
word of more than four; 3 drops 15 %, 4 drops 30 % of the words and swaps the second and third of more than three left; 5 drops
50 % and the punctuation. Which words are dropped is decided by the md5 order of key, level and place, so every engine
and every run makes the same text. Fewer than three words drop none; at least one word stays; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmeta.functions.text import strip_marks

DROPS = {3: 0.15, 4: 0.30, 5: 0.50}


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def drop_words(words: Column, key: Column, level: int, fraction: float) -> Column:
    """Keeps max(1, n (1 - fraction) rounded half to even) words, chosen by hash, in their order."""
    n = F.size(words)
    keep = F.greatest(F.lit(1), F.bround(n * F.lit(1 - fraction)).cast("int"))
    places = F.array_sort(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(level)), i.cast("string"))).alias("h"), i.alias("i")))
    )
    chosen = F.array_sort(F.transform(F.slice(places, 1, keep), lambda s: s["i"]))
    return F.when(n < 3, words).otherwise(F.transform(chosen, lambda i: F.get(words, i)))


def damaged(df: DataFrame, key: str, text: str, level: str = "damage_level", out: str = "damaged_vi", plain_words: str | None = None) -> DataFrame:
    """``df``, which has a level per row, with the damaged text. ``plain_words`` names a column with the words without
    marks; without it they are made for Latin letters."""

    def made(w: Column) -> Column:
        plain = F.col(plain_words) if plain_words else F.transform(w, lambda x: strip_marks(x))
        first = F.array_position(F.zip_with(w, plain, lambda a, b: a != b), True).cast("int")
        one = F.transform(w, lambda x, i: F.when(i == first - 1, F.get(plain, i) if plain_words else strip_marks(x)).otherwise(x))
        middle = F.floor(F.size(w) / 2).cast("int")
        two = F.when(F.size(w) > 4, F.filter(plain, lambda x, i: i != middle)).otherwise(plain)
        kept = {n: drop_words(w, F.col(key), n, f) for n, f in DROPS.items()}
        four = F.transform(F.array(kept[4]), lambda k: F.when(F.size(k) > 3, F.concat(F.array(k[0], k[2], k[1]), F.slice(k, 4, F.size(k)))).otherwise(k))[0]
        return (
            F.when(F.col(level) == 0, F.array_join(w, " ")).when(F.col(level) == 1, F.array_join(one, " ")).when(F.col(level) == 2, F.array_join(two, " "))
            .when(F.col(level) == 3, F.array_join(kept[3], " ")).when(F.col(level) == 4, F.array_join(four, " "))
            .when(F.col(level) == 5, F.trim(F.regexp_replace(F.array_join(kept[5], " "), "[,.!?;:]+", "")))
        )

    # The array of one binds the words, so that they are split once and not in every place that uses them.
    return df.withColumn(out, F.transform(F.array(words(F.col(text))), made)[0])
