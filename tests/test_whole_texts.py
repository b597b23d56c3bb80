"""Text queries over whole tables, of any script, against the standard library."""

import re
import unicodedata

from pyspark.sql import functions as F

from lexmeta.functions import text as T
from lexmeta.operators import damage
from lexmeta.plans import catalog

TEXTS = ["Hồ Tây、gần đây", "😀️ rất tốt ạ", "Ｈà Ｎội đẹp", "một\xa0hai  ba", "й ガ 각 Ĝ ά", unicodedata.normalize("NFD", "mười bảy"), "a\x1cb\x85 c", "Việt", "གྷ x", "̂ ấy thì", " ", "", None]


def folder(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "row_id BIGINT, v STRING")
    rows.selectExpr("row_id", "v AS prediction_vi", "v AS reference_vi").write.parquet(f"{tmp_path}/benchmark_row.parquet")
    rows.selectExpr("row_id AS doc_id", "v AS text").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def bare(t):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def test_whole_tables(spark, tmp_path):
    d, q = folder(spark, tmp_path), catalog.queries()
    assert {r.row_id: r.plain for r in q["g3_strip_marks_all"](spark, d).collect()} == {i: None if t is None else bare(t) for i, t in enumerate(TEXTS)}
    want = {i: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip() for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.squeezed for r in q["g1_squeeze_all"](spark, d).collect()} == want

    got = {(r.row_id, r.damage_level): r.damaged_vi for r in q["g7_rule_damage_all"](spark, d).collect()}
    assert len(got) == 6 * len(TEXTS)
    for i, t in enumerate(TEXTS):
        if t is None:
            assert all(got[i, k] is None for k in range(6))
            continue
        words = unicodedata.normalize("NFC", t).split()
        marked = [k for k, w in enumerate(words) if bare(w) != w][:1]
        assert got[i, 0] == " ".join(words) and got[i, 1] == " ".join(bare(w) if k in marked else w for k, w in enumerate(words))
        middle = len(words) // 2 if len(words) > 4 else -1
        assert got[i, 2] == " ".join(bare(w) for k, w in enumerate(words) if k != middle)


def test_level_four_swaps_the_second_and_third_word(spark):
    df = spark.createDataFrame([(1, "một hai ba bốn năm sáu bảy tám chín mười", 4), (2, "một hai ba", 4)], "row_id BIGINT, t STRING, damage_level INT")
    kept = {r.row_id: r.k for r in df.select("row_id", damage.drop_words(damage.words(F.col("t")), F.col("row_id"), 4, 0.3).alias("k")).collect()}
    got = {r.row_id: r.damaged_vi.split(" ") for r in damage.damaged(df, "row_id", "t").collect()}
    assert len(kept[1]) == 7 and got[1] == [kept[1][0], kept[1][2], kept[1][1], *kept[1][3:]]
    assert got[2] == kept[2]  # two words left: nothing to swap


def test_plain_keeps_the_barred_letter():
    assert T.plain("đường Ắ") == "đuong A"
