from hypothesis import given, settings
from hypothesis import strategies as st

from lexmeta.functions import text as T
from lexmeta.operators import damage, matching, parsing, scheduling
from lexmeta.operators import selection as S
from pyspark.sql import functions as F


def test_ordinals_are_global(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "k INT").repartition(3)
    assert {r.k: r.ordinal for r in S.with_ordinal(df, ["k"]).collect()} == {1: 0, 3: 1, 5: 2, 7: 3, 9: 4}
    assert S.with_ordinal(df.where("false"), ["k"]).count() == 0


def test_head_tail_gather(spark):
    df = spark.range(10).withColumn("ordinal", F.col("id"))
    assert [r.id for r in S.tail(df, ["id"], 2).collect()] == [9, 8]
    assert S.tail(df, ["id"], 0).count() == 10 and S.head(df, ["id"], 99).count() == 10
    got = S.gather(df, "ordinal", [4, 1, 4]).orderBy("position").collect()
    assert [r.id for r in got] == [4, 1, 4]


def test_sentence_range_counts_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "o INT, k STRING")
    assert sorted(r.o for r in S.sentence_range(df, "k", "o", 1, 2).collect()) == [0, 1, 2]


def test_stratified_takes_in_turn(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 9 else 0) for i in range(60)], "k INT, s INT")
    got = S.stratified(df, "s", "k", 9, 1).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {0: 3, 1: 3, 2: 3}


def test_first_wins_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "x"), (2, "b", "x")], "o INT, k STRING, v STRING")
    assert sorted((r.o, r.k) for r in matching.first_wins(df, ["k", "v"], "o").collect()) == [(1, "a"), (2, "b")]


def test_unmatched_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i INT, k STRING")
    b = spark.createDataFrame([(None,)], "k STRING")
    assert [r.i for r in matching.unmatched(a, b, ["k"]).collect()] == [2]


def test_pending_resumes_by_key(spark):
    grid = spark.createDataFrame([("a|0",), ("a|1",), ("a|2",)], "run_key STRING")
    done = spark.createDataFrame([("a|0", "ok"), ("a|1", "error"), ("a|2", None), (None, "ok")], "run_key STRING, status STRING")
    assert [r.run_key for r in matching.pending(grid, done, ["run_key"]).collect()] == ["a|1"]


def test_running_sum_across_partitions(spark):
    df = spark.range(50).withColumn("v", F.lit(2)).repartition(5)
    assert all(r.s == 2 * (r.id + 1) for r in scheduling.running_sum(df, "id", "v", "s").collect())


def test_marks(spark):
    df = spark.createDataFrame([("tiếng Việt mà mười đ",)], "t STRING")
    r = df.select(T.strip_tone("t").alias("a"), T.strip_marks("t").alias("b")).first()
    assert (r.a, r.b) == ("tiêng Viêt ma mươi đ", "tieng Viet ma muoi đ")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("aăb. ", max_size=30), min_size=1, max_size=4))
def test_damage_levels(spark, texts):
    df = matching.damage_grid(spark.createDataFrame(list(enumerate(texts)), "k INT, t STRING"))
    out = {(r.k, r.damage_level): r.damaged_vi for r in damage.damaged(df, "k", "t").collect()}
    assert len(out) == 6 * len(texts)
    for i, t in enumerate(texts):
        assert out[i, 0] == " ".join(t.split())
        n = len(t.split())
        for level, share in damage.DROPS.items():
            left = out[i, level].split()
            assert level == 5 or len(left) == (n if n < 3 else max(1, round(n * (1 - share))))


def test_parsing(spark):
    df = spark.createDataFrame([("a|b|3",), ("odd",)], "k STRING")
    assert [(r.stem, r.level) for r in parsing.split_key(df, "k", r"\|").orderBy("k").collect()] == [("a|b", 3), ("unknown", -1)]
    keys = spark.createDataFrame([("m,device=cuda", 1.0), ("m,device=None", 2.0)], "k STRING, v DOUBLE")
    assert [(r.k, r.v) for r in parsing.prefer_no_device(keys, "k", "v").collect()] == [("m", 2.0)]
    text = spark.createDataFrame([("key=SECRET x",)], "t STRING")
    assert text.select(parsing.redact("t", ["SECRET"])).first()[0] == "key=*** x"
