import random

from lexmeta.llm import confusables, pairs, truncation

PARTS = [*pairs.REFUSAL_GATE.split("|"), "Xin lỗi", "KHÔNG THỂ", "ｔừ ＣＨốİ", "tỪ chİ", "Can’T", "…", "..", "。", "  ", "​ ", "\n", "\t ", "Север", "สะพาน", "红江", "héc ta", "Lam Giang", "đ", "Ø", "K", "ſorry", "?", "”", "\U0001f600", "\U0002ffff", "12", ""]


def _answers():
    rng = random.Random(11)
    made = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ", ", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    return [*made, *PARTS, *[p.upper() for p in PARTS], *[f"a{p[:-1]}İ b" for p in PARTS if p.endswith("i")], None]


def test_glance_says_what_the_expressions_say(spark):
    """The reading of whole arrays against the same questions asked of one text at a time by built-in expressions."""
    df = spark.createDataFrame(list(enumerate(_answers())), "k INT, a STRING")
    gate = " OR ".join(f"contains(x, {pairs._q(p)})" for p in pairs.REFUSAL_GATE.split("|"))
    want = {
        "_blanks": "length(a) - length(replace(a, ' ', '')) + 1",
        "_maybe_refusal": f"transform(array(translate(lower(a), '{truncation.FROM}', '{truncation.TO}')), x -> {gate})[0]",
        "_other_script": f"regexp_like(a, '{pairs.OTHER_SCRIPT}')",
        "_no_end": truncation.open_ended("a"),
        "_loose": r"a <> '' AND (regexp_like(left(a, 1), '[^\\p{L}\\p{N}]') OR regexp_like(right(a, 2), '[^\\p{L}\\p{N}]{2}') OR regexp_like(a, '[\\p{Z}\\p{C}\\s]{2}'))",
    }
    out = pairs._glanced(df, "a").selectExpr("a", *[f"`{c}` AS got{c}" for c in want], *[f"{e} AS want{c}" for c, e in want.items()]).collect()
    for c in want:
        assert [r.a for r in out if r[f"got{c}"] != r[f"want{c}"]] == [], c
        assert len({r[f"got{c}"] for r in out}) > 2, c


def test_answers_are_read_once(spark, tmp_path):
    """One scan and one pass through Arrow give the regular form and all that decides about the costly patterns."""
    spark.createDataFrame([(1, "红江", "Xin lỗi, tôi không thể dịch."), (2, "红江", "Ｎｇọｃ"), (3, None, None)], "k INT, src STRING, value STRING").write.parquet(f"{tmp_path}/t")
    voted = pairs.all_votes(spark.read.parquet(f"{tmp_path}/t"), ["k"], None)
    plan = voted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1 and "Union" not in plan
    assert {r.k: (r.v_apology, r.v_nothing) for r in voted.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_regular_form_with_further_columns(spark):
    rows = [(1, "Ｎｇọｃ"), (2, None), (3, "plain"), (4, "⽬前３天｡"), (5, "")]
    df = spark.createDataFrame(rows, "k INT, value STRING").coalesce(1)
    out = {r.k: r for r in confusables.regularize(df, more=pairs._glance()).collect()}
    assert [out[k].regular for k in range(1, 6)] == ["Ngọc", None, "plain", "目前3天。", ""]
    assert out[4]._other_script and not out[4]._no_end and out[3]._no_end and out[2]._no_end is None
