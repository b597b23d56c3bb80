from lexmeta.llm import confusables, pairs

ZH = "红江的工程师们在河边重新种植了50公顷森林，因为居民需求增长很快。"


def votes(spark, answers):
    df = spark.createDataFrame([(i, ZH, a) for i, a in enumerate(answers)], "k INT, s STRING, a STRING")
    return [r for r in sorted(pairs.votes(df, ["k"], "s", "a").collect(), key=lambda r: r.k)]


def test_nothing_to_read_at_any_length(spark):
    for r in votes(spark, [" " * 41, "." * 200, "- " * 60, "…" * 50, "—" * 5000]):
        assert r.v_nothing and r.v_tiny
    for r in votes(spark, ["n/a" + " " * 60, " " * 60 + "N/A", "-" * 30 + " null " + "-" * 30, "." * 50 + "không có", "(" * 45 + "trống"]):
        assert r.v_stand_in and r.v_tiny and not r.v_nothing
    for r in votes(spark, ["“Các kỹ sư tại Hồng Giang trồng lại 50 héc ta rừng ven sông.” ", "Không có kỹ sư nào trồng lại rừng ven sông tại Hồng Giang...", "." * 60 + " Các kỹ sư trồng lại rừng"]):
        assert not (r.v_nothing or r.v_stand_in or r.v_tiny)


def test_refusals_in_any_language(spark):
    said = ["Lo siento, no puedo traducir este texto.", "Désolé, je ne peux pas traduire ce texte.", "Thật tiếc, mình chịu thua phần này.", "Mong thông cảm, phần này hơi khó.", "见谅，这段我做不了。"]
    assert all(r.v_apology for r in votes(spark, said))
    assert all(any(p in g for g in (head,) for p in pairs.REFUSAL_GATE.split("|")) for head in pairs._widest(pairs._heads(pairs.APOLOGY) + pairs._heads(pairs.UNABLE)))


def test_other_scripts_between_blanks(spark):
    other = ["다리 가새 로개 통되 었다 고도 시가 밝혔 다", "мы на мо ст не шли по ле су", "สะ พา น ให ม่ เป ดแ ล้ว"]
    assert all(r.v_script for r in votes(spark, other))
    assert not votes(spark, ["Các kỹ sư tại Hồng Giang trồng lại 50 héc ta rừng ven sông “Север”, vì nhu cầu của người dân tăng nhanh."])[0].v_script


def test_every_look_alike_is_mapped_alone(spark):
    pairs_ = list(zip(*confusables.LATIN))
    values = [f"m{a}t" for a, _ in pairs_] + [f"m{a}t\u200b" for a, _ in pairs_]
    out = confusables.regularize(spark.createDataFrame(list(enumerate(values)), "i INT, value STRING")).orderBy("i").collect()
    assert [r.regular for r in out] == [f"m{b}t" for _, b in pairs_] * 2
