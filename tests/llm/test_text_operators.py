import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmeta.llm import charmodel, confusables, consensus, label_model, leakage, mojibake, pairs, tokenizer, toxicity, truncation

VI = ["Bệnh viện Lam Giang cảnh báo mưa lớn có thể gây lở đất.", "Ngân hàng Hồng Phố phát hiện nhiều bức tượng gốm cổ dưới lòng đất.", "Đầu mùa mưa, người dân trồng lại rừng ven sông."]
ZH = ["红江的工程师们在河边重新种植了森林。", "青谷医院警告暴雨可能引发山体滑坡。", "蓝洲银行在地下发现了古陶像。"]


def model(texts):
    points = charmodel.code_points("\0".join(texts * 40))
    inside = points != 0
    chars = np.unique(points[inside].astype(np.int64), return_counts=True)
    return charmodel.PairModel(chars, np.unique(charmodel.bucket(points[:-1], points[1:])[inside[:-1] & inside[1:]], return_counts=True))


@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1258"])
def test_mojibake_round_trip_vietnamese(reader):
    tool = mojibake.Repairer(model(VI))
    table = {b: ch for ch, b in mojibake.TABLES[reader].items()}
    for t in VI:
        garbled = "".join(chr(b) if b < 128 else table[b] for b in t.encode("utf-8"))
        assert tool.check(garbled)[0] == t
        assert tool.check(t) is None


def test_mojibake_chinese_nested_and_lost():
    tool = mojibake.Repairer(model(ZH))
    t = ZH[0]
    assert tool.check(t.encode("gbk").decode("latin-1"))[0] == t
    twice = t.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert tool.check(twice)[0] == t
    assert tool.check("红江的��师们")[1:] == ("lost", False)
    assert tool.check("科考船“Север”停靠石岭港。") is None or tool.check("科考船“Север”停靠石岭港。")[1] == "lost"


def test_mojibake_table(spark):
    corpus = spark.createDataFrame([(t,) for t in VI * 40] + [(None,), ("",)], "text STRING")
    m = charmodel.PairModel.fit(corpus)
    rows = [(1, "f", VI[0]), (2, "f", VI[0].encode().decode("latin-1")), (3, "f", None), (4, "f", "")]
    got = mojibake.find_garbled(spark.createDataFrame(rows, "k INT, field STRING, value STRING"), {"f": m}, ["k"]).collect()
    assert [(r.k, r.restored, r.lossless) for r in got] == [(2, VI[0], True)]


def test_maximal_segments():
    runs = charmodel.improbable_runs(np.array([1, -4, -4, 0, -4, 2, 2, 2, 2, -4.0]), shift=0.0)
    assert [r[:2] for r in runs] == [(1, 6), (9, 11)]


CASES = [
    ("Ｎｇọｃ Châu", "Ngọc Châu"), ("Ngọc Нải", "Ngọc Hải"), (unicodedata.normalize("NFD", "mười"), "mười"), ("a​b\xa0c\xadd", "ab cd"),
    ("“Север” α… 👩‍🔬，！", "“Север” α… 👩‍🔬，！"), ("⽬前３天｡", "目前3天。"), ("结果︐而", "结果，而"), ("Ɖài Ðại", "Đài Đại"), ("", ""), (None, None),
]


def test_regular_form(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i INT, value STRING")
    out = confusables.regularize(df).orderBy("i").collect()
    assert [r.regular for r in out] == [b for _, b in CASES]
    again = confusables.regularize(spark.createDataFrame([(b,) for _, b in CASES], "value STRING")).collect()
    assert all(r.value == r.regular for r in again)


def test_cut_texts(spark):
    subjects = ["Bệnh viện", "Ngân hàng", "Trường học", "Thư viện", "Nhà máy"]
    whole = [f"{s} {n} thu hồi {k} lô sữa bột không đạt chuẩn tại khu vực Lam Giang." for s in subjects for n in ("Kim Châu", "Hồng Phố") for k in range(6)]
    tests = [(1, whole[0]), (2, whole[0][:-1]), (3, "Bệnh viện Kim Châu thu hồi 4 lô sữa"), (4, "Bệnh viện Kim Châu thu hồi 4 lô sữa bột kh"), (5, None), (6, " "), (7, "Bệnh viện Kim Châu cho biết: “")]
    counts = truncation.count_grams(spark.createDataFrame([(w,) for w in whole], "t STRING"), "t")
    got = truncation.find_cut(spark.createDataFrame(tests, "k INT, t STRING"), "k", "t", counts)
    assert sorted(r.k for r in got.collect()) == [3, 4, 7]


def test_label_model_finds_the_reliable_votes():
    rng = np.random.RandomState(1)
    y = rng.rand(4000) < 0.1
    v = np.stack([np.where(y, rng.rand(4000) < h, rng.rand(4000) < a) for h, a in ((0.9, 0.01), (0.8, 0.02), (0.3, 0.3))], 1).astype(int)
    pats, counts = np.unique(v, axis=0, return_counts=True)
    post = label_model.fit(pats.astype(float), counts.astype(float))
    assert post[1, 1, 0] > 0.9 and post[0, 0, 1] < 0.1 and label_model.fit(np.zeros((0, 3)), np.zeros(0)) == {}


def test_pair_votes(spark):
    zh = "红江的工程师们在河边重新种植了50公顷森林，因为居民需求增长很快。"
    vi = "Các kỹ sư tại Hồng Giang trồng lại 50 héc ta rừng ven sông, vì nhu cầu của người dân tăng nhanh."
    rows = [("good", vi), ("null", None), ("na", "N/A"), ("no", "Xin lỗi, tôi không thể dịch nội dung này."), ("copy", zh), ("en", "The engineers of Hong Giang replanted 50 hectares of forest because demand is growing."),
            ("plain", truncation and "Cac ky su tai Hong Giang trong lai 50 hec ta rung ven song, vi nhu cau cua nguoi dan tang nhanh.")]
    df = spark.createDataFrame([(k, zh, a) for k, a in rows], "k STRING, s STRING, a STRING")
    got = {r.k: r for r in pairs.votes(df, ["k"], "s", "a").collect()}
    assert got["null"].v_nothing and got["na"].v_stand_in and got["no"].v_unable and got["no"].v_self
    assert got["copy"].v_same and got["copy"].v_source_grams and got["en"].v_no_syllables and got["en"].v_foreign_words
    assert not any(v for r in ("good", "plain") for k, v in got[r].asDict().items() if k.startswith("v_"))


def test_encoder_is_exact_and_edits():
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{tokenizer.TOKENIZERS}/byte_bpe_50k.tiktoken"
    enc = tokenizer.PrefixEncoder(path)
    ref = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=enc.rank, special_tokens={})
    rng = random.Random(2)
    texts = [*VI, *ZH, "", "   ", "a" * 3000, "<|endoftext|> x", "\n\n \t", "don't 12345 !!??", "".join(chr(rng.randint(32, 0x3000)) for _ in range(400))]
    for t in texts:
        assert enc.encode(t) == ref.encode_ordinary(t)
    for t in texts:
        a = rng.randint(0, len(t))
        b = min(len(t), a + 5)
        assert enc.edit(t, enc.encode(t), a, b, " mới") == ref.encode_ordinary(t[:a] + " mới" + t[b:])
        assert enc.append(t, enc.encode(t), " và nữa") == ref.encode_ordinary(t + " và nữa")
    assert enc.encode(None) == []


def test_leaks_against_windows():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("ba bo bi ma mo mi".split()) for _ in range(30)), None) for i in range(25)]
    detector = leakage.Detector(items, min_syllables=6, min_han=6)
    for _ in range(60):
        doc = " ".join(rng.choice("ba bo bi ma mo mi".split()) for _ in range(25)) + " " + " ".join(rng.choice(items)[1].split()[3 : 3 + rng.randint(4, 9)])
        w = doc.split()
        windows = {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
        want = {i for i, vi, _ in items if any(tuple(vi.split()[k : k + 6]) in windows for k in range(25))}
        assert set(detector.find(doc)) == want


def test_leaks_table(spark):
    vi = "Lúc chuông Cốc Sáy điểm 9 tiếng, người giữ hải đăng Phja Luông gom đủ bức thư"
    items = spark.createDataFrame([(1, "角斋的钟敲了9下时，坡隆的守灯人凑齐了信", vi), (2, None, None)], "item_id BIGINT, source_zh STRING, reference_vi STRING")
    docs = [(1, "X. " + leakage.normal(vi).upper() + " y"), (2, "坡 角 斋 的 钟 敲 了 ９ 下 时, 坡 隆 的 守 灯 人"), (3, " ".join(vi.split()[:11])), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, items).collect()) == [(1, 1), (2, 1)]
    cleaned = {r.doc_id: r for r in leakage.strip_leaks(df, items, max_tokens=12).collect()}
    assert cleaned[1].removed_chars > 40 and cleaned[1].text.startswith("X. ") and cleaned[3].removed_chars == 0
    assert leakage.find_leaks(df, items.where("false")).count() == 0


def test_consensus(spark):
    rng = np.random.RandomState(4)
    habits = {f"R{j}": (b, 1.0, 3.0) for j, b in enumerate((0, 0, 1, -1, -12, 10))} | {"RAND": (0, 0.0, 20.0), "REV": (-60, -1.0, 3.0)}
    truth, rows = {}, []
    for i in range(260):
        truth[f"i{i}"] = t = float(rng.choice([40, 60, 78, 93]) + rng.uniform(-5, 5))
        for n in range(3):
            a, b = rng.choice(list(habits), 2, replace=False)
            score = lambda r: float(np.clip(75 + habits[r][0] + (habits[r][1] * (t - 75) if r != "REV" else -(t - 75) + 60) + rng.randn() * habits[r][2], 0, 100))  # noqa: E731, B023
            rows.append((f"i{i}", "A", n, f" {a.lower()} ", score(a), b, score(b)))
    rows.append(("i0", "A", 0, None, None, "R1", 999.0))
    cross = spark.createDataFrame(rows, "id STRING, system_id STRING, round_no INT, primary_rater STRING, primary_score DOUBLE, cross_rater STRING, cross_score DOUBLE")
    fitted = consensus.Consensus(cross, rounds=8)
    got = {r.id: r for r in fitted.items(cross.select("id", "system_id").distinct()).collect()}
    band = lambda t: 1 + (t >= 50) + (t >= 70) + (t >= 85)
    assert np.mean([got[i].grade == band(t) for i, t in truth.items()]) > 0.9
    assert all(abs(r.p1 + r.p2 + r.p3 + r.p4 - 1) < 1e-6 for r in got.values())
    raters = {r.rater: r for r in fitted.raters().collect()}
    assert raters["RAND"].reliability < 0.6 < raters["R0"].reliability and raters["REV"].slope < 0 and raters["R4"].bias < -6
    assert -1 <= consensus.agreement(cross).first().alpha <= 1


def test_toxicity(spark):
    bad = ["You are a worthless idiot, get lost.", "Thằng admin đúng là đồ ngu, cút ngay.", "你这个白痴，滚出去吧。", "Go kill yourself, you pathetic moron."]
    good = ["The paper mill hired ten technicians.", "Nhà máy giấy thuê kỹ thuật viên.", "红江医院启用了新车站。", 'The villain calls him an "idiot" in the novel.', "Con mèo nhảy lên bàn phím."]
    rng = random.Random(0)
    rows = [(" ".join(rng.sample(good, 2) + ([rng.choice(bad)] if k % 2 else [])), k % 2) for k in range(160)]
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    tricked, whole = "Nhà máy giấy. MÀY đúng là đ.ồ n.g.u, cút ngay.", " ".join(good)
    df = spark.createDataFrame([(1, None), (2, ""), (3, bad[0]), (4, good[0]), (5, tricked), (6, whole * 50)], "doc_id INT, text STRING")
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[1].score == out[2].score == 0.0 and out[3].offending == [bad[0]] and out[4].offending == []
    assert [k for k in out if out[k].toxic] == [3, 5] and out[5].score > 0.5


def test_views_undo_spellings():
    assert toxicity.view("Đ.Ồ.N.G.U") == "dongu" and toxicity.view("ĐỒ NGU") == "do ngu"
    assert toxicity.view("1d1ot") == "idiot" and toxicity.view("傻.逼") == "傻逼" and "nguu" not in toxicity.view("nguuuu")


def test_cut_rates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_id INT, channel STRING")
    cut = rows.where("row_id = 1").select("row_id")
    got = {r.channel: (r.n_rows, r.n_cut) for r in truncation.cut_rates(rows, cut, "row_id", "channel").collect()}
    assert got == {"a": (2, 1), None: (1, 0)}


def test_registered_queries_run(spark):
    import os

    from lexmeta.llm import queries

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    for name in ("p2_found", "p4_found", "p5_found", "p6_rates", "p8_items", "p9_rates"):
        df = queries.queries()[name](spark, small)
        assert df.agg(F.count("*")).first()[0] >= 0


def test_planted_cuts_and_missing_marks(spark):
    """Texts cut at any place are found, whole ones without their mark are not; held-out sentences of the same domain."""
    rng = random.Random(7)
    who = ["Bệnh viện", "Ngân hàng", "Trường học", "Thư viện", "Nhà máy", "Câu lạc bộ", "Công ty", "Bảo tàng"]
    did = ["thu hồi {n} lô sữa bột", "tuyển thêm {n} nhân viên", "khánh thành nhà ga mới", "công bố kết quả thử nghiệm", "quyên góp {n} tấn gạo", "đóng cửa trong {n} tuần"]
    end = ["tại khu vực {p}", "vì nhu cầu tăng nhanh", "để giảm chi phí vận hành", "trước sự chứng kiến của báo chí", "dù ngân sách còn hạn chế", "bằng nguồn vốn địa phương"]
    place = ["Lam Giang", "Hồng Phố", "Kim Châu", "Thạch Thủy", "Vân Khê"]

    def made():
        parts = [rng.choice(who), rng.choice(place), rng.choice(did), rng.choice(end)]
        return " ".join(parts).format(n=rng.randint(2, 99), p=rng.choice(place))

    texts = [f"{made()}. {made()}." for _ in range(3000)]
    counts = truncation.count_grams(spark.createDataFrame([(t,) for t in texts], "t STRING"), "t").persist()
    tests = [(i, t[: rng.randint(12, len(t) - 3)] + ("…" if i % 4 == 0 else "")) for i, t in enumerate(texts[:600])]
    whole = [(i, t[:-1] + ("..." if i % 4 == 0 else "")) for i, t in enumerate(texts[600:1200])]
    shares = {r.k: r.share for r in truncation.final_shares(spark.createDataFrame(tests, "k INT, t STRING"), "k", "t", counts).collect()}
    found = {k for k, share in shares.items() if share < truncation.SELDOM_ENDS}
    full = [made_text[:-1] for made_text in texts[:600]]
    complete = {i for i, t in tests if any(t.rstrip("… ").endswith(e) for e in (f.split("{p}")[0].strip() or f for f in end if "{p}" not in f)) or t.rstrip("… ").endswith(tuple(place)) or t.rstrip("… ") in full or t.endswith(".")}
    missed = set(range(600)) - found - complete
    assert len(missed) <= 0.05 * 600, [tests[k][1] for k in sorted(missed)][:10]
    wrong = truncation.find_cut(spark.createDataFrame(whole, "k INT, t STRING"), "k", "t", counts).count()
    assert wrong <= 6


def test_garbled_runs_of_any_length():
    text = "Các kỹ sư tại Hồng Giang trồng lại 50 héc ta rừng ven sông, vì nhu cầu của người dân tăng nhanh. " * 1000
    points = charmodel.code_points(text[:5000])
    pairs = charmodel.bucket(points[:-1], points[1:])
    model = charmodel.PairModel(np.unique(points.astype(np.int64), return_counts=True), np.unique(pairs, return_counts=True))
    bad = text.encode("utf-8").decode("latin-1")
    assert len(bad) > 100_000
    restored, _, lossless = mojibake.Repairer(model).check(bad)
    assert lossless and restored == text
    nested = text[:400].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert mojibake.Repairer(model).check(nested)[0] == text[:400]
