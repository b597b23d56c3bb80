"""Defective answers to a source text: empty, refusal, copy, other_language, truncated.

Several noisy labelling functions per defect vote on each (source, answer); an EM label model per defect turns vote
patterns into posteriors, and every label whose posterior exceeds its cutoff is kept. The cutoffs are validated on a
clean table into which known defects are put. Answers are read in their regular form, so wide letters or invisible
characters are no defect here.

Null answers are ``empty``; a null or empty source gives no ``copy``; repeated rows are judged alike; a missing final
mark alone, missing Vietnamese marks and wrong translations are no defects. All votes are built-in expressions; which of
their costly patterns an answer needs is read off Arrow arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmeta.llm import label_model, truncation
from lexmeta.llm.confusables import regularize

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

# Stand-ins for a missing value.
STAND_INS = (
    "n/a", "na", "null", "none", "nan", "nil", "empty", "undefined", "missing", "unknown", "tbd", "todo", "void", "blank", "no translation",
    "không có", "trống", "khong co", "trong", "chưa có", "chua co", "chưa dịch", "chua dich", "không", "无", "空", "暂无", "没有", "未翻译", "缺失",
)
APOLOGY = "sorry|apolog|unfortunately|regret|xin loi|rat tiec|that tiec|tiec la|thu loi|mong thong cam|抱歉|对不起|遗憾|不好意思|原谅|見諒|见谅|désolé|lo siento"
SELF = r"\bi\b|\bi'm\b|\bi’m\b|\bwe\b|as an ai|language model|\bassistant\b|\btôi\b|\bmình\b|\bem\b|mô hình ngôn ngữ|trợ lý|hệ thống|我|作为|模型|助手|系统"
UNABLE = (
    r"cannot|can't|can’t|can not|could not|couldn't|unable|not able|won't|won’t|will not|not allowed|not permitted|must decline|have to decline|refuse to|do not have the|don't have the"
    r"|khong the|khong duoc phep|khong co kha nang|khong co quyen|khong ho tro|chua the|xin khong|tiec khong|xin phep khong"
    r"|(?:toi|minh|em|danh|phai|xin|phep|tro ly|he thong) tu choi|khong (?:dich|xu ly|tra loi|chuyen ngu|thuc hien)(?: \w+){0,3} duoc"
    "|无法|不能|不便|不可以|不允许|没法|没有办法|不予|拒绝(?:翻译|处理|回答)"
)
TASK = (
    "translat|request|content|this text|the text|sentence|passage|assist|help|provid|process|answer|comply|policy|complete"
    "|dich|yeu cau|noi dung|van ban|doan van|cau nay|cau tren|cau nguon|ho tro|xu ly|tra loi|giup|thuc hien|tieng viet|chuyen ngu|phan nay|duoc"
    "|翻译|请求|内容|文字|处理|回答|协助|帮助|提供|完成|这段|该句|这句"
)
MARKED = "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ"
#: Shape of a Vietnamese syllable without marks.
SYLLABLE = r"(?:ngh|ng|nh|gh|gi|kh|ch|th|tr|ph|qu|[bcdghklmnprstvx])?(?:uye|uyu|oai|oay|oeo|uoi|uou|ieu|yeu|uay|uya|ai|ao|au|ay|eo|eu|ia|ie|iu|oa|oe|oi|oo|ua|ue|ui|uo|uu|uy|ye|[aeiouy])(?:ng|nh|ch|[cmnpt])?"
# Frequent words of other languages written in Latin letters.
FOREIGN_WORDS = (
    "the|of|and|to|with|for|was|were|by|from|that|which|after|before|while|because|its|has|have|will|than|more|this|is|are|at|on"
    "|le|la|les|des|une|un|du|et|pour|dans|avec|cette|est|sur|qui|au|malgre|der|die|das|und|mit|nach|den|dem|ist|ein|eine|hat|fur|von"
    "|el|los|las|una|para|por|con|del|que|se|su|di|yang|dan|untuk|dengan|ini|itu|dari|pada|akan|telah|sudah|sampai|tidak|il|per|che|della|os|uma|nao"
)
NEVER_VIETNAMESE = (
    "the|of|and|with|for|was|were|from|that|which|after|before|because|has|have|than|more|this|les|des|une|pour|dans|avec|cette|est|der|die|das|und|mit|den|dem|ist|eine|hat|los|las|una|para|por|del"
    "|yang|untuk|dengan|dari|pada|telah|sudah|sampai|tidak|della"
)
#: Parts of which every refusal has one; only texts with one get as far as the patterns.
REFUSAL_PARTS = (
    "khong the|không thể|khong duoc|không được|khong co|không có|khong ho|không hỗ|chua the|chưa thể|xin khong|xin không|tiec khong|tiếc không|phep khong|phép không|tu choi|từ chối|khong dich|không dịch"
    "|khong xu|không xử|khong tra|không trả|khong chuyen|không chuyển|khong thuc|không thực|can't|can’t|cannot|can not|could|unable|not able|won't|won’t|will not|not allowed|not permitted|decline|refuse"
    "|not have|n't have|as an ai|mô hình ngôn ngữ|mo hinh ngon ngu|language model|xin lỗi|xin loi|rất tiếc|rat tiec|sorry|apolog|unfortunately|regret|无法|不能|不便|不可以|不允许|没法|没有办法|不予|拒绝|抱歉|对不起|遗憾|不好意思|原谅|模型"
)

_FOLD = str.maketrans(truncation.FROM, truncation.TO)


def _heads(pattern: str) -> list[str]:
    """Literal parts of which every match of ``pattern`` (an alternation, groups one deep) has one."""
    out = []
    for a in re.findall(r"(?:\([^)]*\)|[^|(])+", pattern):
        group = re.search(r"\(\?:([^)]*)\)", a)
        if not group:
            out.append(a)
        elif a[: group.start()]:
            out += [a[: group.start()] + w for w in group[1].split("|")]
        else:
            out.append(a[group.end() :])
    return out


def _widest(parts: list[str]) -> list[str]:
    """Without marks, and without those that have another one inside."""
    plain = list(dict.fromkeys(p.translate(_FOLD) for p in parts))
    return [p for p in plain if not any(q != p and q in p for q in plain)]


#: Looked for in texts without marks: built from the patterns, so that none of them asks for what the gate doesn't let by.
REFUSAL_GATE = "|".join(_widest([*REFUSAL_PARTS.split("|"), *_heads(APOLOGY), *_heads(UNABLE), "as an ai", "mo hinh ngon ngu", "language model", "模型"]))
#: Letters of other scripts than Latin, by blocks (some marks of these blocks are in it as well): all but the blocks named,
#: the most frequent first, for those end the test.
OTHER_SCRIPT = r"[^\\x00-\\u036F\\u1E00-\\u1EFF\\u2000-\\u2BFF\\u3000-\\u3004\\u3006\\u3008-\\u3020\\uD800-\\uF8FF\\uFEFF-\\uFF65\\uFFDD-\\uFFFF\\x{1F000}-\\x{1FFFF}\\x{40000}-\\x{10FFFF}]"

VOTES = {
    "empty": ["v_nothing", "v_stand_in", "v_tiny"],
    "refusal": ["v_unable", "v_apology", "v_self", "v_no_numbers", "v_unlike_source"],
    "copy": ["v_same", "v_source_grams", "v_source_part", "v_han"],
    "other_language": ["v_no_syllables", "v_foreign_words", "v_script", "v_no_marks_foreign"],
    "truncated": ["v_cut_trigram", "v_seldom_ends", "v_broken_word", "v_short", "v_open_quote"],
}


#: Blanks and marks at both ends; possessive, so that a long run of them inside is read once.
_ENDS = r"^[\\p{P}\\p{S}\\p{Z}\\p{C}\\s]++|(?<![\\p{P}\\p{S}\\p{Z}\\p{C}\\s])[\\p{P}\\p{S}\\p{Z}\\p{C}\\s]++$"


def _han(column: str) -> str:
    return rf"regexp_replace({column}, '[^\\p{{IsHan}}]', '')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _word(pattern: str) -> str:
    return rf"(?<!\p{{L}})(?:{pattern})(?!\p{{L}})"


def _spelt(parts: list[str]) -> str:
    """A pattern that matches a text if and only if it has one of the parts (without marks) once it is in small letters and without marks."""
    forms: dict[str, list[str]] = {ch: [] for ch in "".join(parts)}
    for u in map(chr, range(0x10000)):
        small = u.lower().translate(_FOLD)
        if small in forms:
            forms[small].append(u)
    of = lambda chars: "[" + "".join(rf"\x{{{ord(u):X}}}" for u in chars) + "]"
    # The small form of İ is i and a mark after it, so it is the i at the end of a part.
    return "|".join("".join(map(of, (forms[ch] for ch in p[:-1]))) + of(forms[p[-1]] + ["İ"] * (p[-1] == "i")) for p in parts)


def _glance() -> tuple[str, Callable[[pa.Array], list[pa.Array]]]:
    """What decides which of the costly patterns an answer needs, read off whole Arrow arrays in time linear in the text:
    pieces between blanks, parts of refusals, letters of other scripts, an open end, and blanks or marks to strip."""
    gate, script = _spelt(REFUSAL_GATE.split("|")), re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", OTHER_SCRIPT.replace("\\\\", "\\"))
    closed, ellipsis = truncation.CLOSED, truncation.ELLIPSIS
    # What is no letter, digit, mark or symbol is a blank or a control character, or not assigned.
    padded = r"^[^\p{L}\p{N}]|[^\p{L}\p{N}]{2}$|[^\p{L}\p{N}\p{P}\p{S}\p{M}]{2}"

    def read(texts: pa.Array) -> list[pa.Array]:
        has = lambda pattern: pc.match_substring_regex(texts, pattern)
        still_open = pc.or_(pc.invert(has(closed)), has(ellipsis))
        return [pc.add(pc.count_substring(texts, " "), pa.scalar(1, pa.int32())), has(gate), has(script), still_open, has(padded)]

    return "_blanks INT, _maybe_refusal BOOLEAN, _other_script BOOLEAN, _no_end BOOLEAN, _loose BOOLEAN", read


def _glanced(df: DataFrame, answer: str) -> DataFrame:
    """Adds the columns of ``_glance`` for answers in regular form."""
    columns, read = _glance()
    fields = [*df.schema.fields, *T.StructType.fromDDL(columns).fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *read(batch.column(answer).cast(pa.string()))], names)

    return df.mapInArrow(run, T.StructType(fields))


def votes(df: DataFrame, key: list[str], source: str, answer: str) -> DataFrame:
    """The votes of all functions but the trigram one, for answers in regular form.

    Costly patterns come after cheap conditions that they need to hold: refusals have one of a few words, copies have
    Han letters, and a text with many Vietnamese marks is in no other language.
    """
    if "_maybe_refusal" not in df.columns:
        df = _glanced(df.select(*key, source, answer), answer)
    base = df.withColumnsRenamed({source: "_s", answer: "_a"})
    stand_in = f"_strip IN ({', '.join(_q(w) for w in STAND_INS)})"
    sized = base.selectExpr(
        "*",
        "length(_a) AS _len",
        "octet_length(_a) AS _bytes",
    ).selectExpr(
        "*",
        # Few marks, many bytes between blanks or a letter of another script: else the text is Vietnamese.
        "_bytes - _len < 0.6D * _blanks OR _bytes > 9 * _blanks OR _other_script AS _odd",
    ).selectExpr(
        "*",
        "CASE WHEN _maybe_refusal OR _odd THEN lower(_a) END AS _l",
    ).selectExpr(
        "*",
        f"CASE WHEN _odd THEN length(_l) - length(translate(_l, '{MARKED}', '')) END AS _n_marks",
        r"CASE WHEN _odd THEN length(regexp_replace(_a, '[^\\p{IsHan}]+', '')) ELSE 0 END AS _n_han",
        "_blanks >= 2 AND _no_end AS _open_end",
        "_len > 40 AND _loose AS _padded",
    ).selectExpr(
        "*",
        "_odd AND _n_marks < 0.3D * _blanks AS _maybe_foreign",
        # What is left without blanks and marks at the ends, of any length before; long answers that start and end with a letter or digit skip it.
        rf"CASE WHEN _len <= 40 OR _padded THEN lower(trim(regexp_replace(_a, '{_ENDS}', ''))) END AS _strip",
        r"CASE WHEN _len <= 40 OR _padded THEN length(regexp_replace(_a, '[\\p{Z}\\p{C}\\s]+', '')) ELSE _len END AS _solid",
        f"CASE WHEN _maybe_refusal OR _odd THEN {truncation.fold('_l')} END AS _f",
        # Only answers with Han letters get as far as comparing grams with the source.
        rf"CASE WHEN _n_han >= 5 THEN {_han('_s')} END AS _hs",
        rf"CASE WHEN _n_han >= 5 THEN {_han('_a')} END AS _ha",
    ).selectExpr(
        "*",
        r"CASE WHEN _maybe_foreign THEN regexp_count(_f, '\\p{L}+') END AS _n_words",
        r"CASE WHEN _maybe_foreign OR _n_han >= 5 THEN length(regexp_replace(_a, '[^\\p{L}]', '')) END AS _letters",
        """CASE WHEN length(_ha) >= 5 AND length(_hs) >= 5 THEN transform(array(struct(
             transform(sequence(1, length(_hs) - 2), i -> substring(_hs, i, 3)) AS s, transform(sequence(1, length(_ha) - 2), i -> substring(_ha, i, 3)) AS a)),
             x -> size(array_intersect(x.s, x.a)) / size(array_distinct(x.s)))[0] ELSE 0.0D END AS _grams""",
    ).selectExpr("*", f"CASE WHEN _maybe_foreign THEN regexp_count(_f, {_q(_word(SYLLABLE))}) / greatest(_n_words, 1) END AS _syllables")
    task = f"regexp_like(_f, {_q('(?:' + TASK + ')')})"
    yes = {
        "v_nothing": r"_a IS NULL OR NOT regexp_like(_a, '[\\p{L}\\p{N}]')",
        "v_stand_in": stand_in,
        "v_tiny": "_a IS NULL OR _solid <= 9 OR length(_strip) <= 9 AND _len > 40",
        "v_unable": f"_maybe_refusal AND regexp_like(_f, {_q('(?:' + UNABLE + ')[^.!?。！？]{0,60}(?:' + TASK + ')')})",
        "v_apology": f"_maybe_refusal AND (regexp_like(_f, {_q('^[^.!?。！？]{0,12}(?:' + APOLOGY.translate(_FOLD) + ')')}) OR regexp_like(_f, 'as an ai|mo hinh ngon ngu|language model|作为.{{0,6}}模型'))",
        "v_self": f"_maybe_refusal AND regexp_like(_l, {_q('^.{0,25}(?:' + SELF + ')')})",
        "v_no_numbers": "_maybe_refusal AND _len > 9 AND regexp_like(_s, '[0-9]') AND NOT regexp_like(regexp_replace(_a, '[(（][^)）]*[)）]', ''), '[0-9]')",
        "v_unlike_source": f"_maybe_refusal AND _solid > 9 AND _solid < 160 AND {task} AND regexp_like(_f, {_q('(?:' + UNABLE + ')')})",
        "v_same": "_len > 4 AND _odd AND regexp_replace(_a, '[\\\\p{Z}\\\\p{C}\\\\s]+', '') = regexp_replace(_s, '[\\\\p{Z}\\\\p{C}\\\\s]+', '')",
        "v_source_grams": "_grams >= 0.6D",
        "v_source_part": "length(_hs) >= 4 AND instr(_ha, substring(_hs, 1, 8)) > 0",
        "v_han": "_n_han >= 5 AND _n_han >= 0.3D * _letters",
        "v_no_syllables": "_maybe_foreign AND _n_words >= 3 AND _syllables < 0.62D AND _solid > 9 OR _n_han >= 5 AND _n_han >= 0.5D * _letters",
        "v_foreign_words": f"_maybe_foreign AND regexp_like(_f, {_q(_word(NEVER_VIETNAMESE))}) AND regexp_count(_f, {_q(_word(FOREIGN_WORDS))}) >= 0.15D * _n_words",
        "v_script": r"_n_han >= 5 AND _n_han >= 0.5D * _letters OR _maybe_foreign AND _letters > 0 AND length(regexp_replace(_a, '[^\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}\\p{IsThai}\\p{IsCyrillic}\\p{IsArabic}]', '')) >= 0.2D * _letters",
        "v_no_marks_foreign": "_maybe_foreign AND _n_words >= 3 AND _syllables < 0.8D AND _n_marks = 0",
        "v_short": r"_open_end AND _n_han = 0 AND length(_s) >= 12 AND _blanks < 0.55D * length(regexp_replace(_s, '[^\\p{IsHan}]+', ''))",
        "v_open_quote": "_open_end AND length(replace(_a, '”', '')) - length(replace(_a, '“', '')) > 0",
    }
    return sized.select(*key, *[F.expr(f"CAST(coalesce({e}, false) AS INT)").alias(v) for v, e in yes.items()])


def all_votes(values: DataFrame, keys: list[str], counts: DataFrame | None) -> DataFrame:
    """One row per row of ``values`` (``keys``, ``src``, ``value`` and, if it is at hand, the regular form ``regular``) with every
    vote; those by the final trigram go by ``counts`` (None: they vote nowhere)."""
    if "regular" in values.columns:
        out = votes(values, keys, "src", "regular")
    else:
        out = votes(regularize(values.select(*keys, "src", "value"), more=_glance()), keys, "src", "regular")
    if counts is None:
        return out.withColumns({v: F.lit(0) for v in ("v_cut_trigram", "v_seldom_ends", "v_broken_word")})
    ends = truncation.final_shares(values.select(F.struct(*keys).alias("_id"), "value"), "_id", "value", counts)
    both = {"v_cut_trigram": F.col("share") < truncation.NEVER_ENDS, "v_seldom_ends": F.col("share") < truncation.SELDOM_ENDS, "v_broken_word": F.col("broken")}
    found = ends.select("_id.*", *[v.cast("int").alias(k) for k, v in both.items()]).where("v_seldom_ends + v_broken_word > 0")
    return out.join(found, keys, "left").withColumns({v: F.coalesce(v, F.lit(0)) for v in both})


# Validation cases, of other wording than the lists above.
REFUSALS = (
    "Tôi e rằng mình không thể chuyển câu này sang tiếng Việt vào lúc này.", "Nội dung trên vi phạm quy định nên hệ thống từ chối xử lý.", "Thành thật xin lỗi, phần này tôi chưa thể dịch giúp bạn.",
    "I'm afraid I won't be able to help with that passage.", "As a language model I have to decline this request.", "We regret that the text could not be processed.", "很遗憾，这段内容我不便翻译。", "该请求不符合规定，系统无法处理。",
)
OTHERS = (
    "Officials said on Monday that the harbour office will hire {n} new workers before winter.", "Selon la mairie, le musée a accueilli {n} visiteurs pendant les vacances.", "Nach Angaben der Polizei wurden {n} Fahrzeuge an der Brücke kontrolliert.",
    "Según el alcalde, la biblioteca abrió {n} salas nuevas para los estudiantes.", "Menurut pejabat setempat, rumah sakit itu telah menerima {n} pasien baru.", "По словам мэра, новый мост откроют через {n} дней.", "市立図書館は来月から{n}冊の本を貸し出します。", "시립 도서관은 다음 달부터 책 {n}권을 빌려줍니다.",
)


def planted(clean: DataFrame, key: str, source: str, answer: str) -> DataFrame:
    """Validation cases (``case``, ``truth``, ``src``, ``value``): each clean pair as it is, without its final mark, and once with
    every defect that can be made by rule."""
    pick = lambda texts: f"element_at(array({', '.join(_q(t) for t in texts)}), 1 + pmod(hash({key}), {len(texts)}))"
    made = {
        "none": answer, "open": rf"regexp_replace({answer}, '[\\p{{P}}\\s]+$', '')", "empty": pick(("  ", "--", "N.A.", "(null)", "…")), "copy": source,
        "truncated": f"substring({answer}, 1, CAST(length({answer}) * (0.35 + pmod(hash({key}), 40) / 100.0) AS INT))",
        "other_language": f"replace({pick(OTHERS)}, '{{n}}', CAST(pmod(hash({answer}), 90) AS STRING))",
        "refusal": pick(REFUSALS),
    }
    pieces = ", ".join(f"'{d}', {e}" for d, e in made.items())
    cases = clean.selectExpr(f"`{key}`", f"`{source}` AS src", f"stack({len(made)}, {pieces}) AS (truth, value)")
    return cases.selectExpr(f"concat(`{key}`, ':', truth) AS case", "truth", "src", "value")


def label_values(values: DataFrame, keys: list[str], clean: DataFrame | None, counts: DataFrame | None) -> DataFrame:
    """(``keys``, ``labels``, ``posteriors``): every label of an answer whose posterior exceeds its validated cutoff.

    ``values`` holds the keys, ``src``, ``value`` and, if it is at hand, its regular form ``regular``. ``clean`` (columns ``item_id``, ``src``,
    ``value`` of sound pairs) validates the cutoffs; without it they are 0.5. ``counts`` are the trigram counts of the corpus
    (see truncation); without them no answer is ``truncated``. Answers without any label come out with an empty array.
    """
    voted = all_votes(values, keys, counts).persist()
    asked = {d: VOTES[d] for d in DEFECTS if counts is not None or d != "truncated"}
    cutoffs, judged = dict.fromkeys(DEFECTS, 0.5), {}
    if clean is not None:
        cases = planted(clean, "item_id", "src", "value")
        checked = all_votes(cases.select("case", "src", "value"), ["case"], counts).join(cases.select("case", "truth"), "case")
        for d, (patterns, truth, n) in label_model.judged_patterns(checked, asked, "truth").items():
            some = np.isin(truth, (d, "none", "open"))  # a case made for another defect may have this one as well
            if (truth == d).any() and (truth == "none").any():
                judged[d] = (patterns[some], truth[some] == d, n[some])
    tables = {d: label_model.fit(*some, known=label_model.rates(*judged[d]) if d in judged else None) for d, some in label_model.vote_patterns(voted, asked).items()}
    for d, (patterns, truth, n) in judged.items():
        scores = np.array([tables[d].get(tuple(int(x) for x in p), 0.0) for p in patterns])
        cutoffs[d] = label_model.best_cutoff(scores, truth, n)
    post = voted.select(*keys, *[label_model.posterior(VOTES[d], t).alias(d) for d, t in tables.items()])
    labels = F.array_compact(F.array(*[F.when(F.col(d) > cutoffs[d], F.lit(d)) for d in tables]))
    return post.select(*keys, labels.alias("labels"), F.struct(*tables).alias("posteriors"))
