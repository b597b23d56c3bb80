"""Abusive, hateful or sexual content: sentence scores combined by noisy-or, learned from document labels.

A document is a bag of sentences; it is toxic if at least one sentence is. A logistic model over sentence features is
fitted so that the noisy-or of the sentence probabilities agrees with the documents' labels (multiple-instance
learning); applied to a corpus it scores every document and points to the offending sentences.

Spellings are undone before features are made: invisible characters, look-alike and wide letters, dots or blanks
between single letters, digits for letters, stretched letters, missing marks and capitals. Words inside quotation marks
make features of their own, so that quoted rudeness can be told from rudeness.

Null and empty texts score 0 and have no offending sentence. Every sentence of a text counts, however long it is; the
fit takes at most ``MAX_LABELLED`` labelled rows, everything else runs over all rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmeta.llm.confusables import ARMENIAN, COMPAT, CYRILLIC, GREEK, INVISIBLE

MAX_LABELLED = 20_000
#: A sentence is pointed out from this probability on.
LOCATED = 0.3
WIDTH = 1 << 15

# Words and phrases by kind, without marks; those of one kind share a feature.
KINDS = {
    "insult": (
        "do ngu|thang ngu|con ngu|ngu nhu|ngu ngoc|thang khon|do khon|khon nan|oc cho|cho ma|cho de|do cho|thang cho|con lon|do lon|suc vat|mat day|vo hoc|rac ruoi|thang dien"
        "|con dien|do dien|an hai|vo lai|vo dung|ha dang|hen ha|do hen|mat lon|mat day nhu thot|do di|con di|cho chet|do te|dan don|thieu nao|than kinh|benh hoan|lu ngu|do bo|ngu xuan|do vo|hang tam"
        "|idiot|moron|stupid|bitch|bastard|cretin|loser|trash|garbage|scum|creep|brainless|worthless|pathetic|dumb|retard|imbecile|dumbass|asshole|jerk|pig|dog shit|coward|disgusting|clown|fool|ugly"
        "|傻逼|傻b|傻子|白痴|蠢货|蠢猪|废物|垃圾|狗屎|王八蛋|王八|贱人|贱货|混蛋|畜生|脑残|智障|弱智|猪脑|头猪|脑子进水|脑子有病|狗东西|人渣|败类|杂种|狗娘|贱种|窝囊废|神经病|二百五|饭桶"
    ),
    "curse": (
        "dm|dmm|dit me|dit|du ma|deo|lon|cac|buoi|vai lon|cai lon|me may|bo may|cha may|tien su|cut|cut ngay|cut di|cut xeo|bien di|cam mom|cam hong|khuat mat"
        "|fuck|fucking|fucker|fuck off|shit|damn you|shut up|get lost|screw you|go to hell|piece of shit|your mother"
        "|他妈的|他妈|你妈|妈的|操你|日你|草泥马|滚|滚出去|滚开|闭嘴|放屁|去你的|狗日的|尼玛"
    ),
    "threat": (
        "dap vo mat|dap chet|danh chet|danh cho chua|giet|chem chet|chem|nho vao mat|chet di|chet quach|chet sach|chet het|bop co|dot nha|chat dat|song chi to|cho may biet tay|no phang|tat vo|be gay|xien"
        "|kill yourself|kill you|break your|smash your|beat you|should be beaten|should die|drop dead|hope you die|hurt you|punch you|know where you|burn you|wipe them out|wiped out|just disappear|nobody wants you|hang yourself|shoot you|cut your"
        "|去死|打死|杀了你|弄死|死光|死全家|打你|揍你|砍死|见你一次|不得好死|不配活|割了|掐死|该死"
    ),
    "hate": (
        "loai sau bo|sau bo|ky sinh|giong ay|chung no la|toan con|tong co|duoi co|duoi het|ban thiu|trom cap|khong bang con vat|mang ro|man ro|do mat nuoc|truy sat|diet chung|ha dang|lu moi|bon moi|quet sach|hang ha cap|loai ky sinh|khinh"
        "|vermin|parasite|parasites|subhuman|thrown out|go back to|dirty thieves|filthy|are all thieves|infest|inferior|animals|cockroach|savages|do not belong|exterminate|not human|lower race|keep them out|steal"
        "|寄生虫|赶走|低贱|不配|恶心|又脏又|爱偷|偷东西|劣等|害虫|蛮子|野蛮|滚回|不要让他们|不是人|下等|种人|灭绝|清除|臭虫"
    ),
    "sexual": (
        "khoa than|phim sex|sex|lam tinh|tran truong|coi het|lot do|suong ca|gai dam|dam|khong che|chieu khach|nung|len giuong|so khap|liem|bu|vu to|anh nong|mong con|nguc|nguc voi mong|moi tu the|dit nhau|ngu voi anh|thoa man|cuc khoai|thu dam|do lot|quan lot|them"
        "|nude|naked|porn|sex|sexy|hard cock|cock|dick|pussy|blowjob|suck my|ride me|touch you all|strip for|take off your clothes|horny|wet for|lick|tits|boobs|bedroom|orgasm|cum|hot girls|panties|moan|in bed"
        "|裸照|脱光|脱掉|内裤|舔|陪我睡|爽|色情|做爱|赤裸|无码|摸遍|性交|上床|奶子|骚货|约炮|床上|揉|高潮|裸体|淫|胸"
    ),
    "address": "may|tao|bon may|chung may|bon chung may|thang|con mu|lao|tui bay|bon no|em gai|baby|sweetie|you|your|you are|yourself|你|你们|你全家|宝贝|那些人|那帮|bon|lu|dam|people from|those|族人|信徒|全是|都是",
    "report": (
        "bi goi la|mang la|bi mang|tu dien|nhan vat|ban goc|tieu thuyet|nhom dich|huong dan gan nhan|xuc pham|hoi dong|ky luat|ke tung|bai bao|canh sat|giao duc|bao tang|benh|trung bay|tho|cau chui|bi phat|bao cao|phan dien|phim|gioi tinh|vet can|ngu cong|chan nuoi|trai lon"
        "|villain|novel|calls him|translator|softened|dictionary|label guide|counts as|education|police|report|museum|ancient|health|farm|collection|quoted|means|death toll"
        "|小说|被骂|译者|建议|词典|标注|举报|课程|报道|教育|遇难|调查|分类|辱骂|警方|博物馆|解释|指南|处罚|健康"
    ),
}
_TERMS: dict[str, tuple[str, ...]] = {}
for _kind, _list in KINDS.items():
    for _term in _list.split("|"):
        for _form in {_term, _term.replace(" ", "")} if len(_term) > 5 else {_term}:  # also written in one
            _TERMS[_form] = (*_TERMS.get(_form, ()), _kind)
_STARTS = {k.split(" ")[0] for k in _TERMS if " " in k} | {k[0] for k in _TERMS if not k[0].isascii()}
_FIRST = _STARTS | _TERMS.keys()
_LONGEST = 5  # words of a phrase, or Han letters

_VIEW = {ord(ch): None for ch in INVISIBLE}
_VIEW |= {ord(a): b for t in (CYRILLIC, GREEK, ARMENIAN, COMPAT) for a, b in zip(*t)}
_VIEW |= {0x200D: None}
_DROP = {ord(c): None for c in INVISIBLE}


def _class(points: list[int]) -> str:
    """A character class of the code points, as ranges."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "[" + "".join(out) + "]"


# Most sentences have nothing of these; one search is cheaper than the work they stand for. Classes within the first plane
# are tables, beyond it lists of ranges, so the two are apart.
_VIEWED = re.compile(_class([c for c in sorted(_VIEW) if c < 0x10000]))
_DROPPED = re.compile(_class(sorted(_DROP)))
_MARKS, _FAR_MARKS = (re.compile(_class([c for c in range(*r) if unicodedata.combining(chr(c))]) + "+") for r in ((0x300, 0x10000), (0x10000, 0x1F000)))
_FAR = re.compile("[\U00010000-\U0010ffff]")
_LEET = str.maketrans("013457@$", "oieastas")
_LEET_SIGN = re.compile(r"[013457@$][^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1{2,}")
_NO_LETTER = re.compile(r"\W")
_WORDS = re.compile(r"[a-z]+").findall
_HAN = re.compile(r"[一-鿿]")
_NOT_HAN = re.compile(r"[^一-鿿a-z0-9]+")
_INNER_DOT = re.compile(r"(?<=\w)\.(?=\w)")
_PARTS = re.compile(r"[^.!?。！？…\n]+[.!?。！？…]*[”’\"')）]*").findall
_CHAIN = re.compile(r"(?<!\w)(?:[^\W\d_][.\-*_·~|/ ]){2,}[^\W\d_](?!\w)")
_HAN_DOTS = re.compile(r"(?<=[一-鿿])[.\-*_·~|/＊](?=[一-鿿])")
_MASKED = re.compile(r"(?<!\*)\b[^\W\d_]\*+(?!\w{3})|[一-鿿]\*+")
_LEETED = re.compile(r"\b(?=\w*[^\W\d_]\w*[013457@$]+[^\W\d_])[\w@$]+\b")
_QUOTED = re.compile(r"[“\"‘«「『][^”\"’»」』]{1,60}[”\"’»」』]")
_QUOTE = re.compile(r"[“\"‘«「『]")


def view(text: str) -> str:
    """The text without marks, capitals and spelling tricks."""
    foreign = not text.isascii()
    if foreign:
        far = _FAR.search(text)
        if far or _VIEWED.search(text):
            text = text.translate(_VIEW)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.replace("đ", "d").replace("Đ", "d")).lower())
        if far:
            text = _FAR_MARKS.sub("", text)
    else:
        text = text.lower()
    text = _TRIPLE.sub(r"\1", text)
    text = _CHAIN.sub(lambda m: _NO_LETTER.sub("", m[0]), text)
    if foreign:
        text = _HAN_DOTS.sub("", text)
    return _LEETED.sub(lambda m: m[0].translate(_LEET), text) if _LEET_SIGN.search(text) else text


def sentences(text: str) -> list[str]:
    """Sentences by marks and line ends. A dot inside a chain of single letters ends none."""
    held = _CHAIN.sub(lambda m: m[0].replace(".", "·"), text.translate(_DROP) if _DROPPED.search(text) else text)
    return [t for s in _PARTS(_INNER_DOT.sub("·", held)) if (t := s.strip())]


def _h(name: str) -> int:
    return zlib.crc32(name.encode("utf-8")) % WIDTH


class _Numbers:
    """Feature numbers of words, pairs of words and Han grams met so far; emptied when full."""

    def __init__(self, mark: str):
        self.mark, self.words, self.pairs = mark, {}, {}

    def of(self, words: list[str]) -> list[int]:
        known, mark = self.words, self.mark
        if len(known) > 400_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = _h(mark + w)
        return [known[w] for w in words]

    def of_pairs(self, words: list[str]) -> list[int]:
        known, mark = self.pairs, self.mark
        if len(known) > 400_000:
            known.clear()
        pairs = list(zip(words, words[1:]))
        for p in pairs:
            if p not in known:
                known[p] = _h(f"{mark}{p[0]} {p[1]}")
        return [known[p] for p in pairs]


_NUMBERS = {mark: _Numbers(mark) for mark in ("", "q:")}


def _kinds(units: list[str] | str, sep: str, hits: dict[str, int]) -> None:
    for i in [i for i, unit in enumerate(units) if unit in _FIRST]:
        unit = units[i]
        for kind in _TERMS.get(unit, ()):
            hits[kind] = hits.get(kind, 0) + 1
        if unit in _STARTS:
            for k in range(2, min(_LONGEST, len(units) - i) + 1):
                for kind in _TERMS.get(sep.join(units[i : i + k]), ()):
                    hits[kind] = hits.get(kind, 0) + 1


_LONE = re.compile(r"(?<!\w)[^\W\d_](?!\w)")
_PIECES: dict[str, tuple[list[str], int]] = {}


def _piece(token: str) -> tuple[list[str], int]:
    """Of a blank-separated piece of a sentence: its words, and 1 if a single letter stands alone in it, 2 if its view has
    Han letters. Pieces met before are remembered."""
    if len(_PIECES) > 200_000:  # emptied when full
        _PIECES.clear()
    plain = view(token)
    known = _PIECES[token] = _WORDS(plain), 2 if _HAN.search(plain) else 1 if _LONE.search(plain) else 0
    return known


def _units(sentence: str) -> list[tuple[str, list[str], str]]:
    """(mark, words, Han string) of the sentence, and of what stands in quotation marks.

    Views of pieces side by side are the view of the sentence, but for letters spaced out over neighbouring pieces and for
    quotations; sentences with either, and those in Han letters, are viewed whole.
    """
    if not _HAN.search(sentence) and not _QUOTE.search(sentence):
        known = _PIECES.get
        pieces = [known(t) or _piece(t) for t in sentence.split()]
        kinds = [k for _, k in pieces]
        if 2 not in kinds and (1 not in kinds or not any(a and b for a, b in zip(kinds, kinds[1:]))):
            return [("", [w for words, _ in pieces for w in words], "")]
    plain = view(sentence)
    parts = [("", plain)]
    if _QUOTE.search(plain):
        parts = [("", _QUOTED.sub(" ", plain)), ("q:", " ".join(_QUOTED.findall(plain)))]
    return [(mark, _WORDS(part), _NOT_HAN.sub("", part) if _HAN.search(part) else "") for mark, part in parts if part]


def features(sentence: str) -> dict[int, float]:
    out: dict[int, float] = {}
    kinds: set[str] = set()
    for mark, words, han in _units(sentence):
        numbers = _NUMBERS[mark]
        hits: dict[str, int] = {}
        _kinds(words, " ", hits)
        if han:
            _kinds(han, "", hits)
        for kind, n in hits.items():
            out[_h(f"{mark}kind:{kind}")] = 1.0 + 0.5 * min(n - 1, 3)
        out.update(dict.fromkeys(numbers.of(words), 0.5))
        out.update(dict.fromkeys(numbers.of_pairs(words), 0.7))
        if han:
            out.update(dict.fromkeys(numbers.of([han[i : i + k] for k in (2, 3) for i in range(len(han) - k + 1)]), 0.5))
        if not mark:
            kinds = set(hits)
    if len(kinds) > 1:
        both = [k for k in KINDS if k in kinds]
        for i, a in enumerate(both):
            for b in both[i + 1 :]:
                out[_h(f"both:{a} {b}")] = 1.0
    if "*" in sentence and _MASKED.search(sentence):
        out[_h("masked")] = 2.0
    if _CHAIN.search(sentence) or _LEET_SIGN.search(usual := unicodedata.normalize("NFKC", sentence)) and _LEETED.search(usual):
        out[_h("tricked")] = 0.7
    return out


def fit(texts: list[str], labels: list[int], rounds: int = 2) -> tuple[np.ndarray, float, float]:
    """Weights, bias, and the documents' cutoff. A few labels may be wrong: documents that models fitted without them
    contradict firmly are left out of the last fit. The cutoff is the best by F1 on scores of models that didn't see the
    document."""
    bags = [[features(s) for s in sentences(t)] for t in texts]
    y = np.asarray(labels, dtype=float)
    keep = np.ones(len(y), dtype=bool)
    part = np.arange(len(y)) % 5
    outside, located = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds - 1):
        for k in range(5):
            some = np.flatnonzero(part != k)
            w, b = _ascend([bags[i] for i in some], y[some])
            for i in np.flatnonzero(part == k):
                p = _probabilities(bags[i], w, b)
                outside[i], located[i] = noisy_or(p), noisy_or(p[p > LOCATED])
        keep = np.abs(outside - y) < 0.75
    some = np.flatnonzero(keep)
    return *_ascend([bags[i] for i in some], y[some]), _cutoff(located[keep], y[keep] > 0.5)


def _cutoff(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cutoff with the highest F1; of equals, the one nearest LOCATED."""
    best = (0.0, -1.0, LOCATED)
    for c in np.linspace(0.05, 0.95, 19):
        said = scores > c
        f1 = 2 * float((said & truth).sum()) / max(1.0, float(said.sum() + truth.sum()))
        best = max(best, (round(f1, 9), -abs(c - LOCATED), float(c)))
    return best[2]


def _probabilities(bag: list[dict[int, float]], w: np.ndarray, b: float) -> np.ndarray:
    z = np.array([b + sum(w[k] * v for k, v in f.items()) for f in bag])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return 1 - float(np.prod(1 - p))


def _ascend(bags: list[list[dict[int, float]]], labels: np.ndarray, steps: int = 250, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Gradient ascent (Adam) on the noisy-or likelihood of the documents."""
    rows = [(d, f) for d, fs in enumerate(bags) for f in fs]
    owner = np.array([d for d, _ in rows], dtype=np.int64)
    r = np.array([i for i, (_, f) in enumerate(rows) for _ in f], dtype=np.int64)
    c = np.array([k for _, f in rows for k in f], dtype=np.int64)
    x = np.array([v for _, f in rows for v in f.values()], dtype=float)
    y = labels * 0.985 + 0.005
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    w[WIDTH] = -4.0
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=x * w[c], minlength=len(rows)) + w[WIDTH]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)
        doc = np.clip(1 - np.exp(np.bincount(owner, weights=np.log1p(-p), minlength=len(bags))), 1e-6, 1 - 1e-6)
        g = ((y - doc) / doc)[owner] * p
        grad = np.bincount(c, weights=g[r] * x, minlength=WIDTH + 1) / max(1, len(bags))
        grad[WIDTH] = g.sum() / max(1, len(bags))
        grad[:WIDTH] -= decay * w[:WIDTH]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
    return w[:WIDTH], float(w[WIDTH])


def train(labelled: DataFrame, text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float, float]:
    """Fits on at most MAX_LABELLED labelled rows, picked by hash (rows without text or label are left out)."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label).orderBy(F.xxhash64(text), text, label).limit(MAX_LABELLED).collect()
    return fit([r[0] for r in rows], [int(r[1]) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], key: str = "doc_id", text: str = "text", located: float = LOCATED) -> DataFrame:
    """(``key``, ``score``, ``offending``, ``toxic``): the noisy-or of all sentences; those of probability above ``located``, in their
    order; whether the noisy-or of these alone exceeds the model's cutoff (else long documents would add up to one)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tolist(), *model[1:]))  # WIDTH weights
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, cutoff = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            scores, where, toxic = [], [], []
            for t in batch.column(1).to_pylist():
                stay, clean, found = 1.0, 1.0, []
                for s in sentences(t or ""):
                    p = known.get(s)
                    if p is None:
                        z = b + sum([w[k] * v for k, v in features(s).items()])
                        p = 1 / (1 + math.exp(-min(max(z, -30), 30)))
                        if len(known) > 50_000:  # a cache of repeated sentences, emptied when full
                            known.clear()
                        known[s] = p
                    stay *= 1 - p
                    if p > located:
                        clean *= 1 - p
                        found.append(s)
                scores.append(1 - stay)
                where.append(found)
                toxic.append(1 - clean > cutoff)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(where, pa.list_(pa.string())), pa.array(toxic, pa.bool_())], [key, "score", "offending", "toxic"]
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score DOUBLE, offending ARRAY<STRING>, toxic BOOLEAN")
