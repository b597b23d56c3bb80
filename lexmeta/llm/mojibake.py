"""Text that was read with the wrong character encoding: finding it, and giving the original back.

Adjacent characters are scored by their mutual information in a corpus of the same languages; the improbable runs of a
value are isolated as maximum-scoring segments, and only inside those runs inverse mappings are tried (bytes of the
wrong encoding, read again with the right one). A run counts as garbled if a mapping turns it into text that the corpus
knows and that scores better, or if it holds the marks of lost characters. Nested garbling is undone step by step.

Null and empty values are never garbled. Values in other scripts, with look-alikes or invisible characters are
improbable too, but no mapping makes known text of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmeta.llm.charmodel import PairModel, code_points, improbable_runs

# The bytes of the Vietnamese font encoding TCVN 5712 VN3 and their letters.
TCVN3 = dict(
    zip(
        bytes.fromhex(
            "b5b6b7b8b9 a8bbbcbdbec6 a9c7c8c9cacb aea7 cccecfd0d1 aad2d3d4d5d6 d7d8dcddde dfe1e2e3e4"
            "abe5e6e7e8e9 aceaebecedee eff1f2f3f4 adf5f6f7f8f9 fafbfcfdfe a1a2a3a4a5a6"
        ),
        "àảãáạ" "ăằẳẵắặ" "âầẩẫấậ" "đĐ" "èẻẽéẹ" "êềểễếệ" "ìỉĩíị" "òỏõóọ" "ôồổỗốộ" "ơờởỡớợ" "ùủũúụ" "ưừửữứự" "ỳỷỹýỵ" "ĂÂÊÔƠƯ",
    )
)
#: What read the bytes, and what should have. One-byte readers come with the C1 controls where they leave bytes undefined.
ONE_BYTE = ("cp1252", "latin-1", "cp1258", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250")
MULTI_BYTE = ("gbk", "cp950", "cp932", "euc_kr")
RIGHT_OF_ONE_BYTE = ("utf-8", "gbk", "cp950")
LOST = "�"


def _reader_table(name: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


TABLES = {name: _reader_table(name) for name in ONE_BYTE}
ENCODED: dict[str, dict[str, bytes]] = {name: {} for name in MULTI_BYTE}  # characters met so far (at most all there are) and their bytes


def _pieces(run: str, reader: str) -> Iterator[tuple[int, int, bytes]]:
    """The stretches of the run that the reader could have produced, with their bytes."""
    if reader in TABLES:
        table, start, out = TABLES[reader], 0, bytearray()
        for i, ch in enumerate(run):
            b = ord(ch) if ch < "\x80" else table.get(ch)
            if b is None:
                if out:
                    yield start, i, bytes(out)
                out, start = bytearray(), i + 1
            else:
                out.append(b)
        if out:
            yield start, len(run), bytes(out)
        return
    start, out, known = 0, bytearray(), ENCODED[reader]
    for i, ch in enumerate(run):
        if (b := known.get(ch)) is None:
            try:
                b = ch.encode(reader)
            except UnicodeEncodeError:
                b = b""
            known[ch] = b
        if not b:
            if out:
                yield start, i, bytes(out)
            out, start = bytearray(), i + 1
        else:
            out += b
    if out:
        yield start, len(run), bytes(out)


def _decode(raw: bytes, right: str, strict: bool) -> str | None:
    if right == "tcvn3":
        return "".join(chr(b) if b < 128 else TCVN3.get(b, LOST) for b in raw)
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None if strict else raw.decode(right, "replace")


def _tcvn3_evidence(run: str) -> bool:
    """Several marked characters, signs among them: plain Western words have letters only."""
    marked = [ch for ch in run if ch >= "\x80"]
    return len(marked) > 1 and any(not ch.isalpha() and ch != "\xad" and not ch.isspace() for ch in marked)


def _dense(raw: bytes) -> bool:
    """Two-byte text shows as at least four high bytes in a row; a lone accented letter doesn't."""
    high = 0
    for b in raw:
        high = high + 1 if b >= 128 else 0
        if high == 4:
            return True
    return False


def _once_more(text: str) -> str | None:
    if LOST in text or not any("\xc2" <= ch <= "\xf4" for ch in text):
        return None
    for reader in ("cp1252", "latin-1"):
        pieces = list(_pieces(text, reader))
        if len(pieces) == 1 and pieces[0][:2] == (0, len(text)):
            try:
                return pieces[0][2].decode("utf-8")
            except UnicodeDecodeError:
                pass
    return None


def _again(text: str) -> str:
    """Undoes further readings of UTF-8 as Western text, where all of it was read so; each makes the text shorter."""
    while (once := _once_more(text)) is not None:
        text = once
    return text


class Repairer:
    """Inverse mappings, tried inside improbable runs only."""

    def __init__(self, model: PairModel):
        self.model = model

    def _mean(self, text: str) -> float:
        scores = self.model.scores(code_points(text))
        return float(scores.mean()) if len(scores) else 0.0

    def _known(self, text: str) -> tuple[int, float]:
        marked = [ch for ch in text if ch >= "\x80"]
        if not marked:
            return 0, 0.0
        counts = self.model.counts(code_points("".join(marked)))
        return len(marked), float((counts >= self.model.known_from).mean())

    def _try(self, run: str) -> tuple[float, str, str, bool] | None:
        """The best mapping of a run: (gain, restored, name, lossless)."""
        best = None
        was = self._mean(run)
        for reader in (*ONE_BYTE, *MULTI_BYTE):
            if best and best[3] and best[0] > 3:  # nothing lost and known text: the others can't do better
                break
            rights = (*RIGHT_OF_ONE_BYTE, "tcvn3") if reader in ("cp1252", "latin-1") else RIGHT_OF_ONE_BYTE if reader in TABLES else ("utf-8", "gbk")
            pieces = list(_pieces(run, reader))
            for right in rights:
                if right == reader:
                    continue
                out, at, changed, lossless, new = [], 0, False, True, []
                for a, b, raw in pieces:
                    if all(c < 128 for c in raw) or (right in ("gbk", "cp950") and not _dense(raw)):
                        continue
                    text = _decode(raw, right, strict=True)
                    if text is None:
                        text = _decode(raw, right, strict=False)
                        lossless = False
                    if text == run[a:b] or (right == "tcvn3" and not _tcvn3_evidence(run[a:b])):
                        continue
                    if right == "utf-8" and reader in TABLES:
                        text = _again(text)
                    out += [run[at:a], text]
                    new.append(text.replace(LOST, ""))
                    at, changed = b, True
                if not changed:
                    continue
                whole = "".join(out) + run[at:]
                lossless = lossless and LOST not in whole
                decoded = "".join(new)
                n, known = self._known(decoded)
                kept = sum(map(len, new)) / max(1, len(decoded) + sum(t.count(LOST) for t in out))
                if n == 0 or known < 0.85 or kept < 0.5:
                    continue
                gain = self._mean(whole.replace(LOST, "")) - was
                if gain > 0.8 and (best is None or (lossless, gain) > (best[3], best[0])):
                    best = (gain, whole, f"{reader}<-{right}", lossless)
        return best

    def check(self, text: str) -> tuple[str, str, bool] | None:
        """(restored text, mapping, lossless) of a garbled value, or None."""
        names: list[str] = []
        lossless = True
        current = text
        before: set[str] = set()
        while current not in before:  # each round takes one reading back
            before.add(current)
            runs = [r for r in improbable_runs(self.model.scores(code_points(current))) if r[2] >= 3.0]
            fixed = None
            if len(runs) > 1:  # a stretch read wrongly shows as several runs with plain text between
                lo, hi = _widen(current, runs[0][0], runs[-1][1])
                if found := self._try(current[lo:hi]):
                    _, whole, name, ok = found
                    lossless &= ok
                    names.append(name)
                    current = current[:lo] + whole + current[hi:]
                    continue
            widest = len(current) + 1, 0  # several runs may widen to the same stretch, which is tried once
            for a, b, _ in reversed(runs):
                lo, hi = widest if widest[0] <= a and b <= widest[1] else _widen(current, a, b)
                new, widest = (lo, hi) != widest, (lo, hi)
                found = self._try(current[lo:hi]) if new and any(ch >= "\x80" for ch in current[lo:hi]) else None
                if found is None and (lo, hi) != (a, b):
                    found, lo, hi = self._try(current[a:b]), a, b
                if found:
                    _, whole, name, ok = found
                    lossless &= ok
                    fixed = (fixed or current)[:lo] + whole + (fixed or current)[hi:]
                    names.append(name)
            if fixed is None or fixed == current:
                break
            current = fixed
        if names:
            return _match_case(unicodedata.normalize("NFC", current)), names[-1], lossless and LOST not in current
        return (text, "lost", False) if _lost(text) else None


def _widen(text: str, a: int, b: int) -> tuple[int, int]:
    """The run, up to the blanks around it in spaced scripts or the regular Han text around it."""
    stop = lambda ch: ch.isspace() and ch != "\xa0"
    while a > 0 and not stop(text[a - 1]) and not ("一" <= text[a - 1] <= "鿿" and text[a] < "　"):
        a -= 1
    while b < len(text) and not stop(text[b]) and not ("一" <= text[b] <= "鿿" and text[b - 1] < "　"):
        b += 1
    return a, b


def _match_case(text: str) -> str:
    """TCVN3 keeps no upper case of toned letters; a word written in capitals otherwise gets them back."""
    words = text.split(" ")
    for i, w in enumerate(words):
        plain = [ch for ch in w if ch.isascii() and ch.isalpha()]
        if len(plain) > 1 and all(ch.isupper() for ch in plain):
            words[i] = w.upper()
    return " ".join(words)


def _lost(text: str) -> bool:
    """Marks of characters that no mapping gives back: replacement characters, or question marks inside words."""
    if LOST in text:
        return True
    if "??" in text and text.count("?") >= 4:
        return True
    inner = sum(1 for i in range(1, len(text) - 1) if text[i] == "?" and text[i - 1].isalnum() and text[i + 1].isalnum())
    return inner >= 2


def find_garbled(values: DataFrame, models: dict[str, PairModel], keys: list[str]) -> DataFrame:
    """Rows (``keys``, ``field``, ``restored``, ``mapping``, ``lossless``) of the garbled values.

    ``values`` holds the keys, ``field`` (which picks the model) and ``value``; only improbable values reach the
    mappings. The models are broadcast: each is of bounded size (see charmodel).
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast({f: m.state() for f, m in models.items()})
    types = dict(values.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", field STRING, restored STRING, mapping STRING, lossless BOOLEAN"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {f: Repairer(PairModel(*m)) for f, m in shared.value.items()}
        for batch in batches:
            fields, texts = batch.column("field").to_pylist(), batch.column("value").to_pylist()
            hits, found = [], []
            for field, tool in tools.items():
                mine = [i for i, (f, t) in enumerate(zip(fields, texts)) if f == field and t]
                for lo in range(0, len(mine), 1000):
                    some = mine[lo : lo + 1000]
                    points = code_points("\0".join(texts[i] for i in some))
                    scores = tool.model.scores(points)
                    edge = points == 0
                    scores[edge[:-1] | edge[1:]] = 0.0
                    owner = np.cumsum(edge)[:-1]
                    improbable = np.bincount(owner, weights=np.clip(-scores - 0.5, 0, 4), minlength=len(some)) >= 3
                    improbable &= np.bincount(owner, weights=scores <= -4, minlength=len(some)) > 0
                    for k in np.flatnonzero(improbable[: len(some)]).tolist():
                        if got := tool.check(texts[some[k]]):
                            hits.append(some[k])
                            found.append(got)
            out = batch.select(keys).take(pa.array(hits, pa.int64()))
            restored, mapping, lossless = zip(*found) if found else ((), (), ())
            arrays = [pa.array([fields[i] for i in hits], pa.string()), pa.array(restored, pa.string()), pa.array(mapping, pa.string()), pa.array(lossless, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*out.columns, *arrays], [*keys, "field", "restored", "mapping", "lossless"])

    return values.select(*keys, "field", "value").mapInArrow(run, schema)
