"""Evaluation texts inside training text, found with a generalised suffix automaton.

The test items are normalised (case, marks, punctuation, spacing and character forms don't count) and put into one
suffix automaton per side: Vietnamese syllables and Chinese characters. Each document is streamed through both; the
automaton keeps the longest match that ends at the current token, and as soon as it is as long as the threshold, the
states on its suffix path name every item that holds the last ``threshold`` tokens or more of it. Spans are merged, and
``strip_leaks`` removes those that exceed a length or coverage limit.

Test items come in blocks of at most BLOCK items; one automaton per block is sent to the executors, so its size is
bounded however many items there are. The corpus is never joined, collected or sent anywhere. Null and empty texts hold
nothing; an item shorter than the threshold can't leak; items of equal text all leak together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmeta.llm.confusables import ARMENIAN, COMPAT, CYRILLIC, GREEK, INVISIBLE

BLOCK, BLOCK_CHARS = 5_000, 4_000_000
MIN_SYLLABLES, MIN_HAN = 12, 14
_MAP = {ord(ch): None for ch in INVISIBLE}
_MAP |= {ord(a): b for t in (CYRILLIC, GREEK, ARMENIAN, COMPAT) for a, b in zip(*t)}
_MAP |= {0x111: "d", 0x110: "d", 0x1B0: "u", 0x1A1: "o", 0xF0: "d", 0xD0: "d", 0x189: "d", 0x256: "d"}
_MARKS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿︠-︯]+")
_SYLLABLE = re.compile(r"[a-z]+|[0-9]+|[一-鿿]")
_HAN = re.compile(r"[一-鿿0-9]|[^\W0-9_]")
_ANY_HAN = re.compile(r"[一-鿿]")


def normal(text: str) -> str:
    """Lower case without marks, joiners and character forms; punctuation is left to the tokeniser."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_MAP)).lower())


def syllables(text: str) -> list[str]:
    return _SYLLABLE.findall(normal(text))


def han_tokens(text: str) -> list[str]:
    """Chinese characters and digits; any other letter stands between."""
    plain = normal(text)
    return _HAN.findall(plain) if _ANY_HAN.search(plain) else []


class Automaton:
    """Generalised suffix automaton over token lists, with the items of the states from ``threshold`` on."""

    def __init__(self, items: list[tuple[int, list[str]]], threshold: int):
        self.threshold = threshold
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, tokens in items:
            last = 0
            for token in tokens:
                last = self._extend(last, token)
        self.items: list[set[int]] = [set() for _ in self.next]
        for item, tokens in items:
            state = 0
            for token in tokens:
                state = self.next[state][token]
                up = state
                while up > 0 and self.length[up] >= threshold and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, token: str, target: int) -> int:
        """A copy of ``target`` for the shorter strings that end in it."""
        copy = self._new(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: str) -> int:
        if token in self.next[last]:  # another item has been here
            there = self.next[last][token]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, token, there)
        new, state = self._new(self.length[last] + 1), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][token]
            self.link[new] = there if self.length[there] == self.length[state] + 1 else self._split(state, token, there)
        return new

    def holders(self, state: int, matched: int) -> Iterator[tuple[int, int]]:
        """(item, tokens) for the items that hold the last ``threshold`` tokens or more of the current match."""
        seen: set[int] = set()
        while self.length[state] >= self.threshold:
            for item in self.items[state] - seen:
                yield item, min(matched, self.length[state])
            seen |= self.items[state]
            state = self.link[state]

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matched length) wherever the last ``threshold`` tokens stand in an item."""
        nxt, link, length, limit = self.next, self.link, self.length, self.threshold
        state = matched = 0
        for i, token in enumerate(tokens):
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(token)
            if to is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= limit:
                yield i, state, matched


class Detector:
    """Both automata of a block of items."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], min_syllables: int = MIN_SYLLABLES, min_han: int = MIN_HAN):
        self.sides = (
            (syllables, Automaton([(i, syllables(vi)) for i, vi, _ in items if vi], min_syllables)),
            (han_tokens, Automaton([(i, han_tokens(zh)) for i, _, zh in items if zh], min_han)),
        )

    def find(self, text: str) -> dict[int, int]:
        """The leaked items with their longest match."""
        out: dict[int, int] = {}
        for split, automaton in self.sides:
            for _, state, matched in automaton.matches(split(text)):
                for item, n in automaton.holders(state, matched):
                    if n > out.get(item, 0):
                        out[item] = n
        return out

    def strip(self, text: str, max_tokens: int, max_share: float) -> tuple[str, int]:
        """The text without leaked spans longer than ``max_tokens`` tokens or covering more than ``max_share`` of it."""
        cut: list[tuple[int, int]] = []
        for split, automaton in self.sides:
            tokens, places = [], []
            for m in re.finditer(r"\w+" if split is syllables else r"\w", text):
                for t in split(m[0]) if split is syllables or _ANY_HAN.match(m[0]) or m[0].isdigit() else [m[0].lower()]:
                    tokens.append(t if split is syllables else normal(m[0]))
                    places.append((m.start(), m.end()))
            if split is not syllables and not _ANY_HAN.search(text):
                continue
            spans: list[list[int]] = []
            for i, _, matched in automaton.matches(tokens):
                lo = i - matched + 1
                if spans and lo <= spans[-1][1] + 1:
                    spans[-1][1] = i
                else:
                    spans.append([lo, i])
            for lo, hi in spans:
                if hi - lo + 1 > max_tokens or (hi - lo + 1) > max_share * len(tokens):
                    cut.append((places[lo][0], places[hi][1]))
        removed = 0
        for lo, hi in sorted(cut, reverse=True):
            text, removed = text[:lo] + text[hi:], removed + hi - lo
        return text, removed


def blocks(items: DataFrame, key: str, vi: str, zh: str) -> Iterator[list[tuple[int, str | None, str | None]]]:
    """The items in blocks of at most BLOCK items and BLOCK_CHARS characters; the driver holds one at a time."""
    part: list[tuple[int, str | None, str | None]] = []
    size = 0
    for r in items.where(F.col(key).isNotNull()).select(key, vi, zh).toLocalIterator():
        part.append(tuple(r))
        size += len(r[1] or "") + len(r[2] or "")
        if len(part) == BLOCK or size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", vi: str = "reference_vi", zh: str = "source_zh") -> DataFrame:
    """(``doc_key``, ``item_key``, ``longest``): the items of which each document holds a passage."""
    kinds = {**dict(docs.select(doc_key).dtypes), **dict(items.select(item_key).dtypes)}
    found = None
    for block in blocks(items, item_key, vi, zh):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detector = Detector(shared.value)
            for batch in batches:
                d, it, longest = [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    for item, n in detector.find(t).items() if t else ():
                        d.append(row)
                        it.append(item)
                        longest.append(n)
                keys = batch.column(0).take(pa.array(d, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(it, pa.int64()), pa.array(longest, pa.int32())], [doc_key, item_key, "longest"])

        part = docs.select(doc_key, text).mapInArrow(run, f"`{doc_key}` {kinds[doc_key]}, `{item_key}` BIGINT, longest INT")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{doc_key}` {kinds[doc_key]}, `{item_key}` BIGINT, longest INT")
    return found


def strip_leaks(docs: DataFrame, items: DataFrame, text: str = "text", max_tokens: int = 20, max_share: float = 0.3, item_key: str = "item_id", vi: str = "reference_vi", zh: str = "source_zh") -> DataFrame:
    """``docs`` with leaked spans removed from ``text``, and ``removed_chars``."""
    if "removed_chars" in docs.columns:
        raise ValueError("column in the way: removed_chars")
    out = docs.withColumn("removed_chars", F.lit(0).cast("int"))
    at, n = out.columns.index(text), out.columns.index("removed_chars")
    for block in blocks(items, item_key, vi, zh):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detector = Detector(shared.value)
            for batch in batches:
                done = [(t, 0) if not t else detector.strip(t, max_tokens, max_share) for t in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                columns[n] = pa.array([(a or 0) + b for a, (_, b) in zip(batch.column(n).to_pylist(), done)], pa.int32())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out
