"""Encoding with a public byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece of text exactly one token can stand last in its encoding. The table of these last
tokens is filled from left to right: a token that ends at a prefix is its last one if the pair of it and the last token
of the prefix before it is one the merges keep apart. The encoding is read off backwards. Since a prefix's entry depends
on nothing after it, text can be appended exactly, and after an edit only the pieces it touches are encoded again.

Null and empty texts give an empty list; blank texts are encoded as they are. Texts of any length take linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: How the tokenizer's own rules cut text into pieces that are merged on their own (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """The vocabulary, and the table of last tokens of byte prefixes."""

    def __init__(self, vocabulary: str | bytes, pattern: str = PATTERN):
        """``vocabulary``: the path of a vocabulary file, or what is in it."""
        import regex

        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as file:
                vocabulary = file.read()
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes = {n: b for b, n in self.rank.items()}
        self.longest = max(map(len, self.rank))
        #: All beginnings of tokens: where none goes on, no longer token starts.
        self.starts = {b[:k] for b in self.rank for k in range(1, len(b) + 1)}
        self.split = regex.compile(pattern).findall
        self.pieces = regex.compile(pattern).finditer
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def _merge(self, raw: bytes) -> list[int]:
        """Plain merging by rank, for the short strings of one or two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _stands(self, left: int | None, token: int) -> bool:
        """Whether merging leaves ``token`` whole, alone or after ``left``."""
        if left is None:
            if (ok := self.whole.get(token)) is None:
                ok = self.whole[token] = self._merge(self.bytes[token]) == [token]
            return ok
        if (ok := self.apart.get((left, token))) is None:
            if len(self.apart) > 2_000_000:  # a memory, emptied when full
                self.apart.clear()
            ok = self.apart[left, token] = self._merge(self.bytes[left] + self.bytes[token]) == [left, token]
        return ok

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Continues the table: ``last[i]`` is the last token of the prefix of i + 1 bytes; those present stay.

        Tokens are followed from every start as far as they go on; a prefix's last token is the longest that stands there.
        """
        rank, starts, stands, n, done = self.rank, self.starts, self._stands, len(raw), len(last)
        last += [None] * (n - done)
        for start in range(max(0, done - self.longest + 1), n):
            left = last[start - 1] if start else None
            for end in range(start + 1, n + 1):
                part = raw[start:end]
                if part not in starts:
                    break
                if end > done and last[end - 1] is None and (token := rank.get(part)) is not None and stands(left, token):
                    last[end - 1] = token
            if last[start] is None:
                raise ValueError(f"no token ends at byte {start + 1}")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding that the table stands for."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes[token])
        return out[::-1]

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            raw = text.encode("utf-8", "replace")
            whole = self.rank.get(raw)
            ids = [whole] if whole is not None and self._stands(None, whole) else self.read(self.extend(raw, []))
            if len(text) < 40:
                if len(self.known) > 300_000:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known.get
        for piece in self.split(text or ""):
            out += known(piece) or self.piece(piece)
        return out

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """The encoding of ``text + more`` from that of ``text``: only its last two pieces are looked at again."""
        return self.edit(text, ids, len(text), len(text), more)

    def edit(self, text: str, ids: list[int], start: int, end: int, new: str) -> list[int]:
        """The encoding after ``text[start:end]`` became ``new``; pieces before the edit keep their tokens, and so do those
        after it as soon as piece borders agree again."""
        spans = [m.span() for m in self.pieces(text)]
        counts = [len(self.piece(text[a:b])) for a, b in spans]
        keep = max(0, sum(1 for a, b in spans if b <= start) - 2)
        done, at = spans[keep][0] if keep < len(spans) else 0, sum(counts[:keep])
        changed = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        old = {a + shift: i for i, (a, b) in enumerate(spans) if a >= end}
        out = ids[:at]
        for m in self.pieces(changed, done):
            if (i := old.get(m.start())) is not None and i + 1 < len(spans) and spans[i][1] + shift == m.end() and m.start() > start + len(new):
                return out + ids[sum(counts[:i]) :]
            out += self.piece(m[0])
        return out


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(``key``, ``ids``): one row per row of ``docs``. A map without shuffle; the vocabulary (its size is fixed) is read on
    the driver and broadcast, so executors need no file."""
    with open(f"{folder}/{name}", "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids ARRAY<INT>")
