"""Byte-level BPE by a contiguous rank array.

A word is held as a contiguous list of parts, with the merge rank of every adjacent pair in a second list of the same
order.  The smallest rank is searched by a scan, its boundary is deleted, and the two ranks beside it are refreshed.
Words are short, so the scans are cheaper than a heap; a word of over ``LONG_WORD`` bytes (one run of letters without a
blank) has its merges drawn from a heap over linked parts instead, which gives the same ids in n log n.  Many new words
at once lie in a matrix of parts and one of ranks, a word in each row, and a step takes one merge of every row.

Defined cases: a null text counts as the empty text (no ids, decoded as ""); special tokens in a text get their own id,
as the tokenizers library does it; columns besides the text pass through, and columns that have the names of the
results are replaced; equal texts give equal ids; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedgewren.llm.common import Cache, with_columns

LONG_WORD = 400
#: Entries of a worker's word cache (some 250 bytes each).
CACHE_WORDS = 200_000
NO_RANK = 1 << 40
#: Widths, in bytes, of the matrices in which many words are merged at once; longer words are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 40)


def _ranges(first: str, last: int) -> str:
    """Character class body of the code points up to ``last`` whose category starts with ``first``."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: White space as the Unicode property has it (Python's own \s also takes U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=2)
def word_pattern(last: int) -> re.Pattern:
    """The pre-tokenizer's pattern over code points up to ``last``; smaller classes match faster."""
    letter, number = _ranges("L", last), _ranges("N", last)
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 as it is, all others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file; ``source`` is the text of its JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        back = {s: b for b, s in byte_symbols().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self._of_byte, self._made = np.array(self.of_byte), np.array(self.made)
        pairs = sorted(self.pairs.items())  # with one that no pair equals at the end
        self._keys, self._ranks = np.array([*(k for k, _ in pairs), 1 << 62]), np.array([*(r for _, r in pairs), NO_RANK])
        self.cache = Cache(self.word, CACHE_WORDS)

    def merged(self, ids: list[int]) -> list[int]:
        if len(ids) > LONG_WORD:
            return self._merged_long(ids)
        rank_of, made, n = self.pairs.get, self.made, len(ids) - 1
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while n > 0:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            new = ids[i] = made[least]
            del ids[i + 1]
            del ranks[i]
            n -= 1
            if i < n:
                ranks[i] = rank_of(new << 20 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 20 | new, NO_RANK)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        rank_of, made, n = self.pairs.get, self.made, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        return np.array(self.merged([self.of_byte[b] for b in word.encode()]), "<u4").tobytes()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], NO_RANK)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as word() gives them, merged in steps that take one merge of every word."""
        coded, out = [w.encode() for w in words], [b""] * len(words)
        sizes = np.array([len(x) for x in coded], np.int64)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(at):
                continue
            held = b"".join(coded[i].ljust(width, b"\0") for i in at.tolist())
            ids = self._of_byte[np.frombuffer(held, np.uint8).reshape(-1, width)]
            ids[np.arange(width) >= sizes[at][:, None]] = -1  # no part, and in no pair
            merged, n = self._merged_rows(ids)
            raw = merged.astype("<u4").tobytes()
            for i, k, m in zip(at.tolist(), range(0, len(raw), 4 * width), n.tolist()):
                out[i] = raw[k : k + 4 * m]
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = self.word(words[i])
        return out

    def _merged_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's parts after all its merges, and their number."""
        out, row = np.full(ids.shape, -1, np.int64), np.arange(len(ids))
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while ranks.shape[1] and len(row):
            i = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), i]
            over = least == NO_RANK
            if over.any():
                out[row[over], : ids.shape[1]] = ids[over]
                row, ids, ranks, i, least = (x[~over] for x in (row, ids, ranks, i, least))
                if not len(row):
                    break
            each, column = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[each, i] = new = self._made[least]
            ids = np.take_along_axis(ids, column + (column > i[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= i[:, None]), axis=1)
            k = np.flatnonzero(i < ranks.shape[1])
            ranks[k, i[k]] = self._rank(new[k], ids[k, i[k] + 1])
            k = np.flatnonzero(i > 0)
            ranks[k, i[k] - 1] = self._rank(ids[k, i[k] - 1], new[k])
        out[row, : ids.shape[1]] = ids
        return out, (out >= 0).sum(axis=1)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in which special tokens are plain text; new words are merged together."""
        cut = [self._cut(t) for t in texts]
        new = self.cache.lacking(set().union(*cut))
        self.cache.update(zip(new, self.words(new)))
        return [b"".join(map(self.cache.__getitem__, ws)) for ws in cut]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.split and any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split.split(text))
        return self._plain(text)

    def _cut(self, text: str) -> list[str]:
        last = 0x7F if text.isascii() else 0xFFFF if max(text, default="") <= "￿" else 0x10FFFF
        return word_pattern_of(last).findall(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self._cut(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_PATTERNS: dict[int, re.Pattern] = {}


def word_pattern_of(last: int) -> re.Pattern:
    if last not in _PATTERNS:
        _PATTERNS[last] = word_pattern(last)
    return _PATTERNS[last]


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each Python worker and tokenizer file."""
    source = shared.value
    key = hash(source)
    if key not in _CODECS:
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def _shared(df: DataFrame, tokenizer: str):
    """The tokenizer file (some 1.5 MB, of a fixed size) as a broadcast, so executors need no copy of it."""
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Append the ids of each text (binary, little-endian unsigned 32-bit integers) and their number."""
    shared = _shared(docs, tokenizer)
    at = docs.columns.index(text)
    if text.lower() in (ids.lower(), count.lower()):
        raise ValueError("the text column and the result columns need different names")
    place = [c for c in docs.columns if c.lower() not in (ids.lower(), count.lower())].index(docs.columns[at])

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared)
        found = [codec.encode(x) if x else b"" for x in (v.as_py() for v in batch.column(place))]
        return [pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())]

    return with_columns(docs, f, [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])


def decode(docs: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded_text") -> DataFrame:
    """Append the text that ids stand for; special tokens are kept, null ids give the empty text."""
    shared = _shared(docs, tokenizer)
    place = [c for c in docs.columns if c.lower() != text.lower()].index(ids)

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared)
        return [pa.array([codec.decode(x.as_py() or b"") for x in batch.column(place)], pa.string())]

    return with_columns(docs, f, [T.StructField(text, T.StringType())])
