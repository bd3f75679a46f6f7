"""Byte-level BPE encoding of whole corpora (problem 8).

Short pieces: the parts of many words are held in contiguous arrays, one row per
word: part ids, and the rank of every adjacent pair. Repeatedly the row minimum is
scanned for, its boundary is deleted (the rest moves up) and the ranks beside it are
refreshed; rows without a rank leave. All rows of a batch advance together in numpy.
Long pieces (stretches without a break) use a heap over linked parts instead, as
scanning them would be quadratic. Both give the merges in rank order, leftmost first.

A vocabulary is a public file (``token rank`` per line, tokens in base64); nothing is
trained. Each Python worker loads it once and keeps a bounded cache of word -> ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; every function takes the path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenisation pattern that belongs to this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.uint32(2**32 - 1)
SHORT = 40
CACHE = 1_000_000
#: Characters that are encoded at a time, so that a batch of very long texts stays small.
SLICE_CHARS = 4_000_000


class Encoder:
    def __init__(self, path: str):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.find = regex.compile(PATTERN)
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        if max(self.rank.values()) >= 65536:
            raise ValueError("ids must fit into 16 bits")
        pairs = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a = self.rank.get(token[:i])
                if a is not None and (b := self.rank.get(token[i:])) is not None:
                    pairs[a << 16 | b] = r
        self.pairs = pairs
        self.length = {r: len(t) for t, r in self.rank.items()}
        keys = np.fromiter(pairs, np.uint32, len(pairs))
        by = np.argsort(keys)
        self.keys, self.ranks = keys[by], np.fromiter(pairs.values(), np.uint32, len(pairs))[by]
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.uint32)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.uint32(16) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of at least 2 bytes, any mix of lengths."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        width = int(count.max())
        held = np.arange(width) < count[:, None]
        ids = np.zeros((len(words), width), np.uint32)
        ids[held] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        near = np.where(held[:, 1:], self._pair_ranks(ids[:, :-1], ids[:, 1:]), NONE)
        out: list = [None] * len(words)
        row, rows = np.arange(len(words)), np.arange(len(words))
        while True:
            at = near.argmin(axis=1)
            low = near[rows, at]
            over = low == NONE
            if over.any():
                for r, x, n in zip(row[over].tolist(), ids[over].tolist(), count[over].tolist()):
                    out[r] = tuple(x[:n])
                keep = ~over
                row, ids, near, at, low, count = row[keep], ids[keep], near[keep], at[keep], low[keep], count[keep]
                rows = rows[: len(row)]
            if not len(row):
                return out
            n, width = ids.shape
            count -= 1
            ids[rows, at] = low  # the merged token's id is its rank
            if width == 2:
                for r, x in zip(row.tolist(), low.tolist()):
                    out[r] = (x,)
                return out
            stay = np.ones((n, width), bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[rows, at] = False
            near = near[stay].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            near[left, at[left] - 1] = self._pair_ranks(ids[left, at[left] - 1], low[left])
            right = np.flatnonzero(at < count - 1)
            near[right, at[right]] = self._pair_ranks(low[right], ids[right, at[right] + 1])

    def _long(self, word: bytes) -> tuple[int, ...]:
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                prev[k] = i
                if (s := get(r << 16 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := prev[i]) >= 0 and (s := get(ids[h] << 16 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of these words into the cache; best for many at once."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, classes = self.cache, {}
        for w in {w for w in words if w not in cache}:
            raw = w.encode("utf-8", "surrogatepass")
            if (r := self.rank.get(raw)) is not None:
                cache[w] = (r,)
            elif len(raw) > SHORT:
                cache[w] = self._long(raw)
            else:
                ws, rs = classes.setdefault(-(-len(raw) // 10), ([], []))
                ws.append(w)
                rs.append(raw)
        for ws, rs in classes.values():
            cache.update(zip(ws, self._short(rs)))

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """Ids of each pre-token in order."""
        words = self.split(text)
        self.learn(words)
        return list(map(self.cache.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text or "")))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        offsets, parts, todo, chars = [0], [], [], 0
        for i, t in enumerate(texts):
            todo.append(self.split(t) if t else ())
            chars += len(t or "")
            if chars > SLICE_CHARS or i == len(texts) - 1:
                self.learn(w for words in todo for w in words)
                get = self.cache.__getitem__
                for words in todo:
                    ids = list(chain.from_iterable(map(get, words)))
                    parts.append(np.array(ids, np.int32))
                    offsets.append(offsets[-1] + len(ids))
                todo, chars = [], 0
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.array(offsets, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = BYTE_BPE_50K) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``key``, ids array<int>: the token ids of each text without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are
    ordinary text. One row per row of ``df`` in a single pass without a shuffle; other
    columns are ignored, a null key stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                values, offsets = enc.encode_all(some.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``key``, n_tokens int: as ``encode_documents``, the lengths only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                _, offsets = enc.encode_all(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offsets).astype(np.int32))], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
