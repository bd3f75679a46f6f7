"""Splitting oversized texts at natural boundaries by content-defined chunking (problem 10).

A rolling hash over the pre-tokens (a polynomial of the last ``WINDOW`` of them) has a
value at every place that depends on local content only. A piece may end at natural
boundaries between ``least`` and ``limit`` tokens; the landmark of that span is its
smallest hash value, and the cut snaps to the boundary nearest to it. Spans that
overlap mostly share their landmark, so an edit moves the cuts around it and soon the
cuts fall on the same places again.

A cut at a token border leaves the tokens on both sides as they were (no merge ever
crossed it); only blanks at the end of a piece may join, which is counted afresh.

Boundaries in falling order of rank: headings, paragraphs, turns, lines, sentences;
where a span has none, white space, and in stretches without any break token borders
between whole characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm import bpe

WINDOW = 16
_MIX, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_RULES = (  # where a piece may start, and the rank of such a place
    (r"(?m)^[ \t]{0,3}(?:#{1,6}[ \t]|=+[ \t]*\S.*=+$)", 5),
    (r"\n[ \t\r]*\n\s*", 4),
    (r"(?m)^(?:user|assistant|system|tool|human|ai|q|a)[ \t]*:", 3),
    (r"\r\n?|\n", 2),
    (r"[.!?…](?:[\"'”’)\]]*)\s+|[。！？](?:[”’」』）]*)\s*", 1),
)


class _Cutter:
    def __init__(self):
        self.rules = [(re.compile(p, re.I), r) for p, r in _RULES]

    def ranks(self, text: str, bounds: np.ndarray) -> np.ndarray:
        """Rank of a cut at each of the sorted character offsets ``bounds`` (0: none)."""
        rank = np.zeros(len(bounds), np.int8)
        for rule, r in self.rules:
            at = [m.start() if r in (5, 3) else m.end() for m in rule.finditer(text)]
            if at:
                # a boundary may lie within a pre-token (blanks before a word): the cut comes before that pre-token
                i = np.minimum(np.searchsorted(bounds, at, side="right") - 1, len(bounds) - 1)
                np.maximum.at(rank, i[i >= 0], r)
        return rank


_POWERS = [_MUL ** np.arange(1, dtype=np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd, so invertible) multiplier and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MUL, np.uint64(pow(int(_MUL), -1, 2**64)))):
            x = np.full(2 * n, base)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def landmarks(hashes: np.ndarray) -> np.ndarray:
    """Value of the rolling hash of the last ``WINDOW`` units at each unit."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(hashes))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power)])
    lo = np.maximum(np.arange(len(hashes)) + 1 - WINDOW, 0)
    # divided by the power of its end, so that the value depends on the content of the window, not its place
    value = (total[1:] - total[lo]) * inverse
    value ^= value >> np.uint64(29)
    return value * _MIX


def _blanks(words: list[str], lo: int, hi: int) -> np.ndarray:
    """The units of lo..hi that a blank begins or precedes."""
    return np.array([i for i in range(max(lo, 1), min(hi + 1, len(words))) if words[i][0].isspace() or words[i - 1][-1].isspace()], np.int64)


def cuts(words: list[str], start_token: np.ndarray, rank: np.ndarray, mark: np.ndarray, total: int, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """[(first unit, end unit)] of the pieces over the units ``words`` with token offsets ``start_token`` (one more than units: the total).

    Every piece has at most ``limit`` tokens including what it repeats of the one before.
    White space is looked for only in spans without a boundary of any rank.
    """
    n, out, first, body = len(start_token) - 1, [], 0, 0
    while True:
        begin = start_token[first]
        if total - begin <= limit:
            out.append((first, n))
            return out
        hi = int(np.searchsorted(start_token, begin + limit, side="right")) - 1  # a cut before unit hi at the latest
        lo = max(int(np.searchsorted(start_token, max(begin + least, start_token[body] + 1), side="left")), body + 1)
        lo = min(lo, hi)
        span = rank[lo : hi + 1]
        best = int(span.max()) if len(span) else 0
        # boundaries of the best two ranks there are, else white space, else any unit border
        good = np.flatnonzero(span >= max(best - 1, 1)) + lo if best else _blanks(words, lo, hi)
        if not len(good):
            good = np.arange(lo, hi + 1)
        at = lo + int(mark[lo : hi + 1].argmin())
        end = int(good[np.argmin(np.abs(start_token[good] - start_token[at]))])
        out.append((first, end))
        body = end
        back = start_token[end] - overlap
        first = int(np.searchsorted(start_token, back, side="left")) if overlap else end
        first = max(first, out[-1][0] + 1) if first < end else end
        if overlap and first < end:
            # the repeated part begins at a boundary where there is one in its later half or before
            for inside in (lambda: np.flatnonzero(rank[first:end] > 0) + first, lambda: _blanks(words, first, end - 1)):
                near = inside()
                if len(near) and start_token[end] - start_token[near[0]] >= overlap // 2:
                    first = int(near[0])
                    break


def split_text(text: str, words: list[str], ids: list[tuple[int, ...]], enc: bpe.Encoder, cutter: _Cutter, limit: int, overlap: int, least: int) -> list[tuple[int, int, int, int]]:
    """[(first character, end, tokens, repeated characters)] of the pieces; one if the text fits. ``words`` are its pre-tokens, ``ids`` their tokens."""
    total = sum(map(len, ids))
    if total <= limit:
        return [(0, len(text), total, 0)]
    if max(map(len, ids)) > max(1, least // 8):
        words, ids = _broken(words, ids, enc, max(1, least // 8))
    place = np.fromiter(accumulate(map(len, words), initial=0), np.int64, len(words) + 1)
    starts = np.fromiter(accumulate(map(len, ids), initial=0), np.int64, len(ids) + 1)
    value = landmarks(np.fromiter(map(hash, ids), np.int64, len(ids)).view(np.uint64) * _MIX)
    mark = np.concatenate([[np.uint64(2**64 - 1)], value])
    out, before = [], 0
    for a, b in cuts(words, starts, cutter.ranks(text, place), mark, total, limit, overlap, least):
        lo, hi = int(place[a]), int(place[b])
        n = int(starts[b] - starts[a])
        if text[lo] == "'":  # may now read as a contraction
            n = len(enc.encode(text[lo:hi]))
        elif words[b - 1].isspace():
            e = b
            while e > a and words[e - 1].isspace():
                e -= 1
            n += len(enc.encode(text[int(place[e]) : hi])) - int(starts[b] - starts[e])
        out.append((lo, hi, n, max(0, before - lo)))
        before = hi
    return out


def _broken(words: list[str], ids: list[tuple[int, ...]], enc: bpe.Encoder, most: int) -> tuple[list[str], list[tuple[int, ...]]]:
    """The units where pre-tokens of more than ``most`` tokens are cut at the token borders that lie between whole characters."""
    out_words, out_ids = [], []
    for w, p in zip(words, ids):
        if len(p) <= most:
            out_words.append(w)
            out_ids.append(p)
            continue
        raw = w.encode("utf-8", "surrogatepass")
        chars = at = first = begin = 0
        for k, t in enumerate(p):
            end = at + enc.length[t]
            chars += sum(1 for x in raw[at:end] if x & 0xC0 != 0x80)
            at = end
            if at == len(raw) or raw[at] & 0xC0 != 0x80:
                out_words.append(w[begin:chars])
                out_ids.append(p[first : k + 1])
                begin, first = chars, k + 1
    return out_words, out_ids


def split_documents(df: DataFrame, limit: int = 512, overlap: int = 64, least: int | None = None, text: str = "text", key: str = "doc_id", vocabulary: str = bpe.BYTE_BPE_50K) -> DataFrame:
    """key, piece_no, start_char, end_char, n_tokens, overlap_chars, piece: ordered pieces of at most ``limit`` tokens.

    Only texts of more than ``limit`` tokens are divided; others come out as one piece.
    Neighbours share about ``overlap`` tokens (``overlap_chars`` characters, at least one
    half of it where units allow); without the shared parts the pieces make up the text
    exactly. Pieces have at least ``least`` tokens (by default half the limit) but for the
    last. Null and empty texts have no pieces. One pass without a shuffle.
    """
    least = limit // 2 if least is None else least
    if not 0 <= overlap < least <= limit or limit < 16:
        raise ValueError("needs 0 <= overlap < least <= limit and limit >= 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cutter = bpe.encoder(vocabulary), _Cutter()
        names = [key, "piece_no", "start_char", "end_char", "n_tokens", "overlap_chars", "piece"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                rows, pieces = [], []
                texts = some.column(1).to_pylist()
                words = [enc.split(t) if t else () for t in texts]
                enc.learn(w for x in words for w in x)
                ids = [list(map(enc.cache.__getitem__, x)) for x in words]  # held here: counting a piece afresh may clear the cache
                for i, t in enumerate(texts):
                    for no, (lo, hi, n, over) in enumerate(split_text(t, words[i], ids[i], enc, cutter, limit, overlap, least) if t else ()):
                        rows.append((i, no, lo, hi, n, over))
                        pieces.append(t[lo:hi])
                cols = np.array(rows, np.int32).reshape(-1, 6)
                keys = some.column(0).take(pa.array(cols[:, 0]))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(cols[:, j]) for j in range(1, 6)], pa.array(pieces, pa.string())], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece_no int, start_char int, end_char int, n_tokens int, overlap_chars int, piece string")
