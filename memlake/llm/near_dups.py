"""Near-duplicate texts by prefix filtering on character n-grams (problem 5).

A text is the set of its n-grams, ordered rarest first. Two sets x, y of Jaccard
similarity t or more share at least a = t/(1+t) (|x|+|y|) n-grams, so the first
|x| - a + L of one and the first |y| - a + L of the other share L of them (prefix
filter; L more than one leaves few false pairs). Filters on the way, none of which
loses a pair:

- length: t |y| <= |x|;
- position: shared n-grams count only within the prefixes that the pair's sizes allow;
- count: min(L, a) of them must be shared;
- suffix: the sorted n-grams of both texts are divided at a pivot of one, and again; on each
  side the sets differ by at least their difference in size, which bounds the overlap.

Each surviving pair is verified once on the exact n-grams of the whole texts.

There is one path for all sizes. Equal texts form one class before anything else;
classes are joined, and members come back at the end. Only texts of one namespace and
field meet. Prefix n-grams are spread over buckets by hash, whatever namespace they are
of, so a namespace with a third of all texts is spread like any other; n-grams with
more postings than ``SPLIT`` are divided into shares that meet pairwise. Posting lists
are walked in blocks of bounded size, and the shared n-grams of a pair are added up
over the buckets, in parts of bounded size. A bucket holds 5 bytes per n-gram and 5 per
text; pairs travel as compressed columns; texts only for pairs that passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import components
from memlake.operators import skew
from memlake.sources.tables import Scratch

GRAM = 4
#: Cells of the table of n-gram counts that the order follows, and parts it is added up in.
CELL_BITS = 18
CELLS = 1 << CELL_BITS
SEGMENTS = 16
BATCH = 4096
#: Prefix entries that one bucket should hold, matches made at a time, and pairs held before they are passed on.
BUCKET, BLOCK, HELD = 3_000_000, 1_000_000, 4_000_000
#: Postings of one n-gram that meet in one bucket; more are divided into shares.
SPLIT = 1_000_000
#: n-grams that the prefixes of a pair must share.
SHARED = 4
#: Parts that the pairs of one partition are added up in, one at a time.
PARTS = 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EPS = 1e-9
_HASH = np.uint64((1 << 52) - 1)


def normal(c):
    """Lower case, every run of other characters than letters and digits one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every n-gram of every text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _M1
        h ^= h >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[: len(h)] == owner[n - 1 :]
    return owner[: len(h)][whole], h[whole] * _M2


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _ordered_sets(texts: list[str], n: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 52-bit key) of the distinct n-grams, by text and then rarest first.

    The key is the rank of the n-gram's cell by frequency and the hash bits that do not tell
    the cell: 52 bits that tell n-grams apart. Without ``rank`` cells are in order of number.
    """
    owner, h = _gram_hashes(texts, n)
    cell = _cell(h)
    first = (cell if rank is None else rank[cell]).astype(np.uint64) << np.uint64(52 - CELL_BITS)
    key = owner.astype(np.uint64) << np.uint64(52) | first | h >> np.uint64(12 + CELL_BITS)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(52)).astype(np.int64), key & _HASH


def _frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """Number of occurrences per hash cell of the n-grams, over all texts: CELLS numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                _, h = _gram_hashes(batch.slice(at, BATCH).column(0).to_pylist(), n)
                total += np.bincount(_cell(h), minlength=CELLS)
        parts = np.split(total, SEGMENTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["seg", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[seg] = sums.get(seg, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["seg", "counts"])

    schema = "seg int, counts binary"
    parts = texts.select("norm").mapInArrow(count, schema)
    # two levels, so that no task adds up all parts
    parts = parts.repartition(SEGMENTS * 2).mapInArrow(add, schema).repartitionById(SEGMENTS, F.col("seg")).mapInArrow(add, schema)
    total = np.zeros(CELLS, np.int64)
    width = CELLS // SEGMENTS
    for seg, raw in parts.collect():  # SEGMENTS rows of CELLS / SEGMENTS numbers
        total[seg * width : (seg + 1) * width] += np.frombuffer(raw, np.int64)
    return total


def _needed(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Overlap of two sets of these sizes at similarity t."""
    return np.ceil(t / (1 + t) * (x + y) - _EPS).astype(np.int64)


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(size, size - np.ceil(t * size - _EPS).astype(np.int64) + SHARED)


def _packed(base: int, idx: np.ndarray, size: np.ndarray, count: np.ndarray, token: np.ndarray, pos: np.ndarray, wide: bool, side: int) -> bytes:
    """One blob: texts ``base`` + idx with their set sizes and numbers of n-grams, then the n-grams and their places."""
    head = np.array([base, len(idx), int(wide), side], np.int64).tobytes()
    s, c = (np.uint32, np.uint32) if wide else (np.uint16, np.uint8)
    return head + idx.astype(np.uint16).tobytes() + size.astype(s).tobytes() + count.astype(c).tobytes() + token.astype(np.uint32).tobytes() + pos.astype(c).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    """(text id, size, token, place, side) of the n-grams of a blob."""
    base, n, wide, side = np.frombuffer(raw, np.int64, 4).tolist()
    s, c = (np.uint32, np.uint32) if wide else (np.uint16, np.uint8)
    at, out = 32, []
    for kind in (np.uint16, s, c):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    idx, size, count = (x.astype(np.int64) for x in out)
    m = int(count.sum())
    token = np.frombuffer(raw, np.uint32, m, at)
    pos = np.frombuffer(raw, c, m, at + 4 * m)
    return np.repeat(base + idx, count), np.repeat(size, count), token, pos.astype(np.int64), np.full(m, side, np.int8)


def _prefix_entries(texts: DataFrame, n: int, t: float, buckets: int, shared) -> DataFrame:
    """(bucket, entries): the prefix n-grams of all texts, packed by bucket (``_packed``).

    An n-gram whose cell has more than one share is divided: a text is of one of k shares
    and goes to the buckets of all pairs of shares that hold its own, on side 1 or 2 where
    the two differ; only different sides meet there, so two texts meet exactly once.
    """

    def rows_of(ids: np.ndarray, group: np.ndarray, norms: list[str]) -> Iterator[tuple[int, bytes]]:
        rank, shares = shared.value
        owner, key = _ordered_sets(norms, n, rank)
        size = np.bincount(owner, minlength=len(norms))
        pos = np.arange(len(key)) - (np.cumsum(size) - size)[owner]
        prefix = _prefix(size, t)
        held = pos < prefix[owner]
        owner, pos, key = owner[held], pos[held], key[held]
        token = (key ^ group[owner]) * _M3
        token ^= token >> np.uint64(31)
        side = np.zeros(len(token), np.int8)
        k = shares[(key >> np.uint64(52 - CELL_BITS)).astype(np.int64)]  # by rank
        heavy = np.flatnonzero(k > 1)
        if len(heavy):
            n_of = k[heavy].astype(np.int64)
            mine = ((ids[owner[heavy]].astype(np.uint64) * _M1) >> np.uint64(33)).astype(np.int64) % n_of
            who = np.repeat(heavy, n_of)
            other = np.arange(len(who)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
            mine = np.repeat(mine, n_of)
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            again = (token[who] ^ (lo.astype(np.uint64) << np.uint64(32) | hi.astype(np.uint64))) * _M1
            again ^= again >> np.uint64(29)
            light = np.flatnonzero(k <= 1)
            side = np.concatenate([side[light], np.where(lo == hi, 0, np.where(mine == lo, 1, 2)).astype(np.int8)])
            owner, pos, token = np.concatenate([owner[light], owner[who]]), np.concatenate([pos[light], pos[who]]), np.concatenate([token[light], again])
        bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        wide = (prefix > 255)[owner]
        kind = bucket * 6 + side * 2 + wide  # one blob each
        order = np.argsort(kind * len(norms) + owner, kind="stable")
        owner, pos, token, kind = owner[order], pos[order], token[order], kind[order]
        edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(kind) else np.zeros(1, np.int64)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            who, n_of = np.unique(owner[lo:hi], return_counts=True)
            b, rest = divmod(int(kind[lo]), 6)
            yield b, _packed(int(ids[0]), ids[who] - ids[0], size[who], n_of, token[lo:hi] & np.uint64(0xFFFFFFFF), pos[lo:hi], bool(rest % 2), rest // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            group = batch.column(1).to_numpy().view(np.uint64)
            # runs of consecutive ids, of bounded length
            cut = np.union1d(np.flatnonzero(np.diff(ids) != 1) + 1, np.arange(0, len(ids) + BATCH, BATCH))
            for lo, hi in zip(cut[:-1].tolist(), np.minimum(cut[1:], len(ids)).tolist()):
                if hi > lo:
                    rows = list(rows_of(ids[lo:hi], group[lo:hi], batch.column(2).slice(lo, hi - lo).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

    return texts.select("id", "grp", "norm").mapInArrow(run, "bucket int, entries binary")


def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) in order with the sums of n."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _matches(ids: np.ndarray, size: np.ndarray, token: np.ndarray, pos: np.ndarray, side: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared n-grams), a < b: pairs that share n-grams within the prefixes that their sizes allow.

    A pair may come in several parts. To the count of a pair that needs less than ``SHARED``
    the difference is added, so one bound holds for all.
    """
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, token = order[again], token[again]
    if not len(token):
        return
    ids, size, pos, side = ids[order], size[order], pos[order], side[order]
    number = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    span = int(size.max()) + 2
    order = np.argsort(number * span + size, kind="stable")
    ids, size, pos, number, side = ids[order], size[order], pos[order], number[order], side[order]
    # partners of i: those after it in its posting list whose size is at most size / t
    last = np.searchsorted(number * span + size, number * span + np.minimum(np.floor(size / t + _EPS).astype(np.int64), span - 1), side="right")
    count = last - np.arange(len(ids)) - 1
    parts, held = [], 0
    ends = np.cumsum(count)
    at = 0
    while at < len(ids):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        # one list longer than a block is itself walked in blocks
        for first in range(0, max(1, int(count[at:upto].max(initial=0))), BLOCK):
            part = np.minimum(np.maximum(count[at:upto] - first, 0), BLOCK)
            i = np.repeat(np.arange(at, upto), part)
            if not len(i):
                continue
            j = i + 1 + first + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
            need = _needed(size[i], size[j], t)
            ok = (pos[i] < size[i] - need + SHARED) & (pos[j] < size[j] - need + SHARED)
            ok &= (ids[i] != ids[j]) & ((side[i] == 0) | (side[i] != side[j]))
            if ok.any():
                x, y, extra = ids[i[ok]], ids[j[ok]], SHARED - np.minimum(SHARED, need[ok])
                parts.append(_merged(np.minimum(x, y), np.maximum(x, y), 1 + extra))
                held += len(parts[-1][0])
                if held > HELD:
                    yield _merged(*map(np.concatenate, zip(*parts)))
                    parts, held = [], 0
        at = upto
    if parts:
        yield _merged(*map(np.concatenate, zip(*parts)))


_ZSTD = pa.Codec("zstd", 1)


def _columns(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs as compressed columns: differences of a, b by bytes, counts."""
    planes = lambda x: np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    raw = planes(np.diff(a, prepend=0)) + planes(b) + np.minimum(n, 255).astype(np.uint8).tobytes()
    return np.array([len(a)], np.int64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _pairs_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    x = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=17 * n, asbytes=True), np.uint8)
    whole = lambda p: np.ascontiguousarray(p.reshape(8, n).T).view(np.int64).ravel()
    return np.cumsum(whole(x[: 8 * n])), whole(x[8 * n : 16 * n]), x[16 * n :].astype(np.int64)


def _candidates(entries: DataFrame, t: float, buckets: int) -> DataFrame:
    """(a, b): ids of the texts that share enough n-grams within their prefixes, added up over the buckets."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(_unpacked(raw))
        for b in list(held):
            for x, y, n in _matches(*map(np.concatenate, zip(*held.pop(b))), t):
                part = ((x.astype(np.uint64) * _M3) >> np.uint64(33)).astype(np.int64) % (buckets * PARTS)
                order = np.argsort(part, kind="stable")
                x, y, n, part = x[order], y[order], n[order], part[order]
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                blobs = [_columns(x[lo:hi], y[lo:hi], n[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])]
                at = pa.array(part[edge[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]] % buckets, pa.int32()), at, pa.array(blobs, pa.binary())], ["bucket", "part", "pairs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []  # rows are sorted by part; one part is held at a time

        def enough() -> pa.RecordBatch:
            a, b, n = _merged(*map(np.concatenate, zip(*own)))
            ok = n >= SHARED
            return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != at and own:
                    yield enough()
                    own = []
                at = part
                own.append(_pairs_of(raw))
        if own:
            yield enough()

    parts = entries.repartitionById(buckets, F.col("bucket")).mapInArrow(match, "bucket int, part long, pairs binary")
    parts = parts.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("part")
    return parts.select("part", "pairs").mapInArrow(add, "a long, b long")


def _suffix_bound(key: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int = 2) -> np.ndarray:
    """Upper bound of the overlap of texts x and y from the suffix filter on their sorted sets.

    ``key`` holds the sets one after another, each with its text's number in the high bits.
    The larger part is divided at its middle n-gram, the other at the same place in the
    order; on each side the overlap is at most the smaller size, and so on ``depth`` times.
    """
    own = lambda who, k: who.astype(np.uint64) << np.uint64(52) | k & _HASH
    spans = [(start[x], start[x] + size[x], start[y], start[y] + size[y])]
    bound = np.zeros(len(x), np.int64)
    for _ in range(depth):
        after = []
        for xs, xe, ys, ye in spans:
            some = (xe > xs) & (ye > ys)
            mid = np.minimum((ys + ye) // 2, len(key) - 1)
            at = np.clip(np.searchsorted(key, own(x, key[mid])), xs, xe)
            hit = some & (at < xe) & ((key[np.minimum(at, len(key) - 1)] & _HASH) == (key[mid] & _HASH))
            bound += hit
            after += [(np.where(some, xs, 0), np.where(some, at, 0), np.where(some, ys, 0), np.where(some, mid, 0))]
            after += [(np.where(some, at + hit, 0), np.where(some, xe, 0), np.where(some, mid + 1, 0), np.where(some, ye, 0))]
        spans = after
    return bound + sum(np.minimum(xe - xs, ye - ys) for xs, xe, ys, ye in spans)


def _verify(pairs: DataFrame, n: int, t: float) -> DataFrame:
    """Verified pairs (a, b, text_field, rep_a, rep_b, similarity) of the texts (a, b, text_field, rep_a, norm_a, rep_b, norm_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                a, b, field, rep_a, norm_a, rep_b, norm_b = (c.to_pylist() for c in batch.slice(at, 1024).columns)
                number: dict[str, int] = {}
                left = np.array([number.setdefault(x, len(number)) for x in norm_a])
                right = np.array([number.setdefault(x, len(number)) for x in norm_b])
                texts = list(number)
                owner, key = _ordered_sets(texts, n, None)
                size = np.bincount(owner, minlength=len(texts))
                whole = owner.astype(np.uint64) << np.uint64(52) | key
                hopeful = np.flatnonzero(_suffix_bound(whole, left, right, np.cumsum(size) - size, size) >= _needed(size[left], size[right], t)) if len(key) else []
                rows, sets = [], {}
                for k in hopeful:
                    for i in (left[k], right[k]):
                        if i not in sets:
                            s = texts[i]
                            sets[i] = (frozenset([s[q : q + n] for q in range(len(s) - n + 1)]), s.replace(" ", ""))
                    (p, p_tight), (q, q_tight) = sets[left[k]], sets[right[k]]
                    common = len(p & q)
                    union = len(p) + len(q) - common
                    if union and common >= t * union - _EPS and p_tight != q_tight:
                        rows.append((a[k], b[k], field[k], rep_a[k], rep_b[k], common / union))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], ["a", "b", "text_field", "rep_a", "rep_b", "similarity"])

    return pairs.select("a", "b", "text_field", "rep_a", "norm_a", "rep_b", "norm_b").mapInArrow(run, "a long, b long, text_field string, rep_a string, rep_b string, similarity double")


def _joined(texts: DataFrame, n: int, t: float, scratch: Scratch, split: int) -> DataFrame:
    """Verified pairs of the classes."""
    spark = texts.sparkSession
    freq = _frequencies(texts, n)
    by = np.argsort(freq, kind="stable")
    rank = np.empty(CELLS, np.int32)
    rank[by] = np.arange(CELLS)
    shares = np.ceil(freq[by] / split).clip(1).astype(np.int32)  # by rank
    entries = int(freq.sum() * (1 - t)) + 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET))
    packed = _prefix_entries(texts, n, t, buckets, spark.sparkContext.broadcast((rank, shares)))
    pairs = scratch.write(_candidates(packed, t, buckets))
    scratch.settle()
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text_field").alias(f"f_{s}"), F.col("rep").alias(f"rep_{s}"), F.col("norm").alias(f"norm_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("f_a = f_b").withColumnRenamed("f_a", "text_field")
    found = _verify(both, n, t)
    turned = F.col("rep_a") > F.col("rep_b")
    pick = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    return found.select("text_field", pick("rep_b", "rep_a").alias("rep_a"), pick("rep_a", "rep_b").alias("rep_b"), "similarity", pick("b", "a").alias("a"), pick("a", "b").alias("b"))


def near_duplicates(
    df: DataFrame,
    key: str = "storage_key",
    within: str = "namespace",
    fields: tuple[str, ...] = ("content", "raw_text"),
    threshold: float = 0.7,
    gram: int = GRAM,
    least_hot: int = skew.LEAST,
    split: int = SPLIT,
) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members).

    ``members``: text_field, rep, mem_key, id - every record with a text in that field and the
    class it belongs to, named by its smallest key; equal normal forms within one
    ``within`` and field are one class. ``pairs``: text_field, rep_a, rep_b, similarity, a, b -
    classes (and their ids) of one field and ``within`` with Jaccard similarity of
    ``threshold`` or more whose texts differ in letters or digits.

    Null, empty and blank texts, texts without letters and digits and null keys take no
    part; texts shorter than ``gram`` characters have no n-grams and are in no pair. A null
    ``within`` is a group of its own. Repeated rows and further columns change nothing.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near_dups")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("text_field"), normal(F.col(f)).alias("norm")) for f in fields]))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("mem_key"), F.col(within).cast("string").alias("ns"), each.alias("x"))
    rows = rows.select("mem_key", "ns", "x.text_field", "x.norm").where(F.col("norm") != "")
    space = F.coalesce(F.concat(F.lit("n"), "ns"), F.lit("-"))
    rows = rows.withColumn("cls", F.unhex(F.md5(F.concat_ws("\x00", "text_field", space, "norm")))).withColumn("grp", F.xxhash64("text_field", space))
    best = rows.groupBy("cls").agg(F.min(F.struct("mem_key", "text_field", "grp", "norm")).alias("r"), F.count("*").alias("n"))
    texts = best.select("cls", F.col("r.mem_key").alias("rep"), "r.text_field", "r.norm", "r.grp", "n")
    texts = scratch.write(texts.withColumn("id", F.monotonically_increasing_id()))  # ids are kept by being written
    scratch.settle()
    total = texts.agg(F.sum("n")).first()[0] or 0
    verified = scratch.write(_joined(texts, gram, threshold, scratch, split))
    scratch.settle()
    members = rows.select("cls", "mem_key").distinct()
    hot = skew.from_counts(texts.select("cls", "n"), "cls", total, least_hot)
    members = skew.salted_join(members, texts.select("cls", "rep", "text_field", "id"), "cls", F.col("mem_key"), hot)
    members = scratch.write(members.select("text_field", "rep", "mem_key", "id"))
    scratch.drop(texts)
    scratch.settle()
    return verified, members


def near_pairs(pairs: DataFrame, members: DataFrame, least_hot: int = skew.LEAST) -> DataFrame:
    """text_field, key_a, key_b (smaller first): the pairs of records behind the pairs of classes."""
    of = members.select("id", "mem_key")
    linked = pairs.select(F.col("a").alias("id"), F.col("b").alias("o"), "text_field")
    hot = skew.hot_keys(of, "id", least_hot)
    one = skew.salted_join(of, linked, "id", F.col("mem_key"), hot).select(F.col("o").alias("id"), "text_field", F.col("mem_key").alias("k"))
    both = skew.salted_join(of, one, "id", F.col("mem_key"), hot)
    return both.select("text_field", F.least("k", "mem_key").alias("key_a"), F.greatest("k", "mem_key").alias("key_b"))


def near_dup_pairs(df: DataFrame, **options) -> DataFrame:
    return near_pairs(*near_duplicates(df, **options))


def near_groups(df: DataFrame, least_hot: int = skew.LEAST, **options) -> DataFrame:
    """text_field, mem_key, rep, grp, n_links: one row per record with a text in that field.

    ``rep`` names its class of equal texts, ``n_links`` is the number of classes similar to
    it, ``grp`` the smallest ``rep`` among the classes linked to it directly or through others.
    """
    pairs, members = near_duplicates(df, least_hot=least_hot, **options)
    scratch = Scratch(df.sparkSession, "near_groups")
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components.contract(df.sparkSession, edges, scratch, least_hot=least_hot)
    if roots is None:
        return members.select("text_field", "mem_key", "rep", F.col("rep").alias("grp"), F.lit(0).cast("long").alias("n_links"))
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("rep_a").alias("rep")), F.struct(F.col("b").alias("v"), F.col("rep_b").alias("rep")))
    linked = pairs.select(F.explode(ends).alias("x")).groupBy("x.v", "x.rep").agg(F.count("*").alias("n_links"))
    named = scratch.write(linked.join(roots, "v"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("grp"))
    classes = skew.salted_join(named, smallest, "root", F.col("v"), skew.hot_keys(named, "root", least_hot)).select(F.col("v").alias("id"), "grp", "n_links")
    out = skew.salted_join(members, classes, "id", F.col("mem_key"), skew.hot_keys(members, "id", least_hot), "left")
    return out.select("text_field", "mem_key", "rep", F.coalesce("grp", "rep").alias("grp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
