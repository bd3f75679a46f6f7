"""Language of messages and of their stretches by nearest centroid (problem 2).

Every language is a set of centroids: its training sentences as normalised TF-IDF
vectors of character n-grams and words, grouped by spherical k-means. A sentence gets
the language of the nearest centroid by cosine; one too far from all of them, given its
number of words, is rejected: it is 'und', as are other languages. Labels may be wrong, so
sentences are grouped before labels are looked at and each group is named by its majority.

A tenth of the distinct sentences is first held out of the centroids. Their distances to
the centroids of all other languages than their own are those of text in a language that
was never learned: the bound of rejection lies above nearly all of these, and below nearly all
distances to their own. How often the nearest language was right at which lead over the
second one gives the confidence. Then all sentences are used.

Within a message the sentences vote for a path: a change of language must be worth
more than its cost, so that short fragments follow their neighbours. Names, paths,
setting names, numbers and code carry no language and are taken out beforehand.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``) and is of fixed
size; it is applied to all rows in one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "zh", "ja", "de", "fr", "es", "pt", "ru", "ko")
NONE = "und"
#: Places of the languages whose words are not set apart or are very short.
EAST = (1, 2, 8)
#: Labelled rows that the model is fitted on at most, drawn by a hash of their id.
SAMPLE = 5_000
DIM = 1 << 15
#: Groups that the training sentences are divided into before labels are looked at, and centroids per language.
GROUPS, CLUSTERS = 200, 16
#: A group is divided until one label has the first share of it or it is small; a group without the second share teaches nothing.
PURE, CLEAR, SMALL = 0.75, 0.6, 8
#: What a change of language costs, in relative cosine times the root of the number of words.
SWITCH = 0.6
#: Share of held-out sentences that the bound of rejection should exceed when their language is left out, and may exceed when it is not.
FOREIGN, LOST = 0.95, 0.005
#: Numbers of words at which another bound of rejection begins.
LENGTHS = (1, 2, 3, 4, 6, 9, 16)
#: Number of words from which, and part of the bound below which a rejected sentence is a stretch of its own beside others.
ALONE, CLEARLY = 9, 0.8
#: Leads over the second language that accuracy is measured at.
BINS = 10
CACHE = 100_000

_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`|<[^<>\n]{1,80}>", re.S)
_NOT_WORDS = re.compile(
    r"(?:https?://|www\.)[A-Za-z0-9_~:/?#@!$&*+,;=%.-]*[A-Za-z0-9_/=&%-]"
    r"|[A-Za-z0-9._%+-]+\s?(?:@|[(\[]at[)\]])\s?[A-Za-z0-9.-]*[A-Za-z0-9](?:\s?[(\[]dot[)\]]\s?[A-Za-z]+)*"  # mail addresses
    r"|[A-Za-z0-9_.-]*[A-Za-z0-9_-]/[A-Za-z0-9_./-]*[A-Za-z0-9_/]"  # paths
    r"|(?:user|assistant|system|tool)(?=:)"
    r"|[A-Za-z0-9-]*_[A-Za-z0-9_-]*"  # setting names
    r"|[A-Za-z]*\d(?:[A-Za-z0-9.:,-]*[A-Za-z0-9])?"  # numbers, versions, dates, keys
    r"|\b[a-z0-9]+\.(?:py|md|ts|rs|sql|ya?ml|toml|json|txt|sh)\b"
)
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）)]*\s*|\n+|\s[/|—–-]\s|[()\[\]（）]|(?<=[.!?])(?=[㐀-鿿぀-ヿ가-힣])")
_EAST_RUN = re.compile(r"[぀-ヿ㐀-鿿가-힣]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _fold(s: str) -> str:
    """Lower case without accents on Latin and Cyrillic letters; messages may lack them."""
    s = s.lower()
    if s.isascii():
        return s
    return "".join(c if _EAST.match(c) else unicodedata.normalize("NFD", c)[0] for c in unicodedata.normalize("NFC", s))


def _grams(w: str) -> list[int]:
    """Hashed features of a word: itself and its character n-grams."""
    if _EAST.match(w):
        grams = [w[i : i + n] for n in (1, 2) for i in range(len(w) - n + 1)]
    else:
        x = f"<{_fold(w)}>"
        grams = [x, *(x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1) if n < len(x))]
        if not w.isascii() and not _CYRILLIC.match(w):
            grams += [w, *(w[i : i + 2] for i in range(len(w) - 1) if not w[i : i + 2].isascii())]
    return [crc32(g.encode("utf-8", "surrogatepass")) % DIM for g in grams]


def words_of(sentence: str) -> list[str]:
    """The words that tell a language. Beside another script Latin words are names, and so are capitalised ones inside a sentence."""
    if _EAST.search(sentence):
        return _EAST_RUN.findall(sentence)
    words = _WORD.findall(sentence)
    if not sentence.isascii() and _CYRILLIC.search(sentence):
        words = [w for w in words if _CYRILLIC.match(w)]
    elif sum(map(str.islower, words)) >= 2:
        words = [w for i, w in enumerate(words) if i == 0 or not w[0].isupper()]
    return list(map(str.lower, words))


def sentences(t: str) -> list[tuple[int, int, str]]:
    """(start, end, text without what carries no language) of the sentences; places in the text are kept."""
    blank = lambda m: "\x00" * len(m.group())
    t = _NOT_WORDS.sub(blank, _CODE.sub(blank, t))
    out, at = [], 0
    for m in _BREAK.finditer(t):
        if m.start() > at:
            out.append((at, m.start(), t[at : m.start()]))
        at = max(at, m.end())
    if at < len(t):
        out.append((at, len(t), t[at:]))
    return out


@dataclass
class Model:
    weight: np.ndarray  # DIM x centroids: idf times centroid
    idf: np.ndarray  # DIM
    language: np.ndarray  # of each centroid
    usual: np.ndarray  # median cosine of the training sentences of each language
    far: np.ndarray  # relative cosine below which a sentence is rejected, by kind of script and length (``LENGTHS``)
    lead: np.ndarray  # leads over the second language, rising
    right: np.ndarray  # share of held-out sentences that were right at each lead

    def bound(self, n_words: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        return self.far[np.isin(nearest, EAST).astype(int), np.searchsorted(LENGTHS, np.maximum(n_words, 1), side="right") - 1]

    def confidence(self, lead: float) -> float:
        return float(np.interp(lead, self.lead, self.right))


class Scorer:
    """Cosines of sentences with the nearest centroid of each language.

    A sentence is the sum of its words' TF-IDF vectors, so the products of each word with
    all centroids are computed once and kept (at most ``CACHE`` words). The norm leaves out the cross terms
    of n-grams that two words of a sentence share.
    """

    def __init__(self, model: Model):
        self.model = model
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, model.weight.shape[1] + 1), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.row) + len(words) > CACHE:
            self.row.clear()
        need = len(self.row) + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table[: len(self.row)], np.zeros((2 * need, self.table.shape[1]), np.float32)])
        grams = list(map(_grams, words))
        n_of = np.fromiter(map(len, grams), np.int64, len(grams))
        idx = np.fromiter(chain.from_iterable(grams), np.int64, int(n_of.sum()))
        start = np.concatenate([[0], np.cumsum(n_of)[:-1]])
        at = len(self.row)
        for lo in range(0, len(grams), 2000):  # bounded memory
            hi = min(lo + 2000, len(grams))
            a, b = start[lo], start[hi] if hi < len(grams) else len(idx)
            part = idx[a:b]
            self.table[at + lo : at + hi, :-1] = np.add.reduceat(self.model.weight[part], start[lo:hi] - a, axis=0)
            self.table[at + lo : at + hi, -1] = np.add.reduceat(self.model.idf[part] ** 2, start[lo:hi] - a)
        self.row.update(zip(words, range(at, at + len(grams))))

    def __call__(self, words: list[list[str]]) -> np.ndarray:
        """One row per sentence, relative to the usual cosine of each language."""
        out = np.zeros((len(words), len(LANGUAGES)), np.float32)
        held = [i for i, ws in enumerate(words) if ws]
        if not held or not len(self.model.language):
            return out
        missing = {w for i in held for w in words[i] if w not in self.row}
        if missing:
            self._learn({w for i in held for w in words[i]} if len(self.row) + len(missing) > CACHE else missing)
        ids = np.fromiter((self.row[w] for i in held for w in words[i]), np.int64)
        n_of = np.fromiter((len(words[i]) for i in held), np.int64, len(held))
        total = np.add.reduceat(self.table[ids], np.concatenate([[0], np.cumsum(n_of)[:-1]]), axis=0)
        cos = total[:, :-1] / np.sqrt(np.maximum(total[:, -1:], 1e-9))
        for k in range(len(LANGUAGES)):
            mine = self.model.language == k
            if mine.any():
                out[held, k] = cos[:, mine].max(1) / max(self.model.usual[k], 1e-6)
        return out


def _vectors(sents: list[list[str]], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, weight): normalised TF-IDF vectors, sorted by sentence; plain counts without ``idf``."""
    feats = [list(chain.from_iterable(map(_grams, ws))) for ws in sents]
    n_of = np.fromiter(map(len, feats), np.int64, len(feats))
    flat = np.fromiter(chain.from_iterable(feats), np.int64, int(n_of.sum()))
    code, tf = np.unique(np.repeat(np.arange(len(feats)), n_of) * DIM + flat, return_counts=True)
    owner, idx = code // DIM, code % DIM
    return owner, idx, tf.astype(np.float32) if idf is None else _normed(owner, tf * idf[idx], len(feats))


def _normed(owner: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, w * w, n))
    return (w / np.maximum(norm[owner], 1e-9)).astype(np.float32)


def _part(owner, idx, w, mine: np.ndarray, n: int):
    """The vectors of some sentences, numbered anew."""
    to = np.full(n, -1)
    to[mine] = np.arange(len(mine))
    held = to[owner] >= 0
    return to[owner[held]], idx[held], w[held]


def _mean_directions(owner, idx, w, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Unit mean vectors (DIM x groups) of the sentences by group (-1: left out)."""
    g = group[owner]
    held = g >= 0
    c = np.bincount(idx[held] * n_groups + g[held], w[held], DIM * n_groups).reshape(DIM, n_groups)
    return (c / np.maximum(np.sqrt((c * c).sum(0)), 1e-9)).astype(np.float32)


def _dots(owner, idx, w, c: np.ndarray, n: int) -> np.ndarray:
    """Cosines of all sentences with all centroids, in blocks of sentences."""
    out = np.zeros((n, c.shape[1]), np.float32)
    edge = np.searchsorted(owner, np.arange(0, n + 1000, 1000))
    for lo, hi in zip(edge[:-1], edge[1:]):
        if hi > lo:
            own = owner[lo:hi]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[start]] = np.add.reduceat(c[idx[lo:hi]] * w[lo:hi, None], start, axis=0)
    return out


def _cluster(owner, idx, w, n: int, k: int, rounds: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (group of each sentence, centroids)."""
    group = np.full(n, -1)
    picked = rng.choice(n, min(k, n), replace=False)
    group[picked] = np.arange(len(picked))
    c = None
    for _ in range(rounds):
        c = _mean_directions(owner, idx, w, group, k)
        group = _dots(owner, idx, w, c, n).argmax(1)
    return group, _mean_directions(owner, idx, w, group, k)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Model of (text, language) rows; rows of other languages are ignored.

    Sentences are grouped without regard to their labels, and each group takes the label
    of most of its members: labels that are wrong here and there are outvoted. Then each
    language's sentences are clustered into its centroids.
    """
    x, y = [], []
    for text, lang in sorted(rows):
        if lang in LANGUAGES and text:
            for _, _, s in sentences(text):
                ws = words_of(s)
                if ws and (len(ws) > 1 or len(ws[0]) > 1):
                    x.append(ws)
                    y.append(LANGUAGES.index(lang))
    n, y = len(x), np.array(y, np.int64)
    if not n:
        return Model(np.zeros((DIM, 0), np.float32), np.zeros(DIM), np.zeros(0, np.int64), np.zeros(len(LANGUAGES)), np.zeros((2, len(LENGTHS))), np.zeros(1), np.full(1, 0.5))
    rng = np.random.default_rng(seed)
    owner, idx, tf = _vectors(x, None)
    df = np.bincount(idx, minlength=DIM)
    idf = np.where(df > 0, np.log((n + 1) / (df + 1)) + 0.1, 0)
    w = _normed(owner, tf * idf[idx], n)
    group, _ = _cluster(owner, idx, w, n, min(GROUPS, max(len(LANGUAGES), n // 7)), 4, rng)
    label = np.full(n, -1)
    # sentences that occur again and again vote among themselves
    same: dict[tuple[str, ...], list[int]] = {}
    for i, ws in enumerate(x):
        same.setdefault(tuple(ws), []).append(i)
    for mine in same.values():
        if len(mine) >= 4:
            label[mine] = np.bincount(y[mine], minlength=len(LANGUAGES)).argmax()
    todo = [np.flatnonzero((group == g) & (label < 0)) for g in range(group.max() + 1)]
    todo = [mine for mine in todo if len(mine)]
    while todo:
        mine = todo.pop()
        votes = np.bincount(y[mine], minlength=len(LANGUAGES))
        parts = []
        if len(mine) >= SMALL and votes.max() < PURE * len(mine):
            sub, _ = _cluster(*_part(owner, idx, w, mine, n), len(mine), 3, 5, rng)
            parts = [mine[sub == k] for k in range(3) if (sub == k).any()]
        if len(parts) > 1:
            todo += parts
        else:
            label[mine] = votes.argmax() if votes.max() >= CLEAR * len(mine) else -1
    held = np.array([crc32(" ".join(ws).encode("utf-8", "surrogatepass")) % 10 == 0 for ws in x])

    def centroids(some: np.ndarray) -> Model:
        all_c, all_l, usual = [np.zeros((DIM, 0), np.float32)], [], np.zeros(len(LANGUAGES))
        for k in range(len(LANGUAGES)):
            mine = np.flatnonzero((label == k) & some)
            if not len(mine):
                continue
            own, i, v = _part(owner, idx, w, mine, n)
            _, c = _cluster(own, i, v, len(mine), CLUSTERS, 8, np.random.default_rng(seed))
            c = c[:, (c * c).sum(0) > 0]
            usual[k] = np.median(_dots(own, i, v, c, len(mine)).max(1))
            all_c.append(c)
            all_l += [k] * c.shape[1]
        c = (np.concatenate(all_c, 1) * idf[:, None]).astype(np.float32)
        return Model(c, idf.astype(np.float32), np.array(all_l, np.int64), usual, np.zeros((2, len(LENGTHS))), np.zeros(1), np.full(1, 0.5))

    model = centroids(label >= 0)
    test = np.flatnonzero(held & (label >= 0))
    part = centroids(~held) if len(test) >= BINS else None
    if part is not None and len(part.language):
        _calibrate(part, [x[i] for i in test], label[test])
        model.far, model.lead, model.right = part.far, part.lead, part.right
    return model


def n_words(ws: list[str]) -> int:
    """Length of a sentence; two characters count as a word in scripts without blanks."""
    return sum(map(len, ws)) // 2 if ws and _EAST.match(ws[0]) else len(ws)


def _calibrate(model: Model, sents: list[list[str]], label: np.ndarray) -> None:
    """Bounds of rejection and confidences from sentences that the centroids have not seen."""
    near = Scorer(model)(sents)
    size = np.searchsorted(LENGTHS, np.maximum([n_words(ws) for ws in sents], 1), side="right") - 1
    best, east = near.max(1), np.isin(label, EAST)
    others = near.copy()
    others[np.arange(len(near)), label] = 0
    for kind in (0, 1):
        for i in range(len(LENGTHS)):
            mine = (size == i) & (east == kind)
            if mine.sum() >= 5:
                model.far[kind, i] = min(np.quantile(others[mine].max(1), FOREIGN), np.quantile(best[mine], LOST))
    top = np.sort(near, axis=1)
    lead = top[:, -1] - top[:, -2]
    order = np.argsort(lead, kind="stable")
    parts = np.array_split(order, BINS)
    model.lead = np.array([lead[p].mean() for p in parts])
    hit = near.argmax(1) == label
    model.right = np.maximum.accumulate([(hit[p].sum() + 1) / (len(p) + 2) for p in parts])


def stretches(spans: list[tuple[int, int, int]], near: np.ndarray, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches of one message.

    ``spans``: start, end and number of words of its sentences; ``near`` their relative cosines.
    A rejected sentence follows its neighbours, or is 'und' if it is long and far; so is a message
    of which every sentence is rejected.
    """
    held = [i for i, (_, _, n) in enumerate(spans) if n]
    if not held or not len(model.language):
        return []
    near = near[held]
    size = np.array([spans[i][2] for i in held])
    bound = model.bound(size, near.argmax(1))
    best = near.max(1)
    far = best < bound
    doubt = lambda k: min(1.0, max(0.5, 1 - 0.5 * float(best[k]) / max(float(bound[k]), 1e-9)))
    if far.all():
        return [(spans[held[0]][0], spans[held[-1]][1], NONE, round(sum(doubt(k) for k in range(len(held))) / len(held), 4))]
    weight = np.sqrt(np.minimum(size, 16))
    alone = (best < CLEARLY * bound) & (size >= ALONE)
    path = np.where(alone, len(LANGUAGES), near.argmax(1)).tolist()
    if len(set(path)) > 1:
        gain = np.concatenate([np.where(far[:, None], 0, np.minimum(near, 1)), alone[:, None]], 1) * weight[:, None]
        total, back = gain[0].copy(), []
        for g in gain[1:]:
            jump = int(total.argmax())
            stay = total >= total[jump] - SWITCH
            back.append(np.where(stay, np.arange(len(total)), jump))
            total = np.where(stay, total, total[jump] - SWITCH) + g
        path = [int(total.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
    out: list[list] = []
    for k, (i, p) in enumerate(zip(held, path)):
        if p == len(LANGUAGES):
            name, sure = NONE, doubt(k)
        else:
            top = np.partition(near[k], -2)[-2:]
            name, sure = LANGUAGES[p], model.confidence(float(near[k, p] - (top[0] if near[k, p] >= top[1] else top[1])))
        if out and out[-1][2] == name:
            out[-1][1] = spans[i][1]
            out[-1][3].append((sure, weight[k]))
        else:
            out.append([spans[i][0], spans[i][1], name, [(sure, weight[k])]])
    return [(s, e, la, round(float(sum(a * b for a, b in c) / sum(b for _, b in c)), 4)) for s, e, la, c in out]


def label_form(c: Column | str) -> Column:
    """A label as it counts: trimmed, lower case, the part before the first - or _."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(F.lower(F.trim(c)), r"^([^-_]*)", 1)


def train(df: DataFrame, text: str = "message", label: str = "language", key: str = "id", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows, drawn by a hash of ``key`` so that the draw does not depend on the order of rows."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), label_form(label).alias("l")).where(F.col("t").isNotNull() & F.col("l").isin(*LANGUAGES))
    drawn = rows.orderBy(F.xxhash64("k"), "k", "t", "l").limit(sample).select("t", "l").distinct().collect()
    return fit([(r[0], r[1]) for r in drawn])


def label_stretches(df: DataFrame, model: Model, text: str, key: str, keep: str | None = None) -> DataFrame:
    """rec_key, seg_no, lang, confidence, start_char, end_char (and ``kept``, the column ``keep``): one row per stretch.

    A message without words is one stretch 'und' of confidence 1; so is an empty or blank
    one. Null texts and null keys give no rows. Rows delivered twice come out twice.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size
    names = ["rec_key", "seg_no", "lang", "confidence", "start_char", "end_char", "kept"]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = Scorer(m)
        for batch in batches:
            for at in range(0, len(batch), 512):
                keys, texts, kept = (c.to_pylist() for c in batch.slice(at, 512).columns)
                spans, flat = [], []
                for t in texts:
                    own = []
                    for s, e, x in sentences(t):
                        ws = words_of(x)
                        own.append((s, e, n_words(ws)))
                        flat.append(ws)
                    spans.append(own)
                near, i, rows = score(flat), 0, []
                for k, t, own, z in zip(keys, texts, spans, kept):
                    found = stretches(own, near[i : i + len(own)], m) or [(0, len(t), NONE, 1.0)]
                    i += len(own)
                    rows += [(k, no, la, c, s, e, z) for no, (s, e, la, c) in enumerate(found, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(7)], names)

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), (F.col(keep).cast("string") if keep else F.lit(None).cast("string")).alias("z"))
    return rows.where(F.col("k").isNotNull() & F.col("t").isNotNull()).mapInArrow(run, "rec_key string, seg_no int, lang string, confidence double, start_char int, end_char int, kept string")


def memory_languages(en: DataFrame, memories: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """src, rec_key, seg_no, lang, confidence: stretches of every message of ``en`` and every non-blank ``original_message``, with ``kept`` the label of ``en``."""
    model = train(en, sample=sample)
    a = label_stretches(en, model, "message", "id", "language").withColumn("src", F.lit("en"))
    some = memories.where(F.length(F.regexp_replace("original_message", r"\s|\x{a0}|\x{3000}", "")) > 0)
    b = label_stretches(some, model, "original_message", "storage_key").withColumn("src", F.lit("memories"))
    return a.unionByName(b)


def language_cases(found: DataFrame) -> DataFrame:
    """src, rec_key, seg_no, lang of all memories, and of those messages of ``en`` that have several stretches or another label than their language."""
    by = found.groupBy("src", "rec_key").agg(F.sort_array(F.collect_set(F.struct("seg_no", "lang"))).alias("x"), F.max("kept").alias("kept"))
    other = F.coalesce(label_form("kept"), F.lit("")) != F.col("x")[0]["lang"]
    cases = by.where((F.col("src") != "en") | (F.size("x") > 1) | other)
    return cases.select("src", "rec_key", F.explode("x").alias("s")).select("src", "rec_key", "s.seg_no", "s.lang")
