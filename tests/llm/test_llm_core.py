"""Consolidation, duplicates, near duplicates, packing, splitting and encoding against brute force."""

import random

import pytest
from pyspark.sql import functions as F

regex = pytest.importorskip("regex")
pytest.importorskip("memlake.llm")

from memlake.llm import bpe, chunking, components, format_dups, near_dups, packing  # noqa: E402

ALIAS = "canonical_form string, alias_form string, namespace string, form int, v int"


def groups_brute(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, ns, *_ in rows:
        ends = [(ns, s.strip().lower()) for s in (a, b) if s and s.strip()]
        for x in ends:
            parent.setdefault(x, x)
        if len(ends) == 2:
            x, y = map(find, ends)
            parent[max(x, y, key=lambda p: p[1])] = min(x, y, key=lambda p: p[1])
    return {(ns, f, find((ns, f))[1]) for ns, f in parent}


@pytest.mark.parametrize("least", [5, 10**6])
def test_groups(spark, least):
    rng = random.Random(1)
    rows = [(f"N{i:02} ", f" n{i + 1:02}", "chain", 1, 1) for i in range(40)]
    rows += [("Hub", f"s{i}", "star", 1, 1) for i in range(30)] + [("a", "A ", None, 1, 1), ("b", None, None, 1, 1), (None, " ", "x", 1, 1), ("q", "", "x", 1, 1)]
    rows += [(f"r{rng.randint(0, 40)}", f"r{rng.randint(0, 40)}", rng.choice(["u", "w"]), 1, 1) for _ in range(40)]
    got = [tuple(r) for r in components.group_forms(spark.createDataFrame(rows + rows[:5], ALIAS), least_hot=least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == groups_brute(rows)


def test_groups_of_nothing(spark):
    assert components.group_forms(spark.createDataFrame([], ALIAS)).count() == 0
    assert [tuple(r) for r in components.group_forms(spark.createDataFrame([("A", "a", "n", 1, 1)], ALIAS)).collect()] == [("n", "a", "a")]


@pytest.mark.parametrize("least", [2, 10**6])
def test_format_copies(spark, least):
    rows = [
        ("1", "n", "t", "Hello,  World!", 1), ("2", "n", "t", "hello world", 1), ("2", "n", "t", "hello world", 1), ("3", "n", "u", "hello world", 1), ("4", None, "t", "hello world", 1), ("5", None, "t", "HELLO WORLD", 1),
        ("a", "n", "t", "k=1; path=x/y; on=yes", 1), ("b", "n", "t", '{"path": "x/y", "k": "1", "on": "YES"}', 1), ("c", "n", "t", "* on: yes\n- k = 1\npath = x/y", 1), ("d", "n", "t", "k=1|on=yes|path=x/z", 1),
        ("e", "n", "t", None, 1), (None, "n", "t", "hello world", 1), ("f", "n", "t", "...", 1), ("g", "n", "t", "", 1), ("h", "n", "t", "{broken", 1), ("i", "n", "t", "long " * 20_000, 1),
    ]
    df = spark.createDataFrame(rows, "storage_key string, namespace string, type string, content string, g int")
    got = sorted(tuple(r) for r in format_dups.format_copies(df, least_hot=least).collect())
    assert got == [("1", "1", 2), ("2", "1", 2), ("4", "4", 2), ("5", "4", 2), ("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("f", "f", 2), ("g", "f", 2)]
    assert format_dups.format_copies(df.limit(0)).count() == 0


def near_brute(rows, t=0.7, n=4):
    out = set()
    for c, field in ((2, "content"), (3, "raw_text")):
        items = {}
        for r in rows:
            if r[0] is not None and r[c]:
                s = regex.sub(r"[^\p{L}\p{N}]+", " ", r[c].lower()).strip()
                if s:
                    items[r[0]] = (r[1], s.replace(" ", ""), {s[i : i + n] for i in range(len(s) - n + 1)})
        keys = sorted(items)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                x, y = items[a], items[b]
                if x[0] == y[0] and x[1] != y[1] and x[2] | y[2] and len(x[2] & y[2]) >= t * len(x[2] | y[2]):
                    out.add((field, a, b))
    return out


@pytest.mark.parametrize("split, least", [(10**6, 10**6), (8, 10**6), (30, 3)])
def test_near_duplicates(spark, split, least):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "数据库", "备份"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 25))) for _ in range(8)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((f"k{i:02}", rng.choice(["n", "m", None]), ", ".join(w), rng.choice([None, "", " ", "?!", "abc", " ".join(w).upper()]), 1))
    rows += [("x1", "n", "same text again", None, 1), ("x2", "n", "Same  text, again", None, 1), ("x3", "n", "sametext again", None, 1), (None, "n", "same text again", None, 1)] + rows[:7]
    df = spark.createDataFrame(rows, "storage_key string, namespace string, content string, raw_text string, rep int")
    got = [tuple(r) for r in near_dups.near_dup_pairs(df, split=split, least_hot=least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == near_brute(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_dup_pairs(spark.createDataFrame([], "storage_key string, namespace string, content string, raw_text string")).count() == 0


def tiktoken_encoder():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.BYTE_BPE_50K, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark):
    rng = random.Random(2)
    ref = tiktoken_encoder()
    texts = [None, "", " ", "<|endoftext|> plain", "it's  a\n\n test", "数据库と데이터 🚀🚀 ñandú", "x" * 3000, "aB3/+" * 2000, "​﻿\x00", "tail  ", "no break" * 1]
    texts += ["".join(rng.choice("abc XYZ09.,\n\té漢字🙂'") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [10, 10**6])
def test_packing(spark, least):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 1, 7, 7, 7, 7, 40, 99, 100, 101, 350, None])) for i in range(600)] + [(None, 5)]
    got = packing.pack(spark, spark.createDataFrame(sizes, "doc_id long, n_tokens int"), 100, least_hot=least).collect()
    by, where = {}, {}
    for r in got:
        by.setdefault((r.doc_id,), []).append(r)
        if r.size:
            where.setdefault(r.container, []).append(r)
    for k, n in sizes:
        parts = sorted(by[(k,)], key=lambda r: r.part)
        assert sum(r.size for r in parts) == (n or 0) and [r.start for r in parts] == [100 * j for j in range(len(parts))]
        assert len(parts) == max(1, -(-(n or 0) // 100))
    assert max(sum(r.size for r in rs) for rs in where.values()) <= 100
    assert sorted(where) == list(range(len(where)))
    assert all(len({r.slot for r in rs}) == len(rs) for rs in where.values())
    fit = []  # first fit, longest first
    for n in sorted((r.size for r in got if r.size), reverse=True):
        i = next((i for i, room in enumerate(fit) if room >= n), None)
        if i is None:
            fit.append(100 - n)
        else:
            fit[i] -= n
    assert len(where) <= 1.02 * len(fit)
    assert packing.pack(spark, spark.createDataFrame([], "doc_id long, n_tokens int"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark, spark.createDataFrame([], "doc_id long, n_tokens int"), 0)


def test_splitting(spark):
    rng = random.Random(6)
    para = lambda: " ".join(rng.choice(["The quick fox.", "jumps over", "数据库备份。", "lazy dogs!", "x=1;"]) for _ in range(rng.randint(5, 40)))
    texts = [None, "", "short", "# T\n\n" + "\n\n".join(para() for _ in range(40)), "user: hi\n" * 500, "A1b/" * 4000, "漢字" * 1500, "a " * 3000, "word\r\n" * 900, "'" * 2000, " " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    limit, overlap = 128, 16
    rows = sorted(chunking.split_documents(df, limit, overlap).collect(), key=lambda r: (r.doc_id, r.piece_no))
    enc = bpe.encoder()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert [r.piece_no for r in mine] == list(range(len(mine)))
        assert "".join(r.piece[r.overlap_chars :] for r in mine) == (t or "")
        for r in mine:
            assert r.piece == t[r.start_char : r.end_char]
            assert len(enc.encode(r.piece)) == r.n_tokens <= limit
        if t and len(enc.encode(t)) > limit:
            assert len(mine) > 1 and all(r.overlap_chars > 0 for r in mine[1:])
    with pytest.raises(ValueError):
        chunking.split_documents(df, 64, 64)


def test_edits_move_only_neighbouring_pieces(spark):
    rng = random.Random(8)
    text = "\n".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(12)) + "." for _ in range(300))
    edited = text[:3000] + " some new words " + text[3000:]
    df = spark.createDataFrame([(1, text), (2, edited)], "doc_id long, text string")
    pieces = {k: {r.piece for r in chunking.split_documents(df.where(F.col("doc_id") == k), 256, 0).collect()} for k in (1, 2)}
    assert len(pieces[1] & pieces[2]) >= len(pieces[1]) - 5


def test_splitting_with_a_full_word_cache(monkeypatch):
    pa = pytest.importorskip("pyarrow")

    class Local:  # runs the function over one batch in this process, where the bound of the cache can be set
        def __init__(self, texts):
            self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
            self.schema = {"doc_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda _: "bigint"})()})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return [r for b in run([self.batch]) for r in b.to_pylist()]

    texts = ["\n\n".join(f"Text {k} has paragraph {j} of words w{k}x{j}." for j in range(60)) for k in range(6)]
    want = chunking.split_documents(Local(texts), 128, 16)
    assert len(want) > 2 * len(texts)
    monkeypatch.setattr(bpe, "CACHE", 5)
    assert chunking.split_documents(Local(texts), 128, 16) == want


def test_cuts_fall_on_blanks_where_there_is_no_better_place(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["window/pane", "paper", "x=1;", "alpha-beta", "don't", "#42", "naïve"]) for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(chunking.split_documents(df, 128, 16).collect(), key=lambda r: r.piece_no)
    assert len(rows) > 50
    for a, b in zip(rows, rows[1:]):
        assert text[a.end_char].isspace() or text[a.end_char - 1].isspace()
        assert text[b.start_char].isspace() or text[b.start_char - 1].isspace()
