import math
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.operators import analytics as A
from memlake.operators import classify as C
from memlake.operators import graph as G
from memlake.operators import notes as N
from memlake.operators import recall as R
from memlake.operators import rules as U
from memlake.operators import skew
from memlake.plans import catalog
from memlake.sources import stores
from memlake.sources.tables import Scratch


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_importance(spark):
    got = one(spark, S.importance("c", "t", F.lit(30.0), "n"), c=0.9, t="correction", n=0)
    assert got == pytest.approx(round(0.9 * 1.3 * 0.65, 6))
    assert one(spark, S.type_weight(F.lit(None).cast("string"))) == 1.0


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        S.quality_score("a", "b", "c", "d", (1, 1, 1, 1))


def test_secrets_are_redacted(spark):
    assert one(spark, L.redact_secrets(F.lit("key sk-" + "a" * 24 + " end"))) == "key [REDACTED] end"
    assert not one(spark, L.has_secret(F.lit("nothing here")))


def test_tokens_and_jaccard(spark):
    assert one(spark, L.jaccard(L.word_tokens(F.lit("A b c")), L.word_tokens(F.lit("b c d")))) == 0.5
    assert one(spark, L.jaccard(L.word_tokens(F.lit("")), L.word_tokens(F.lit("")))) == 0.0
    assert one(spark, L.token_estimate(F.lit("数据库 abcd"))) == 4
    assert one(spark, L.unsafe_categories(F.lit("a ../b; rm -rf"))) == ["command", "traversal"]


def test_time_words():
    now = datetime(2024, 5, 20, tzinfo=timezone.utc)
    assert R.parse_time_words("what did we pick 2 weeks ago", now)[0] == datetime(2024, 5, 6, tzinfo=timezone.utc)
    assert R.parse_time_words("the first choice", now) == (None, True)


def test_filters_are_checked():
    with pytest.raises(ValueError):
        R.RecallFilter(limit=-1)
    with pytest.raises(ValueError):
        R.RecallPlan("x", modes=("nothing",))


def test_full_text_needs_every_token(spark):
    df = spark.createDataFrame([("a", "Red house", None, None), ("b", None, "red", "HOUSE"), ("c", "red", None, None)], "storage_key string, content string, raw_text string, original_message string")
    assert sorted(r[0] for r in R.full_text(df, 'red "house"').collect()) == ["a", "b"]
    assert R.full_text(df, "a b").count() == 0


def test_mmr_prefers_variety(spark):
    df = spark.createDataFrame([("g", "a", 1.0, ["x", "y"]), ("g", "b", 0.95, ["x", "y"]), ("g", "c", 0.9, ["z"])], "ns string, k string, s double, tok array<string>")
    got = sorted((r["pick"], r["k"]) for r in R.mmr(df, 2, "ns", "s", "tok", "k").collect())
    assert got == [(1, "a"), (2, "c")]


def test_jaccard_pairs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(f"k{i:03}", rng.choice(["n", None]), sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))})) for i in range(120)]
    got = {(r.key_a, r.key_b) for r in A.jaccard_pairs(spark.createDataFrame(rows, "k string, ns string, tok array<string>"), "k", "tok", ["ns"], 0.6).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and len(set(a[2]) & set(b[2])) >= 0.6 * len(set(a[2]) | set(b[2]))}
    assert got == want


def test_supersede(spark):
    t = [datetime(2024, 1, i, tzinfo=timezone.utc) for i in (1, 2, 3)]
    df = spark.createDataFrame([("a", "n", "fact", "the flag is enabled", t[0]), ("b", "n", "fact", "the flag is disabled", t[1]), ("c", "n", "correction", "the flag is enabled", t[2])], "storage_key string, namespace string, type string, content string, created_at timestamp")
    assert [tuple(r) for r in A.supersede_candidates(df).collect()] == [("b", "a")]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(40)] + [("b", 1.0), ("b", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in A.latency_percentiles(df, "g", "v").collect()}
    assert got == {"a": (20.0, 38.0, 39.0), "b": (1.0, None, 1.0)}


def test_graph_walks(spark):
    e = G.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (5, 5), (None, 1)], "x long, y long"), "x", "y")
    scratch = Scratch(spark, "test")
    seeds = spark.createDataFrame([(1,)], "v long")
    assert sorted(map(tuple, G.k_hop(e, seeds, 2, scratch).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert G.shortest_path_length(e, 1, 4, 4, scratch).first()["hops"] == 3
    assert G.shortest_path_length(e, 1, 7, 4, scratch).first()["hops"] is None
    assert sorted(map(tuple, G.min_label_components(e, scratch).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]


def test_fuzzy_aliases(spark):
    df = spark.createDataFrame([("n", "t", "postgres", "postgre"), ("n", "t", "mysql", "redis")], "namespace string, entity_type string, canonical_form string, alias_form string")
    got = [tuple(r) for r in G.fuzzy_aliases(df, df).collect()]
    assert got == [("n", "postgres", "postgre", round(SequenceMatcher(None, "postgres", "postgre").ratio(), 6))]


def test_classification(spark):
    rows = [(1, "ok"), (2, "I prefer tabs over spaces"), (3, None), (4, "   "), (5, "we decided to ship on Friday"), (6, "hm?"), (7, "x" * 50_000)]
    got = {r.id: (r.noise, r.type) for r in C.classify(spark.createDataFrame(rows, "id long, message string"), "message").collect()}
    assert got == {1: ("acknowledgment", None), 2: (None, "user_preference"), 3: ("short", None), 4: ("short", None), 5: (None, "decision"), 6: ("short", None), 7: (None, None)}


def test_rule_injection_keeps_overriding_rules(spark):
    df = spark.createDataFrame([("s", "1", "t", "a" * 400, True, 0.1), ("s", "2", "t", "a" * 40, False, 0.9), ("s", "3", "t", "a" * 4, False, 0.8)], "scene_id string, rule_id string, trigger string, action string, override boolean, score double")
    assert [r.rule_id for r in U.inject(df, 50).collect()] == ["1"]


def test_notes(spark):
    text = "---\ntitle: My Note\ntags: [A, b]\n---\nsee [[Other]] and #c\n"
    r = N.index(spark.createDataFrame([("x/y.md", text), ("z.md", "plain")], "path string, text string")).orderBy("path").collect()
    assert (r[0].title, r[0].tags, r[0].links) == ("My Note", ["a", "b", "c"], ["Other"])
    assert (r[1].title, r[1].tags) == ("z", [])


def test_json_store_and_export(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"ns": {"memories": {"k1": {"content": "Hello", "confidence": 0.5, "importance_score": 1.0}}}}')
    df = stores.read(spark, "json_store", str(tmp_path / "s.json"))
    assert [(r.namespace, r.storage_key) for r in stores.search_json_store(df, "hello", datetime(2024, 1, 1), 5).collect()] == [("ns", "k1")]
    stores.export_parquet(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        stores.read(spark, "none", "x")


def test_hot_keys_are_divided_into_shares(spark):
    df = spark.createDataFrame([("h",)] * 160 + [(f"k{i}",) for i in range(40)] + [(None,)] * 70, "k string")
    hot = skew.hot_keys(df, "k", 50)
    assert hot.n == 1 and [r.salts for r in hot.table.collect()] == [4]
    shares = {r.salt for r in skew.salt(df.withColumn("i", F.monotonically_increasing_id()), "k", F.col("i"), hot).where("k = 'h'").select("salt").collect()}
    assert shares == {0, 1, 2, 3}
    assert skew.replicate(df.distinct(), "k", hot).count() == 4 + 40 + 1
    assert skew.hot_keys(df, "k", 500) is None
    # shares grow with the key, not the threshold with the input
    assert skew.hot_threshold(10**9) == 10**5 and skew.hot_threshold(10**12) == 10**7


def test_half_life():
    assert math.isclose(0.5 ** (30 / 30), 0.5)


def test_leader_groups_take_every_preference(spark, tmp_path):
    import random

    rng = random.Random(7)
    # more than 500 in one namespace
    rows = [(f"k{i:04}", rng.choice(["n"] * 9 + ["m", None]), "user_preference", " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 7))), 0) for i in range(700)]
    spark.createDataFrame(rows + [("z", "n", "decision", "a b", 0)], "storage_key string, namespace string, type string, content string, access_count int").write.parquet(str(tmp_path / "memories.parquet"))
    want, leaders = set(), {}
    for k, ns, _, text, _ in rows:
        t = set(text.split())
        hit = next((j for j, u in leaders.setdefault(ns, []) if t | u and len(t & u) / len(t | u) >= 0.4), None)
        if hit is None:
            leaders[ns].append((k, t))
        want.add((ns, k, hit or k))
    got = [tuple(r) for r in catalog.queries()["q4_leader_groups"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def write_memories(spark, folder, rows, columns):
    spark.createDataFrame([(*r, 0) for r in rows], columns + ", access_count int").write.parquet(str(folder / "memories.parquet"))


def test_keywords_of_all_records(spark, tmp_path):
    import re

    texts = ["Move the 数据库备份 to ab S3", "plain words only", "数据库 backup", "の数据库备份é", "字", ""]
    write_memories(spark, tmp_path, [(f"k{i}", "n", t) for i, t in enumerate(texts)], "storage_key string, namespace string, content string")
    want = {}
    for i, t in enumerate(texts):
        runs = re.findall("[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff]+", t)
        want[f"k{i}"] = sorted(set(re.findall("[a-z]{3,}", t.lower())) | {r[a : a + n] for r in runs for n in (2, 3, 4) for a in range(len(r) - n + 1)})
    assert {r.storage_key: r.words for r in catalog.queries()["x17_all_keywords"](spark, str(tmp_path)).collect()} == want
    mined = {w: sum(w in ws for ws in want.values()) for ws in want.values() for w in ws}
    assert {r.keyword: r.n for r in catalog.queries()["r10_a21_all_mining"](spark, str(tmp_path)).collect()} == {w: n for w, n in mined.items() if n >= 3}


def test_entities_of_all_kinds(spark, tmp_path):
    write_memories(spark, tmp_path, [("a", "Use git-lint and git-lint on src/app/main.py with the API"), ("b", "Ada Lovelace wrote 用CLI做"), ("c", "nothing here"), ("d", None)], "storage_key string, content string")
    got = sorted(tuple(r) for r in catalog.queries()["g1_g4_all_entities"](spark, str(tmp_path)).collect())
    assert got == [("a", "acronym", "API"), ("a", "path", "src/app/main.py"), ("a", "tool", "git-lint"), ("b", "acronym", "CLI"), ("b", "name", "Ada Lovelace")]


def test_mmr_takes_every_record(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [(f"a{i:03}", "hot", "decision", 1.0 - i / 10_000, "same old words again", False) for i in range(120)] + [("z", "hot", "decision", 0.9, "quite another thing", False)]
    rows += [(f"r{i:03}", rng.choice(["u", None]), "decision", rng.choice([0.0, 0.5, 1.0, rng.random()]), " ".join(rng.choice(["aa", "bb", "cc", "dd", "库", "ee"]) for _ in range(rng.randint(0, 5))), False) for i in range(150)]
    write_memories(spark, tmp_path, rows, "storage_key string, namespace string, type string, importance_score double, content string, paused boolean")
    want = set()
    for ns in ("hot", "u", None):
        left = {r[0]: (r[3], set(r[4].split())) for r in rows if r[1] == ns}
        top, had = max(s for s, _ in left.values()) or 1.0, []
        for pick in range(1, 11):
            value = lambda k: round(0.7 * left[k][0] / top - 0.3 * max((len(left[k][1] & t) / len(left[k][1] | t) if left[k][1] | t else 0.0 for t in had), default=0.0), 12)
            k = min(left, key=lambda k: (-value(k), k))
            had.append(left.pop(k)[1])
            want.add((ns, k, pick))
    assert ("hot", "z", 2) in want
    assert {tuple(r) for r in catalog.queries()["k11_mmr"](spark, str(tmp_path)).collect()} == want
