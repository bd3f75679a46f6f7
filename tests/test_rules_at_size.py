"""Rules whose pairs are too many to list one by one: against brute force, with odd inputs."""

import math
import re
from collections import Counter
from itertools import combinations

import pytest

from memlake.operators import rules as U

RULE = "rule_id string, trigger string, action string, rule_type string"
OPPOSED = {frozenset(p) for p in U.OPPOSED_TYPES}


def _brute(rows):
    out = []
    for (i, t, a, k), (j, u, b, m) in combinations([r for r in rows if None not in (r[0], r[1])], 2):
        if i == j:
            continue
        t, u = t.strip(" ").lower(), u.strip(" ").lower()
        p, q = (set(re.split(r"\s+", x)) - {""} for x in (t, u))
        if not (t == u or "*" in (t, u) or t in u or u in t or len(p & q) >= max(1, min(len(p), len(q)) / 2)):
            continue
        kind = "redundancy" if t == u and a == b and k == m and a and k else "contradiction" if frozenset((k, m)) in OPPOSED else "overlap" if k == m and k and a and b and a != b else None
        if kind:
            out.append((kind, *sorted((i, j))))
    return out


def test_conflicts_and_their_counts_agree_with_brute_force(spark):
    triggers = ["*", "", " Red Bolt", "red bolt", "red", "ed", "bolt old", "old ring brand7", "old bolt brand7", "r", "a b c d e", "a b x y z", "a b c y z", None]
    rows = [(str(n), triggers[n % len(triggers)], ["x", "y", "z", None][n % 4], ["always", "prefer", "avoid", "forbid", "other", None][n // 3 % 6]) for n in range(120)]
    rows += [("5", "red", "y", "avoid"), ("5", "red", "y", "avoid"), ("7", "bolt old", "x", "always"), (None, "red", "x", "always")]  # ids that come again, and none
    df, want = spark.createDataFrame(rows, RULE), _brute(rows)
    assert sorted((r.kind, r.rule_a, r.rule_b) for r in U.conflicts(df).collect()) == sorted(want)
    assert {r.severity: r.n for r in U.health(df).collect()} == Counter(U.SEVERITY[k] for k, _, _ in want)


def test_conflicts_join_lists_not_rules(spark, monkeypatch):
    """Rules are divided into lists of about 50; what is joined are lists, and types are compared once per two lists."""
    monkeypatch.setattr(U, "LISTED", 50, raising=False)
    rows = [(str(n), ["*", "red bolt", "old bolt", "old ring"][0 if n % 97 == 0 else 1 + n % 7 // 3], ["x", "y", None][n % 5 // 2], ["always", "prefer", "avoid", "forbid", None][n // 2 % 5]) for n in range(600)]
    rows += [("5", "old bolt", "y", "avoid"), ("5", "old ring", "x", "avoid")]
    df = U.conflicts(spark.createDataFrame(rows, RULE))
    got = [(r.kind, r.rule_a, r.rule_b) for r in df.collect()]
    assert sorted(got) == sorted(_brute(rows)) and len({r[0] for r in got}) == 3
    assert {(r.kind, r.severity) for r in df.select("kind", "severity").distinct().collect()} == {(k, U.SEVERITY[k]) for k in ("redundancy", "contradiction", "overlap")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("rule_id" in line for line in joins) and plan.index("explode(list_b") < plan.index("explode(list_a") < plan.index("Join")


def test_conflicts_are_counted_without_listing_them(spark):
    n = 200_000
    df = spark.range(n).selectExpr("cast(id as string) rule_id", "if(id % 1000 = 0, '*', 'red bolt') trigger", "cast(id % 2 as string) action", "'prefer' rule_type")
    star, plain = n // 1000, n - n // 1000
    same = star * (star - 1) // 2 + sum(c * (c - 1) // 2 for c in (n // 2 - star, n // 2))
    across = plain * star - (n // 2 - star) * star  # global rules all have action 0; equal actions of two triggers are no overlap
    assert {r.severity: r.n for r in U.health(df).collect()} == {"low": same, "medium": (n // 2 - star) * (n // 2) + across}


def test_search_weighs_equal_rules_once(spark):
    """20,000 rules in three classes, one of which is divided into shares; ids that come twice count as one rule."""
    texts = [("red bolt", "use it"), ("red bolt", "use that"), ("old ring ring", "go on now"), ("cold gear", "stop")]
    rows = [(str(n), *texts[0 if n % 10 else n // 10 % 4]) for n in range(20_000)] + [("5", *texts[2])]
    df = spark.createDataFrame(rows, "rule_id string, trigger string, action string")
    queries = [("a", "red ring"), ("b", "bolt"), ("c", "nothing"), ("d", "Ring red gear")]
    docs = [(i, f"{t} {a}".split()) for i, t, a in rows]
    mean = sum(len(t) for _, t in docs) / len(docs)
    tf = Counter((i, len(t), w) for i, t in docs for w in t)
    n = Counter(w for _, _, w in tf)
    by = {}
    for (i, size, w), c in tf.items():
        by.setdefault(i, []).append((w, math.log(1 + (len(docs) - n[w] + 0.5) / (n[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean))))
    want = {(q, i): sum(s for w, s in parts if w in text.lower().split()) for q, text in queries for i, parts in by.items() if any(w in text.lower().split() for w, _ in parts)}
    asked = spark.createDataFrame(queries, "query_id string, query string")
    got = U.search(asked, df).collect()
    assert {(r.query_id, r.rule_id): r.bm25 for r in got} == pytest.approx(want, abs=2e-9) and len(got) == len(want)
    classes, _ = U._text_classes(asked.selectExpr("query_id", "explode(split(lower(query), ' ')) w"), U._texts(df).select("doc", "texts"))
    assert classes.select("class").distinct().count() == 4  # 'use it' and 'use that' are one; the id that comes twice is one more


def _matches(scenes, rows, k=5):
    """Every scene with every rule, as the SQL has it."""
    docs = [(r[0], re.findall(r"\w+", f"{r[1]} {r[2]}".lower())) for r in rows if r[1] != "*"]
    mean = sum(len(t) for _, t in docs) / len(docs)
    tf = Counter((i, len(t), w) for i, t in docs for w in t)
    n = Counter(w for _, _, w in tf)
    weights = {}
    for (i, size, w), c in tf.items():
        weights.setdefault(i, []).append((w, math.log(1 + (len(docs) - n[w] + 0.5) / (n[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean))))
    out = {}
    for name, scene in scenes:
        scene = scene.strip().lower()
        asked, best = set(re.findall(r"\w+", scene)), {}
        for i, trigger, _, override, count, confidence in rows:
            bonus, low, found = (0.1 if override else 0.0) + min(count / 10 * 0.02, 0.1) + 0.05 * confidence, trigger.lower(), []
            if trigger == "*":
                found.append((0.6, "global"))
            else:
                if low == scene:
                    found.append((1.0, "exact"))
                hit = [x for w, x in weights[i] if w in asked]
                if hit:
                    found.append((min(max(round(sum(hit), 9) / 10, 0.3), 0.95), "fts"))
                if any(len(w) >= 2 and w in asked for w in re.findall(r"[a-z0-9_]+", low)):
                    found.append((0.5, "partial"))
            for base, kind in found:
                best[i] = max(best.get(i, ()), (round(min(1.0, base + bonus), 6), base, kind))
        first = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k]
        out |= {(name, at): (i, b[2], b[0]) for at, (i, b) in enumerate(first, 1)}
    return out


def test_match_takes_the_first_of_each_class(spark):
    """Many equal rules, ties by the highest score across bonuses, ids that come several times with different triggers."""
    triggers = ["red bolt", "Red bolt", "old ring", "a ring", "*", "cold gear brand7", "cold gear brand8", "plate"]
    rows = [(str(n), triggers[n % 8] if n % 997 else "*", ["use it", "use that", "ring"][n // 8 % 3], n % 2 == 0, n // 16 % 7, n // 32 % 10 / 10) for n in range(3000)]
    rows += [(str(n), t, "ring it", False, 9, 0.9) for n in (0, 1, 10, 100) for t in ("red bolt", "old ring", "old ring")]
    scenes = [("a", " Red bolt"), ("b", "old ring"), ("c", "nothing at all"), ("d", "cold ring brand7"), ("e", "it")]
    df = U.match(spark.createDataFrame(scenes, "scene_id string, scene string"), spark.createDataFrame(rows, "rule_id string, trigger string, action string, override boolean, trigger_count int, confidence double"))
    assert {(r.scene_id, r["rank"]): (r.rule_id, r.match_type, r.score) for r in df.collect()} == _matches(scenes, rows)


def test_classes_of_triggers_leave_out_what_no_scene_says(spark):
    lows = spark.createDataFrame([(f"red bolt brand{n}",) for n in range(500)] + [("old",), ("red bolt",)], "low string")
    scenes = spark.createDataFrame([("a", "red bolt")], "scene_id string, scene string")
    likes, _ = U._trigger_classes(lows, scenes, scenes.selectExpr("scene_id", "explode(split(scene, ' ')) t"))
    assert likes.count() == 502 and likes.select("like").distinct().count() == 3


def test_injection_over_many_equal_rules(spark):
    """All 50,000 have the highest score, so the five smallest ids are matched; of these the overriding ones are injected."""
    df = spark.range(50_000).selectExpr("lpad(id, 6, '0') rule_id", "'red bolt' trigger", "'use it' action", "id % 2 = 0 override", "0 trigger_count", "0.0D confidence")
    m = U.match(spark.createDataFrame([("a", "red bolt")], "scene_id string, scene string"), df)
    got = U.inject(m.join(df.select("rule_id", "trigger", "action", "override"), "rule_id"), 3).collect()
    assert sorted((r.rule_id, r.tokens, r.used) for r in got) == [(f"{2 * n:06}", 3, 3 * n + 3) for n in range(3)]


def test_match_reads_words_of_distinct_texts_only(spark, tmp_path):
    """The result reads the rules once, for the global ones; 40,000 rules of two triggers and two actions are two shapes each."""
    rows = spark.range(40_000).selectExpr("cast(id as string) rule_id", "if(id % 2 = 0, 'red bolt', 'old ring') trigger", "if(id % 3 = 0, 'use it', 'red') action", "false override", "0 trigger_count", "if(id = 7, null, 0.0D) confidence")
    rows.write.parquet(f"{tmp_path}/rules")
    m = U.match(spark.createDataFrame([("a", "red bolt"), ("b", "ring")], "scene_id string, scene string"), spark.read.parquet(f"{tmp_path}/rules"), 2)
    plan = m._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f"{tmp_path}/rules") == 1
    # an unknown bonus gives the score 1
    assert sorted((r.scene_id, r["rank"], r.rule_id, r.match_type, r.score) for r in m.collect()) == [("a", 1, "0", "exact", 1.0), ("a", 2, "10", "exact", 1.0), ("b", 1, "7", "partial", 1.0), ("b", 2, "1", "partial", 0.5)]


def test_match_is_the_same_without_sending_texts(spark, monkeypatch):
    rows = [(str(n), ["red bolt", "old ring", "*"][n % 3 if n % 31 else 2], ["use it", "red"][n % 2], n % 2 == 0, n % 7, n % 10 / 10) for n in range(200)]
    scenes = [("a", "red bolt"), ("b", "ring use"), ("c", "nothing")]
    monkeypatch.setattr(U, "SENT_TEXTS", 0)
    df = U.match(spark.createDataFrame(scenes, "scene_id string, scene string"), spark.createDataFrame(rows, "rule_id string, trigger string, action string, override boolean, trigger_count int, confidence double"))
    assert {(r.scene_id, r["rank"]): (r.rule_id, r.match_type, r.score) for r in df.collect()} == _matches(scenes, rows)


def test_rank_estimate_scores_classes(spark):
    words = ["red", "bolt", "old", "ring", "bearing", "use", "it"]
    rows = [(str(n), f"{words[n % 7]} {words[n // 7 % 7]} x{n % 11}", f"{words[n // 49 % 7]} {n % 13}") for n in range(12_000)] + [("3", "Red Bolt", "it"), ("3", "red bolt", "it")]
    queries = [("a", "red bolt"), ("b", "ring"), ("c", "use it red"), ("c", "use it red"), ("d", "unheard of")]
    want = Counter()
    for q, text in set(queries):
        qw = set(text.split())
        for i, t, a in rows:
            tw, aw = set(t.lower().split()), set(a.lower().split())
            if qw & (tw | aw):
                want[q, i, round(min(1.0, 0.5 + (0.3 if text in t.lower() else 0.0) + (0.1 if text in a.lower() else 0.0) + 0.2 * (len(qw & tw) / len(qw))), 6)] += 1
    asked, df = spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(rows, "rule_id string, trigger string, action string")
    assert Counter((r.query_id, r.rule_id, r.score) for r in U.rank_estimate(asked, df).collect()) == want  # rules that are given twice count twice, as in the SQL
