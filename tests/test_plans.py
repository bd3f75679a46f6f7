"""Ranks, vectors, rules, classification and the write path against brute force and given cases."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memlake.operators import classify as C
from memlake.operators import ranks, vectors
from memlake.operators import rules as U
from memlake.operators import writing as W
from memlake.sources import tables

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RECORD = "storage_key string, namespace string, type string, content string, raw_text string, confidence double, tier int, created_at timestamp, version_chain_id string, version_number int, extra int"


def record(key, content, kind="fact_declaration", ns="n", minute=0, raw=None, chain=None, number=None):
    return (key, ns, kind, content, raw, 0.8, 3, T0 + timedelta(minutes=minute), chain, number, 1)


def test_running_sums_of_one_large_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), i, rng.randint(0, 9)) for i in range(900)]
    rng.shuffle(rows)
    got = {(r.g, r.i): r.total for r in ranks.running_sum(spark.createDataFrame(rows, "g string, i int, v int").repartition(7), ["g"], [F.col("i").asc()], F.col("v"), "total").collect()}
    want, sums = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + v
        want[g, i] = sums[g]
    assert got == want
    assert ranks.ranked(spark.createDataFrame([], "g string, i int"), ["g"], [F.col("i").asc()]).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([1.5, 1.5, 1.5, rng.random()])) for g in "ab" for _ in range(rng.randint(30, 400))] + [("a", None), ("c", 2.0), (None, 1.0)]
    got = {r.g: (r.n, r.mid, r.high) for r in ranks.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"mid": 0.5, "high": 0.99}).collect()}
    for g in {g for g, _ in rows}:
        vs = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g] == (len(vs), vs[min(int(len(vs) * 0.5), len(vs) - 1)], vs[min(int(len(vs) * 0.99), len(vs) - 1)])


@pytest.mark.parametrize("block", [50_000, 2])
def test_nearest_vectors(spark, block):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)], 1) for i in range(60)] + [(60, None, 1), (61, [], 1), (62, [1.0, 2.0], 1), (None, [0.0] * 4, 1), (63, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dist int").repartition(5)
    asked = [0, 7, 14, 60, 62]
    got = {}
    for r in vectors.nearest_all(df, df.where(F.col("vec_id").isin(asked)), 6, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.dist, 6)))
    by = {i: v for i, v, _ in rows if i is not None and v}
    want = {q: sorted(((i, round(math.dist(by[q], v), 6)) for i, v in by.items() if len(v) == len(by[q])), key=lambda x: (x[1], x[0]))[:6] for q in asked if q in by}
    assert got == want
    assert vectors.nearest_all(df.limit(0), df.limit(0), 3).count() == 0


def test_classification_cases(spark):
    cases = {
        "I prefer PostgreSQL over MySQL": "user_preference", "Correction: the port is 5433": "correction", "We decided to use Kafka for events": "decision",
        "Before every release run the smoke tests": "task_pattern", "The API server runs on port 8080 with nginx": "fact_declaration", "我之前说错了，端口是5433": "correction", "我们决定用新的方案": "decision",
        "thanks": None, "你好！": None, "npm install": None, "what's the time?": None, "don't remember this": None, "[INFO] started": None, "": None, None: None, "x" * 60_000: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, message string")
    got = {r.message: r.type for r in C.classify(df, "message").collect()}
    assert got == cases
    soft = {r.message: r.confidence for r in C.classify(df, "message", soft=True).collect()}
    assert soft["x" * 60_000] == 0.3 and soft["thanks"] is None
    rule = C.classify(df, "message", custom=[("smoke", "smoke", "decision", 9)])
    assert [(r.type, r.layer) for r in rule.where("message like '%smoke%'").collect()] == [("decision", "rule")]


def test_empty_replies_of_an_assistant(spark):
    texts = ["[assistant said] Sure, I understand", "[AI said] The build took 2.31 s on v1.4.2", "[bot said] nothing much to tell", "I understand"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(C.low_information("t").alias("x")).collect()] == [True, False, True, False]


def test_storing_records(spark):
    old = [record("a", "I use dark mode", "user_preference", minute=0, chain="c", number=4), record("b", "the port is 1", minute=1, raw=" ")]
    new = [record("x", "I use light mode", "user_preference", minute=9), record("y", "the port is 1", minute=10, raw="said so"), record("z", "I use light mode", "user_preference", minute=11), record("w", "other", ns="m", minute=12), record("v", "plain words", minute=13)]
    incoming = spark.createDataFrame(new + new[:1], RECORD).select("namespace", "type", "content", "raw_text", "confidence", "tier", "created_at")
    existing = spark.createDataFrame(old, RECORD)
    rows = {r.content: r for r in W.remember(incoming, existing).collect()}
    assert set(rows) == {"I use light mode", "other", "plain words"}
    light = rows["I use light mode"]
    assert (light.supersedes, light.version_chain_id, light.version_number) == ("a", "c", 5)
    assert light.expires_at - light.created_at == timedelta(days=365)
    assert rows["other"].version_chain_id == rows["other"].storage_key and rows["other"].version_number == 1
    assert [tuple(r) for r in W.filled(incoming, existing).collect()] == [("b", "said so")]
    assert W.remember(incoming.limit(0), existing).count() == 0


def test_similar_corrections(spark):
    pairs = [("端口 5432", "用 5432 端口", True), ("端口 5432", "端口 8080", False), ("use PostgreSQL", "use MySQL", False), ("", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r.x for r in df.select(W.similar_corrections(F.col("a"), F.col("b")).alias("x")).collect()] == [w for *_, w in pairs]


RULE = "rule_id string, trigger string, action string, rule_type string, scope string, override boolean, confidence double, trigger_count int, status string, condition string"


def test_rule_matches(spark):
    rules = [("1", "*", "be brief", "always", "company", False, 0.0, 0, "active", None), ("2", "write report", "add sources", "prefer", "personal", False, 0.0, 0, "active", None), ("3", "report", "use tables", "avoid", "personal", True, 1.0, 50, "active", "draft"), ("4", "竞品分析", "列表", "prefer", "personal", False, 0.0, 0, "active", None), ("5", "write report", "x", "prefer", "personal", False, 0.0, 0, "paused", None)]
    df = U.active(spark.createDataFrame(rules, RULE))
    scenes = spark.createDataFrame([("s", "Write report "), ("t", "nothing"), ("u", "帮我做竞品分析报告")], "scene_id string, scene string")
    got = {(r.scene_id, r.rule_id): (r.match_type, r.score) for r in U.match(scenes, df).collect()}
    assert got["s", "2"] == ("exact", 1.0) and got["s", "1"] == got["t", "1"] == ("global", 0.6) and ("s", "5") not in got
    assert got["u", "4"] == ("partial", 0.5) and got["s", "3"][1] >= 0.75
    assert {r.rule_id for r in U.active(spark.createDataFrame(rules, RULE), conditions=("final text",)).collect()} == {"1", "2", "4"}
    kinds = {(r.kind, r.rule_a, r.rule_b) for r in U.conflicts(df).collect()}
    assert ("contradiction", "2", "3") in kinds and ("overlap", "2", "4") not in kinds
    assert U.accepted(df, per_type=1, total=2).count() == 2


def test_scratch_tables_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        tables.shared_dir(Session())
    scratch = tables.Scratch(spark, "gone")
    scratch.write(spark.range(3))
    tables.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(f"{scratch.base}/0").count()
