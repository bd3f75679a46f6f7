import random
from datetime import datetime, timedelta, timezone

import pytest

from memlake.operators import history, orphans

SNAP = "storage_key string, namespace string, snapshot_at timestamp, loaded_at timestamp, type string, tier int, confidence double, content_hash string, paused boolean, version int, created_at timestamp, updated_at timestamp, cuts int"
MEM = "storage_key string, type string, tier int, confidence double, content_hash string, paused boolean, version int, created_at timestamp, updated_at timestamp, slice string, nth int"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def us(t):
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def brute(snaps, mems):
    by = {}
    for r in snaps:
        by.setdefault(r[0], []).append((0, r))
    for r in mems:
        by.setdefault(r[0], []).append((1, r))
    out = set()
    low = -(2**62)
    for key, rows in by.items():
        if key is None:
            continue
        best = {}
        for prio, r in rows:
            if prio:
                state, ver, c, u, sn, ld = (r[4], r[1], r[2], r[3], r[5]), r[6], r[7], r[8], None, None
            else:
                state, ver, c, u, sn, ld = (r[7], r[4], r[5], r[6], r[8]), r[9], r[10], r[11], r[2], r[3]
            start = u if u is not None and (c is None or u >= c) else c
            if start is None:
                continue
            rank = (prio, us(sn) if sn else low, us(ld) if ld else low)
            if start not in best or rank > best[start][0]:
                best[start] = (rank, state, ver)
        live = any(p for p, _ in rows)
        last = max((us(r[2]) for p, r in rows if not p and r[2]), default=None)
        periods = []
        for start in sorted(best):
            _, state, ver = best[start]
            if periods and periods[-1][0] == state:
                if ver is not None:
                    periods[-1][2] = ver if periods[-1][2] is None else min(periods[-1][2], ver)
            else:
                periods.append([state, us(start), ver])
        for i, (_, since, ver) in enumerate(periods):
            out.add((key, ver, since, periods[i + 1][1] if i + 1 < len(periods) else -1 if live else last))
    return out


def sample(seed, n, keys, hot=0.0):
    rng = random.Random(seed)
    snaps, mems = [], []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice([f"k{j}" for j in range(keys)] + [None])
        c = rng.choice([None, T0, T0 + timedelta(hours=rng.randint(0, 50))])
        u = rng.choice([None, T0 + timedelta(hours=rng.randint(-5, 400))])
        at = T0 + timedelta(days=20, minutes=i)
        snaps.append((k, "n", at, at + timedelta(seconds=i), rng.choice("ab"), rng.choice([1, 2, None]), 0.5, rng.choice(["x", None]), rng.choice([True, False]), rng.choice([None, 1, 2, 3]), c, u, 7))
    for j in range(0, keys, 2):
        mems.append((f"k{j}", "a", 1, 0.5, "x", False, rng.randint(1, 4), T0, T0 + timedelta(hours=rng.randint(0, 400)), "s", 1))
    return snaps + snaps[:9], mems + mems[:2]


@pytest.mark.parametrize("n, keys, hot, least", [(0, 0, 0, 100), (40, 9, 0, 10**6), (900, 12, 0.4, 50), (700, 1, 0.9, 60)])
def test_periods_match_brute_force(spark, n, keys, hot, least):
    snaps, mems = sample(n + keys, n, keys, hot)
    got = history.validity_periods(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(mems, MEM), least_hot=least)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(snaps, mems)


def test_state_across_words(spark):
    """More than 64 readings of one state are one period."""
    snaps = [("k", "n", T0 + timedelta(days=9, minutes=i), T0, "a", 1, 0.5, "x", False, i + 1, T0, T0 + timedelta(minutes=i), 0) for i in range(200)]
    got = history.validity_periods(spark.createDataFrame(snaps, SNAP), spark.createDataFrame([], MEM)).collect()
    assert [tuple(r) for r in got] == [("k", 1, us(T0), us(T0 + timedelta(days=9, minutes=199)))]


def orphan_tables(spark):
    t = lambda d: T0 + timedelta(days=d)
    mem = spark.createDataFrame([("M1", t(0), "x"), ("m2 ", t(9), "x"), (None, t(1), "x")], "storage_key string, created_at timestamp, tbl string")
    snap = spark.createDataFrame([("m3",), ("M3",), ("m1",)], "storage_key string")
    ent = spark.createDataFrame([(1, " m1", t(1)), (2, "M2", t(2)), (3, "m3", t(2)), (4, "m4 ", t(40)), (5, None, t(2)), (6, "  ", t(2)), (7, "m4", None), (7, "m4", None)], "id long, memory_key string, created_at timestamp")
    rel = spark.createDataFrame([(1, 1, 2, "m1", t(5)), (2, 99, None, None, t(5)), (3, 4, 1, "m9", t(5))], "id long, src_entity_id long, dst_entity_id long, source_memory_key string, created_at timestamp")
    return mem, snap, ent, rel


@pytest.mark.parametrize("least", [1, 10**6])
def test_orphans(spark, least):
    got = {tuple(r) for r in orphans.memory_orphans(*orphan_tables(spark), least_hot=least).collect()}
    e, r = "memory_entities", "memory_relations"
    assert got == {
        (e, "memory_key", 2, "late", "2024-01"), (e, "memory_key", 3, "deleted", "2024-01"), (e, "memory_key", 4, "missing", "2024-02"), (e, "memory_key", 7, "missing", None),
        (r, "src_entity_id", 2, "missing", "2024-01"), (r, "src_entity_id", 3, "late", "2024-01"), (r, "source_memory_key", 3, "missing", "2024-01"),
    }


def test_orphans_of_empty_tables(spark):
    tables = [df.limit(0) for df in orphan_tables(spark)]
    assert orphans.memory_orphans(*tables).count() == 0


def test_counts_from_changes(spark):
    """A state kept up from deltas equals the state of the whole."""
    mem, snap, ent, _ = orphan_tables(spark)
    refs = orphans.reference_rows(ent, "memory_entities", {"memory_key": "memories"})
    whole = orphans.key_counts(orphans.reference_deltas(refs), orphans.existence_deltas(mem, "storage_key", "memories"))
    first = orphans.key_counts(orphans.reference_deltas(refs))
    second = orphans.key_counts(first, orphans.existence_deltas(mem, "storage_key", "memories"))
    assert set(map(tuple, whole.collect())) == set(map(tuple, second.collect()))
    gone = orphans.key_counts(second, orphans.existence_deltas(mem.where("storage_key = 'M1'"), "storage_key", "memories", sign=-1))
    assert [r.exist for r in gone.where("key = 'memories:m1' and born_us is not null").collect()] == [0]
    assert "memories:m1" in {r.key for r in orphans.orphan_keys(gone).collect()}


def test_removed_target_makes_references_in_between_late(spark):
    day = lambda n: T0 + timedelta(days=n)
    refs = orphans.reference_rows(spark.createDataFrame([(1, "m1", day(5))], "id long, memory_key string, created_at timestamp"), "t", {"memory_key": "memories"})
    mem = lambda n: spark.createDataFrame([("M1 ", day(n))], "storage_key string, created_at timestamp")
    delta = lambda df, sign: orphans.existence_deltas(df, "storage_key", "memories", sign=sign)
    kinds = lambda state: [r.kind for r in orphans.orphan_references(refs, state).collect()]
    state = orphans.key_counts(orphans.reference_deltas(refs), delta(mem(1), 1))
    assert kinds(state) == []
    state = orphans.key_counts(state, delta(mem(1), -1))
    assert kinds(state) == ["deleted"]
    state = orphans.key_counts(state, delta(mem(9), 1))
    assert kinds(state) == ["late"]


def test_snapshots_without_a_start_count_for_the_last_period_of_a_hot_entity(spark):
    rows = [("k", "n", T0 + timedelta(days=9, minutes=i), T0, "a", i % 3, 0.5, "x", False, 1, T0, T0 + timedelta(minutes=i), 0) for i in range(60)]
    rows += [("k", "n", T0 + timedelta(days=90), T0, "a", 1, 0.5, "x", False, 1, None, None, 0)]
    got = history.validity_periods(spark.createDataFrame(rows, SNAP), spark.createDataFrame([], MEM), least_hot=10)
    assert {tuple(r) for r in got.collect()} == brute(rows, [])
    assert max(r.valid_to_us for r in got.collect()) == us(T0 + timedelta(days=90))
