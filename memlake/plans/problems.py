"""Queries of the general problems (history, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.operators import history, orphans
from memlake.sources.tables import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.validity_periods(table(spark, d, "memory_snapshots"), table(spark, d, "memories"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.memory_orphans(*(table(spark, d, t) for t in ("memories", "memory_snapshots", "memory_entities", "memory_relations")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def _cleared(spark: SparkSession, d: str, again: bool) -> DataFrame:
    """Orphans from a maintained state: all rows inserted, then the memories of the largest namespace removed, and perhaps inserted again."""
    memories, snapshots, entities, relations = (table(spark, d, t) for t in ("memories", "memory_snapshots", "memory_entities", "memory_relations"))
    scratch = Scratch(spark, "orphan_state")
    state = scratch.write(orphans.memory_state(memories, snapshots, entities, relations))
    gone = memories.where("namespace = 'default'")
    state = scratch.write(orphans.key_counts(state, orphans.existence_deltas(gone, "storage_key", "memories", sign=-1)))
    if again:
        state = scratch.write(orphans.key_counts(state, orphans.existence_deltas(gone, "storage_key", "memories")))
    return orphans.orphan_references(orphans.memory_references(entities, relations), state)


def p4_state_removed(spark: SparkSession, d: str) -> DataFrame:
    return _cleared(spark, d, False)


def p4_state_restored(spark: SparkSession, d: str) -> DataFrame:
    return _cleared(spark, d, True)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_report, p4_state_removed, p4_state_restored)}

_START = "epoch_us(case when updated_at is not null and (created_at is null or updated_at >= created_at) then updated_at else created_at end)"
_STATE = "content_hash, type, tier, confidence, paused"

P1_SQL = f"""
with r as (
  select storage_key k, {_START} s, 0 prio, epoch_us(snapshot_at) sn, epoch_us(loaded_at) ld, {_STATE}, version from memory_snapshots
  union all
  select storage_key, {_START}, 1, null, null, {_STATE}, version from memories),
per as (select k, max(sn) last_sn, max(prio) live from r where k is not null group by k),
one as (select * from r where k is not null and s is not null
  qualify row_number() over (partition by k, s order by prio desc, sn desc nulls last, ld desc nulls last) = 1),
f as (select *, case when row_number() over w = 1 or lag(content_hash) over w is distinct from content_hash or lag(type) over w is distinct from type
    or lag(tier) over w is distinct from tier or lag(confidence) over w is distinct from confidence or lag(paused) over w is distinct from paused then 1 else 0 end nw
  from one window w as (partition by k order by s)),
g as (select *, sum(nw) over (partition by k order by s) g from f),
p as (select k, g, min(version) version, min(s) s from g group by k, g)
select p.k mem_key, version::int as version, s valid_from_us,
  coalesce(lead(s) over (partition by p.k order by s), case when live = 1 then -1 else last_sn end) valid_to_us
from p join per on p.k = per.k
"""

_STRIP = r"regexp_replace(lower({}), '^\s+|\s+$', '', 'g')"
P4_SQL = f"""
with m as (select {_STRIP.format("storage_key")} k, min(coalesce(created_at, timestamptz '0001-01-01')) c from memories where storage_key is not null group by 1),
e as (select id k, min(coalesce(created_at, timestamptz '0001-01-01')) c from memory_entities group by 1),
s as (select distinct {_STRIP.format("storage_key")} k from memory_snapshots where storage_key is not null),
mr as (
  select 'memory_entities' tbl, 'memory_key' ref_field, id, {_STRIP.format("memory_key")} k, created_at from memory_entities
  union all select 'memory_relations', 'source_memory_key', id, {_STRIP.format("source_memory_key")}, created_at from memory_relations),
er as (
  select 'memory_relations' tbl, 'src_entity_id' ref_field, id, src_entity_id k, created_at from memory_relations
  union all select 'memory_relations', 'dst_entity_id', id, dst_entity_id, created_at from memory_relations),
x as (
  select tbl, ref_field, mr.id row_id, case when m.k is not null then case when m.c > mr.created_at then 'late' end when s.k is not null then 'deleted' else 'missing' end kind, created_at
  from mr left join m on mr.k = m.k left join s on mr.k = s.k where mr.k <> ''
  union all
  select tbl, ref_field, er.id, case when e.k is null then 'missing' when e.c > er.created_at then 'late' end, created_at
  from er left join e on er.k = e.k where er.k is not null)
select distinct tbl, ref_field, row_id, kind, strftime(created_at at time zone 'UTC', '%Y-%m') ref_month from x where kind is not null
"""

ORACLE = {
    "p1_found": P1_SQL,
    "p4_found": P4_SQL,
    # the removed memories stay known: they were seen
    "p4_state_removed": P4_SQL.replace("from memories where", "from memories where namespace <> 'default' and").replace("from memory_snapshots where storage_key is not null", "from (select storage_key from memory_snapshots union all select storage_key from memories where namespace = 'default') where storage_key is not null"),
    "p4_state_restored": P4_SQL,
    "p4_report": f"select tbl, ref_field, kind, ref_month, count(*) n_refs from ({P4_SQL}) group by all",
}
