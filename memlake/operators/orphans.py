"""References to records that do not exist (problem 4).

Every change contributes signed counts to its key: a referring row +1 reference
(-1 when it is removed), a target row +1 existence (-1 when it is removed). The
counts of all changes add up, in any order and in any batches, to the present
state; keys with references and no existence are the orphans. Existence is counted per
key and time of creation, so that a removal takes back exactly the target it names: if a
target is deleted and created anew, references made in between are late again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import key_form
from memlake.operators import skew

#: A target without created_at counts as older than any reference.
OLDEST = -(2**63)


def reference_rows(df: DataFrame, tbl: str, fields: dict[str, str], row_id: str = "id") -> DataFrame:
    """(tbl, ref_field, row_id, key, at_us, ref_month) of each non-blank reference.

    ``fields`` names each referring column and the space its keys live in; keys are
    compared stripped and in lower case. The columns are unpivoted in one pass.
    """
    each = [F.struct(F.lit(f).alias("ref_field"), _key(F.col(f).cast("string"), space).alias("key")) for f, space in fields.items()]
    at = F.col("created_at")
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.unix_micros(at).alias("at_us"), F.date_format(at, "yyyy-MM").alias("ref_month"), F.explode(F.array(*each)).alias("x"))
    return rows.select(F.lit(tbl).alias("tbl"), "x.ref_field", "row_id", "x.key", "at_us", "ref_month").where(F.col("key").isNotNull())


def _key(c: Column, space: str) -> Column:
    form = key_form(c)
    return F.when(form != "", F.concat(F.lit(f"{space}:"), form))


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Signed reference counts of referring rows (``sign`` -1 for removed ones)."""
    return refs.select("key", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exist"), F.lit(None).cast("long").alias("born_us"), F.col("at_us").alias("ref_us"), F.lit(False).alias("seen"))


def existence_deltas(df: DataFrame, column: str, space: str, sign: int = 1, born: str | None = "created_at") -> DataFrame:
    """Signed existence counts of target rows; ``sign`` 0 only tells that a key was seen once, -1 also does."""
    key = _key(F.col(column).cast("string"), space)
    at = F.coalesce(F.unix_micros(born), F.lit(OLDEST)) if born and sign else F.lit(None).cast("long")
    rows = df.select(key.alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exist"), at.alias("born_us"), F.lit(None).cast("long").alias("ref_us"), F.lit(sign <= 0).alias("seen"))
    return rows.where(F.col("key").isNotNull())


def key_counts(*deltas: DataFrame) -> DataFrame:
    """State per key and time of creation (null for references): refs, exist (both signed sums), the earliest reference, whether it was ever seen.

    States are deltas themselves: ``key_counts(state, new_deltas)`` maintains the report
    from changes alone, in any order. Sums combine before the shuffle, so a hot key costs
    one row a task. ``ref_us`` is a lower bound once references have been removed, which
    only keeps a key among those that are looked at row by row.
    """
    rows = reduce(DataFrame.unionByName, deltas)
    return rows.groupBy("key", "born_us").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"), F.min("ref_us").alias("ref_us"), F.max("seen").alias("seen"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """key, refs, exist, born_us (of the earliest target there is), seen: keys that some reference finds missing: none exists, or the first was born after the first reference."""
    by = state.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"), F.min(F.when(F.col("exist") > 0, F.col("born_us"))).alias("born_us"), F.min("ref_us").alias("ref_us"), F.max("seen").alias("seen"))
    return by.where((F.col("refs") > 0) & ((F.col("exist") <= 0) | (F.col("born_us") > F.col("ref_us"))))


def orphan_references(refs: DataFrame, state: DataFrame, least_hot: int = skew.LEAST) -> DataFrame:
    """tbl, ref_field, row_id, kind, ref_month: one row per reference without a valid target.

    ``kind`` is 'late' (every target was created after the reference), 'deleted' (none
    exists, the key was seen before) or 'missing'. A reference or target without a time
    is never late; ``ref_month`` of a reference without one is null. Blank and null
    references refer to nothing; rows delivered twice come out once.
    """
    bad = orphan_keys(state).select("key", "exist", "born_us", "seen")
    hot = skew.hot_keys(refs, "key", least_hot)
    rows = skew.salted_join(refs, bad, "key", F.col("row_id"), hot)
    gone = F.col("exist") <= 0
    kind = F.when(gone & F.col("seen"), "deleted").when(gone, "missing").when(F.col("born_us") > F.col("at_us"), "late")
    return rows.select("tbl", "ref_field", "row_id", kind.alias("kind"), "ref_month").where(F.col("kind").isNotNull()).distinct()


def memory_references(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``reference_rows`` of the memory graph: entities and relations, to memories and entities."""
    return reference_rows(entities, "memory_entities", {"memory_key": "memories"}).unionByName(
        reference_rows(relations, "memory_relations", {"source_memory_key": "memories", "src_entity_id": "entities", "dst_entity_id": "entities"})
    )


def memory_state(memories: DataFrame, snapshots: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of the memory graph with every row of the tables as an insertion; snapshots only tell what was seen."""
    return key_counts(
        reference_deltas(memory_references(entities, relations)),
        existence_deltas(memories, "storage_key", "memories"),
        existence_deltas(entities, "id", "entities"),
        existence_deltas(snapshots, "storage_key", "memories", sign=0),
    )


def memory_orphans(memories: DataFrame, snapshots: DataFrame, entities: DataFrame, relations: DataFrame, least_hot: int = skew.LEAST) -> DataFrame:
    """``orphan_references`` of the memory graph: entities and relations against memories and entities."""
    return orphan_references(memory_references(entities, relations), memory_state(memories, snapshots, entities, relations), least_hot)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, kind and month."""
    return orphans.groupBy("tbl", "ref_field", "kind", "ref_month").agg(F.count("*").alias("n_refs"))
