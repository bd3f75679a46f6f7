"""The write path as plans: what storing, updating, correcting and consolidating do to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.operators import analytics as A


def new_records(incoming: DataFrame, existing: DataFrame, key: str = "storage_key") -> DataFrame:
    """Incoming records (namespace, type, content, raw_text, confidence, tier, created_at) that are stored, with all derived fields.

    Of one namespace and content hash the first by time, then text, is stored, if none exists yet. Keys,
    times of expiry and importance are derived; versions start at 1 in a chain of their own.
    """
    h = L.content_hash("content", "type")
    first = F.min_by(F.struct(*incoming.columns), F.struct("created_at", F.coalesce("raw_text", F.lit("")), "confidence"))
    rows = incoming.withColumn("content_hash", h).groupBy("namespace", "content_hash").agg(first.alias("r"))
    seen = existing.select("namespace", h.alias("content_hash")).distinct()
    rows = rows.join(seen, ["namespace", "content_hash"], "left_anti").select("content_hash", "r.*")
    tag = F.substring(L.content_hash("namespace"), 1, 6)
    name = F.concat_ws("_", F.lit("cm"), tag, F.date_format("created_at", "yyyyMMddHHmmss"), F.substring("content_hash", 1, 8))
    return rows.withColumns({
        key: name, "expires_at": S.expiry("created_at", "tier"), "importance_score": S.importance("confidence", "type", F.lit(0.0), F.lit(0)), "access_count": F.lit(0), "version": F.lit(1),
        "memory_nature": S.memory_nature("type"), "suggested_action": S.suggested_action("confidence"),
    })


def filled(incoming: DataFrame, existing: DataFrame, key: str = "storage_key") -> DataFrame:
    """(key, raw_text): existing records without a raw text that get one from an equal incoming record, the earliest that has one."""
    h = L.content_hash("content", "type")
    empty = existing.where(F.coalesce(F.trim("raw_text"), F.lit("")) == "").select(key, "namespace", h.alias("h"))
    given = incoming.where(F.coalesce(F.trim("raw_text"), F.lit("")) != "").groupBy("namespace", h.alias("h")).agg(F.min_by("raw_text", F.struct("created_at", "raw_text")).alias("raw_text"))
    return empty.join(given, ["namespace", "h"]).select(key, "raw_text")


def remember(incoming: DataFrame, existing: DataFrame, key: str = "storage_key") -> DataFrame:
    """New records with what they supersede: the record's fields, ``supersedes`` (key or null), ``version_chain_id`` and ``version_number``.

    A chain is named by the record it began with and a version counts the records that were
    superseded on the way there; of records stored together the later supersedes the earlier.
    """
    new = new_records(incoming, existing, key)
    common = [key, "namespace", "type", "content", "created_at"]
    every = existing.select(*common, F.lit(False).alias("new")).unionByName(new.select(*common, F.lit(True).alias("new")))
    pairs = A.supersede_candidates(every.where("type <> 'session_summary'"), key)
    pairs = pairs.join(new.select(F.col(key).alias("new_key")), "new_key", "left_semi")
    old = existing.select(F.col(key).alias("old_key"), F.coalesce("version_chain_id", key).alias("old_chain"), F.coalesce("version_number", F.lit(1)).alias("old_number"))
    link = pairs.join(old, "old_key", "left").select(F.col("new_key").alias(key), F.col("old_key").alias("supersedes"), "old_chain", "old_number")
    rows = new.join(link, key, "left")
    return rows.withColumns({"version_chain_id": F.coalesce("old_chain", "supersedes", key), "version_number": F.coalesce(F.col("old_number") + 1, F.when(F.col("supersedes").isNotNull(), 2), F.lit(1))}).drop("old_chain", "old_number")


def update(existing: DataFrame, changes: DataFrame, at: Column, key: str = "storage_key") -> tuple[DataFrame, DataFrame]:
    """(records, versions): records with the changed content (``key``, ``content``), hashed anew and their version one higher; and the state each had before."""
    new = changes.groupBy(key).agg(F.max("content").alias("new_content"))
    rows = existing.join(new, key, "left")
    changed = F.col("new_content").isNotNull() & ~F.col("new_content").eqNullSafe(F.col("content"))
    versions = rows.where(changed).select(key, "version", "content", "content_hash", at.alias("replaced_at"))
    pick = lambda c, x: F.when(changed, x).otherwise(F.col(c)).alias(c)
    keep = [c for c in existing.columns if c not in ("content", "content_hash", "version", "updated_at")]
    after = rows.select(*keep, pick("content", F.col("new_content")), pick("content_hash", L.content_hash("new_content", "type")), pick("version", F.col("version") + 1), pick("updated_at", at))
    return after, versions


def keyword_set(c: Column | str) -> Column:
    """Lower-case Latin words and numbers, and single CJK characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.concat(L.matches(F.lower(c), r"[a-z]{2,}|[0-9]+"), L.matches(c, L.CJK)))


def similar_corrections(a: Column, b: Column, threshold: float = 0.7) -> Column:
    """0.6 Jaccard of keywords and 0.4 if the texts share a number or a proper noun reach the threshold."""
    named = lambda c: F.concat(L.matches(c, r"[0-9]+"), L.matches(c, r"\b[A-Z][a-zA-Z]+\b"))
    bonus = F.when(F.arrays_overlap(named(a), named(b)), 0.4).otherwise(0.0)
    return (F.size(keyword_set(a)) > 0) & (F.size(keyword_set(b)) > 0) & (0.6 * L.jaccard(keyword_set(a), keyword_set(b)) + bonus >= threshold - 1e-9)


def correction_targets(df: DataFrame, key: str = "storage_key", last: int = 10, least: int = 2) -> DataFrame:
    """(correction, target): the newest of the ``last`` records before a correction in its namespace that share at least ``least`` words of two letters and more with it."""
    w = Window.partitionBy("namespace").orderBy("created_at", key).rowsBetween(-last, -1)
    rows = df.withColumn("words", F.filter(L.space_tokens("content"), lambda x: F.length(x) > 1))
    rows = rows.withColumn("before", F.collect_list(F.struct(F.col(key).alias("k"), "type", "words")).over(w)).where("type = 'correction'")
    hit = F.filter("before", lambda o: o["type"].isin("user_preference", "decision", "fact_declaration") & (F.size(F.array_intersect(F.col("words"), o["words"])) >= least))
    return rows.withColumn("hit", hit).where(F.size("hit") > 0).select(F.col(key).alias("correction"), F.element_at("hit", -1)["k"].alias("target"))


def consolidated(df: DataFrame, duplicates: DataFrame, now: Column, key: str = "storage_key") -> DataFrame:
    """(key, new_confidence, action): a whole consolidation run applied. A duplicate (column ``older_key``) is superseded by its newer copy, what decayed is forgotten or lowered, the rest is kept."""
    plan = A.consolidation(df, now)
    gone = duplicates.select(F.col("older_key").alias(key)).distinct().withColumn("dup", F.lit(True))
    rows = plan.join(gone, key, "left")
    act = F.when(F.col("dup"), "supersede").otherwise(F.col("action"))
    return rows.select(key, F.when(act == "decay", F.col("new_confidence")).alias("new_confidence"), act.alias("action"))


def session_summaries(df: DataFrame, session: str) -> DataFrame:
    """One record per session: number, confidence 0.95 of the lowest, lowest tier, most frequent type (the smallest of equals)."""
    each = df.groupBy("namespace", session, "type").agg(F.count("*").alias("n"), F.min("confidence").alias("c"), F.min("tier").alias("tier"))
    by = each.groupBy("namespace", session).agg(F.sum("n").alias("n"), F.round(0.95 * F.min("c"), 6).alias("confidence"), F.min("tier").alias("tier"), F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    return by.select("namespace", session, "n", "type", "confidence", "tier")


def session_lines(df: DataFrame, session: str, key: str = "storage_key") -> DataFrame:
    """The lines of each session's summary, one per row: first sentences of corrections, decisions, preferences and facts in order of time."""
    told = df.where(F.col("type").isin("correction", "decision", "user_preference", "fact_declaration"))
    w = Window.partitionBy("namespace", session).orderBy("created_at", key)
    return told.select("namespace", session, key, F.row_number().over(w).alias("line_no"), F.concat(F.lit("- "), L.summary("content", 2)).alias("line"))
