"""Rendering of records and prompts, maintenance proposals, inline hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import language as L


def rendered(depth: int = 3) -> Column:
    """One line per record by type; depth 1 and 2 show keywords and the first sentence."""
    if depth < 3:
        return F.concat(F.lit("- "), L.summary("content", depth))
    day = F.concat(F.lit(" ("), F.date_format("created_at", "yyyy-MM-dd"), F.lit(")"))
    text = F.col("content")
    return (
        F.when(F.col("superseded"), F.concat(F.lit('- NOTE: "'), F.substring(text, 1, 80), F.lit('" is outdated'), day))
        .when(F.col("type") == "user_preference", F.concat(F.lit("- [IMPORTANT] The user prefers: "), text))
        .when(F.col("type") == "correction", F.concat(F.lit("- Do not repeat: "), text, day))
        .when(F.col("type") == "decision", F.concat(F.lit("- Always follow: "), text, day))
        .otherwise(F.concat(F.lit("- "), text, day))
    )


def bucket() -> Column:
    return F.when(F.col("superseded"), "outdated").when(F.col("type").isin("correction", "decision", "user_preference"), "mandatory").when(F.col("confidence") >= 0.8, "important").otherwise("optional")


def prompt_lines(df: DataFrame, budget: int, key: str = "storage_key") -> DataFrame:
    """namespace, bucket, key, position of the records that fit into each namespace's token budget, mandatory ones first; three outdated ones at most."""
    order = F.when(F.col("bucket") == "mandatory", 0).when(F.col("bucket") == "important", 1).when(F.col("bucket") == "optional", 2).otherwise(3)
    rows = df.withColumn("bucket", bucket())
    # a record costs at least one token, so no more than ``budget`` of a bucket can fit: the rest goes before anything is summed
    w = Window.partitionBy("namespace", "bucket").orderBy(F.desc("importance_score"), key)
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget).where((F.col("bucket") != "outdated") | (F.col("nth") <= 3))
    run = Window.partitionBy("namespace").orderBy(order, "nth", key)
    rows = rows.withColumn("used", F.sum(L.token_estimate("content")).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(run))
    return rows.where(F.col("used") <= budget).select("namespace", "bucket", key, "position", "used")


def shortened(df: DataFrame, budget: int, by: str, key: str, text: str, protected: Column) -> DataFrame:
    """Protected rows share what the budget (characters) leaves them, cut at the end; others are dropped first. Empty texts always fit.

    Of texts that are not empty no more than ``budget`` can fit, so groups are cut to that many first.
    """
    rows = df.withColumn("p", protected.cast("int")).where(F.col(text).isNotNull())
    w = Window.partitionBy(by).orderBy(F.desc("p"), key)
    some = rows.where(F.length(text) > 0).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget)
    some = some.withColumn("before", F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.greatest(F.lit(0), F.lit(budget) - F.col("before")).cast("int")
    shown = some.where((F.length(text) <= room) | ((F.col("p") == 1) & (room > 0))).select(by, key, F.substr(text, F.lit(1), room).alias("shown"))
    return shown.unionByName(rows.where(F.length(text) == 0).select(by, key, F.lit("").alias("shown")))


def hints(df: DataFrame, stale: Column, conflicting: DataFrame, key: str = "storage_key", cap: int = 20) -> DataFrame:
    """key, hint, change per namespace: stale -0.05, conflict -0.10; at most ``cap`` a namespace, strongest first. Records are not changed."""
    a = df.where(stale).select("namespace", key, F.lit("stale").alias("hint"), F.lit(-0.05).alias("change"))
    b = df.join(conflicting.select(key).distinct(), key, "left_semi").select("namespace", key, F.lit("conflict").alias("hint"), F.lit(-0.10).alias("change"))
    w = Window.partitionBy("namespace").orderBy("change", key)
    return a.unionByName(b).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def proposals(consolidated: DataFrame, floor: float = 0.1, grace_days: int = 7) -> DataFrame:
    """Proposals of a decay run: expiry for what falls below the floor (low risk), nothing else changes by itself."""
    return consolidated.where(F.col("new_confidence") < floor).select("storage_key", F.lit("expire_projection").alias("proposal"), F.lit("low").alias("risk"), F.lit(grace_days).alias("grace_days"))


def access_log(records: DataFrame, log: DataFrame, at: str, throttle: int = 60, key: str = "storage_key") -> DataFrame:
    """Access counts from an event log instead of updates on read: events less than ``throttle`` seconds after the one before count once."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    n = log.withColumn("counts", F.coalesce(gap >= throttle * 1_000_000, F.lit(True))).groupBy(key).agg(F.count_if("counts").alias("new"))
    return records.join(n, key, "left").withColumn("access_count", F.col("access_count") + F.coalesce("new", F.lit(0))).drop("new")


def knowledge(df: DataFrame, context: str, most: int, budget: int, key: str = "doc_id", by: str = "namespace") -> DataFrame:
    """by, key, rel, position, used: per group the most relevant texts (Jaccard of title and text with the context), at most ``most`` and within a token budget for their first 300 characters."""
    asked = F.array_distinct(L.mixed_tokens(F.lit(context)))
    cut = F.substring(F.coalesce("text", F.lit("")), 1, 300)
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    rows = df.select(by, key, L.token_estimate(cut).alias("tokens"), F.round(L.jaccard(L.mixed_tokens(whole), asked), 9).alias("rel"))
    w = Window.partitionBy(by).orderBy(F.desc("rel"), key)
    rows = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)  # cut before the sum, so no group is summed whole
    rows = rows.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= budget).select(by, key, "rel", "position", "used")
