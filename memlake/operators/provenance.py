"""Evidence links, observations and conflict ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH_RISK = r"(?i)(password|secret|payment|legal|medical|security)"


def live_evidence(links: DataFrame, sources: DataFrame, on: str) -> DataFrame:
    """Links whose source still exists (semi join)."""
    return links.join(sources.select(on).distinct(), on, "left_semi")


def unsupported(targets: DataFrame, links: DataFrame, sources: DataFrame, target: str, source: str) -> DataFrame:
    """Targets that have links but none with a living source (anti join)."""
    linked = links.select(target).distinct()
    alive = live_evidence(links, sources, source).select(target).distinct()
    return targets.join(linked, target, "left_semi").join(alive, target, "left_anti")


def flag_unsupported(targets: DataFrame, links: DataFrame, sources: DataFrame, target: str, source: str) -> DataFrame:
    gone = unsupported(targets, links, sources, target, source).select(target).withColumn("gone", F.lit(True))
    return targets.join(gone, target, "left").withColumn("unsupported", F.coalesce("gone", F.lit(False))).drop("gone")


def expand_evidence(results: DataFrame, links: DataFrame, key: str, per: int, budget: int, text: str, *order: Column) -> DataFrame:
    """At most ``per`` pieces of evidence per result and ``budget`` characters in all of them; the last may be cut."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = results.join(links, key).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per)
    rows = rows.withColumn("before", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    room = F.greatest(F.lit(0), F.lit(budget) - F.coalesce("before", F.lit(0)))
    return rows.withColumn("piece", F.substr(text, F.lit(1), room.cast("int"))).where(F.length("piece") > 0).drop("before")


def valid_observations(df: DataFrame, at: Column) -> DataFrame:
    return df.where((F.col("observed_at") <= at) & (F.col("expires_at") > at))


def latest_observation(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by("value_json", F.struct("observed_at", "event_id")).alias("value_json"), F.max("observed_at").alias("observed_at"), F.count("*").alias("n"))


def observation_conflicts(df: DataFrame, *by: str) -> DataFrame:
    """Subjects and predicates with several values at a time; high-risk ones never resolve by themselves."""
    g = df.groupBy(*by).agg(F.countDistinct("value_json").alias("n_values"), F.count("*").alias("n")).where("n_values > 1")
    return g.withColumn("auto", ~F.concat_ws(" ", *by).rlike(HIGH_RISK))


def ranked_candidates(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """Candidates ranked lexicographically; a tie for the first place stays open."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = df.withColumn("rank", F.rank().over(w))
    return r.withColumn("open", F.count_if(F.col("rank") == 1).over(Window.partitionBy(*by)) > 1)


def risk(proposal: Column) -> Column:
    return F.when(proposal == "expire_projection", "low").when(proposal.isin("supersede", "dedup_merge", "delete", "rule_change", "identity"), "high").otherwise("high")
