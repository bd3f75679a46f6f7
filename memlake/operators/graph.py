"""Entity graph: mentions, relations, walks, components, reinforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import key_form
from memlake.operators import skew
from memlake.sources.tables import Scratch


def recall_by_entity(records: DataFrame, mentions: DataFrame, entity: str) -> DataFrame:
    """Records that mention the entity (case aside), each once."""
    hit = mentions.where(F.lower("entity_text") == entity.lower()).select(F.col("memory_key").alias("storage_key")).distinct()
    return records.join(hit, "storage_key", "left_semi")


def named_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations with the names of both ends; ends without a record are left out."""
    ends = mentions.select("id", "entity_text").dropDuplicates(["id"])
    src = ends.select(F.col("id").alias("src_entity_id"), F.col("entity_text").alias("src"))
    dst = ends.select(F.col("id").alias("dst_entity_id"), F.col("entity_text").alias("dst"))
    return relations.dropDuplicates(["id"]).join(src, "src_entity_id").join(dst, "dst_entity_id")


def recall_by_relation(records: DataFrame, relations: DataFrame, mentions: DataFrame, relation_type: str) -> DataFrame:
    """Distinct (storage_key, src, dst, weight) of records behind relations of a type."""
    named = named_relations(relations.where(F.col("relation_type") == relation_type), mentions)
    rec = records.select("storage_key").distinct()
    return named.join(rec, named.source_memory_key == rec.storage_key).select("storage_key", "src", "dst", "weight").distinct()


def entity_listing(mentions: DataFrame) -> DataFrame:
    return mentions.dropDuplicates(["id"]).groupBy("entity_text", "entity_type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def graph_stats(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    a = mentions.agg(F.countDistinct("entity_text").alias("n_entities"), F.countDistinct("memory_key").alias("n_memories"))
    return a.crossJoin(relations.agg(F.countDistinct("id").alias("n_relations")))  # one row each


def impact(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """memory_key, n_entities, n_relations, impact: 0.4 per entity and relation, 0.2 for more than one namespace."""
    m = mentions.where("memory_key is not null").groupBy("memory_key").agg(F.countDistinct("entity_text").alias("n_entities"), F.countDistinct("namespace").alias("n_ns"))
    r = relations.where("source_memory_key is not null").groupBy(F.col("source_memory_key").alias("memory_key")).agg(F.countDistinct("id").alias("n_relations"))
    both = m.join(r, "memory_key", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))
    score = 0.4 * F.col("n_entities") + 0.4 * F.col("n_relations") + F.when(F.col("n_ns") > 1, 0.2).otherwise(0.0)
    return both.select("memory_key", "n_entities", "n_relations", F.round(score, 6).alias("impact"))


def co_occurrence(mentions: DataFrame, memory: Column, entity: Column, least: int = 2, most: int = 5_000) -> DataFrame:
    """(a < b, n): entity pairs that share at least ``least`` memories. Repeated mentions count once.

    A memory with ``most`` entities and more is divided into shares, each of which meets all
    entities of the memory, so its pairs come from many tasks.
    """
    m = mentions.select(memory.alias("m"), entity.alias("e")).where("m is not null and e is not null").distinct()
    hot = skew.hot_keys(m, "m", most)
    x, y = skew.salt(m, "m", F.col("e"), hot).alias("x"), skew.replicate(m, "m", hot).alias("y")
    both = x.join(y, (F.col("x.m") == F.col("y.m")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.e") < F.col("y.e")))
    return both.groupBy(F.col("x.e").alias("a"), F.col("y.e").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shared_sources(mentions: DataFrame, records: DataFrame, most: int = 20) -> DataFrame:
    """namespace, a, b, source_key, source_hash: the memories in which two entities (a < b, case aside) of a namespace occur together, the first ``most`` by key as evidence of each pair."""
    m = mentions.where(F.trim("memory_key") != "").select("namespace", F.col("memory_key").alias("k"), F.lower("entity_text").alias("e")).where("e is not null").distinct()
    x, y = m.alias("x"), m.alias("y")
    both = x.join(y, (F.col("x.namespace") == F.col("y.namespace")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.e") < F.col("y.e"))).select("x.namespace", F.col("x.e").alias("a"), F.col("y.e").alias("b"), "x.k")
    rows = both.join(records.select(F.col("storage_key").alias("k"), F.col("content_hash").alias("source_hash")), "k")
    w = Window.partitionBy("namespace", "a", "b").orderBy("k")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("namespace", "a", "b", F.col("k").alias("source_key"), "source_hash")


def derived_facts(pairs: DataFrame) -> DataFrame:
    c = F.round(F.least(F.lit(0.6), 0.3 + 0.05 * F.col("n")), 6)
    return pairs.select("a", "b", c.alias("confidence"), F.concat(F.col("a").cast("string"), F.lit(" co-occurs with "), F.col("b").cast("string")).alias("fact"))


def reinforced_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, weight): 0.1 more (at most 2) where the edge exists, else a new edge of 0.1 per occurrence (at most 2)."""
    e = edges.groupBy("a", "b").agg(F.max("weight").alias("old"))
    w = F.when(F.col("old").isNotNull(), F.least(F.col("old") + 0.1, F.lit(2.0))).otherwise(F.least(0.1 * F.col("n"), F.lit(2.0)))
    return pairs.join(e, ["a", "b"], "left").select("a", "b", F.round(w, 6).alias("weight"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    both = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    return edges.where((F.col(a).isNotNull()) & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.explode(both).alias("x")).select("x.a", "x.b").distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, scratch: Scratch) -> DataFrame:
    """(v, hop): vertices within ``hops`` of the seeds (column v) over undirected edges (a, b), with their distance.

    Each hop joins the frontier only and drops what was seen; frontiers are written tables.
    """
    seen = scratch.write(seeds.select("v", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(edges, frontier.v == edges.a).select(F.col("b").alias("v")).distinct().join(seen.select("v"), "v", "left_anti")
        frontier = scratch.write(step.withColumn("hop", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path_length(edges: DataFrame, source, target, hops: int, scratch: Scratch) -> DataFrame:
    """One row (source, target, hops), hops null if the target is farther than ``hops``; the walk widens from both ends in turn."""
    spark = edges.sparkSession
    lit = lambda v: spark.range(1).select(F.lit(v).cast(edges.schema["a"].dataType).alias("v"))
    near = k_hop(edges, lit(source), hops // 2 + hops % 2, scratch).withColumnRenamed("hop", "h1")
    far = k_hop(edges, lit(target), hops // 2, scratch).withColumnRenamed("hop", "h2")
    n = near.join(far, "v").agg(F.min(F.col("h1") + F.col("h2")).cast("int").alias("hops"))
    return n.select(F.lit(source).alias("source"), F.lit(target).alias("target"), "hops")


def min_label_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): smallest vertex of each component, by repeated minimum over neighbours with label jumping; edges are in both directions. Rounds end when no label changes; there is no cap on them."""
    labels = scratch.write(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("jump"))
        last, labels = labels, scratch.write(step.join(jump, "new", "left").select("v", F.col("label").alias("old"), F.least("new", F.coalesce("jump", "new")).alias("label")))
        done = labels.where("label <> old").isEmpty()
        scratch.drop(last)
        if done:
            return labels.select("v", "label")


def cascade_delete(df: DataFrame, gone: DataFrame, column: str, key: str = "storage_key") -> DataFrame:
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def alias_counts(aliases: DataFrame) -> DataFrame:
    return aliases.dropDuplicates(["id"]).groupBy("canonical_form", "entity_type").agg(F.count("*").alias("alias_count"), F.max("created_at").alias("last_alias"))


def merge_entities(aliases: DataFrame, source: str, target: str) -> DataFrame:
    """Aliases with one canonical form repointed to another, without repeats and without a form that is its own alias."""
    c = F.when(F.col("canonical_form") == source, target).otherwise(F.col("canonical_form"))
    return aliases.withColumn("canonical_form", c).where("canonical_form is distinct from alias_form").select("namespace", "canonical_form", "alias_form").distinct()


def fuzzy_aliases(left: DataFrame, right: DataFrame, least: float = 0.8, apart: int = 3) -> DataFrame:
    """(form, alias_form, ratio): pairs with equal first two letters, type and namespace, lengths at most ``apart`` apart, and a sequence-matcher ratio of ``least`` or more."""
    a = left.select("namespace", "entity_type", key_form("canonical_form").alias("form")).distinct().withColumn("p", F.substring("form", 1, 2))
    b = right.select("namespace", "entity_type", key_form("alias_form").alias("alias_form")).distinct().withColumn("p", F.substring("alias_form", 1, 2))
    both = a.join(b, ["namespace", "entity_type", "p"]).where((F.abs(F.length("form") - F.length("alias_form")) <= apart) & (F.col("form") != F.col("alias_form")))

    # the ratio is 2 m / (length of both) for m matched letters, and m is at most the shared letters with repeats
    bag = lambda c: F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    odd = F.size(F.array_except(bag(F.col("form")), bag(F.col("alias_form"))))
    both = both.where(2 * (F.length("form") - odd) >= least * (F.length("form") + F.length("alias_form")) - 1e-9)

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda p, q: SequenceMatcher(None, p, q).ratio())

    return both.select("namespace", "form", "alias_form", F.round(ratio("form", "alias_form"), 6).alias("ratio")).where(F.col("ratio") >= least)
