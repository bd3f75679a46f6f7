"""Filling fixed-capacity containers by shortest-pack-first over the length histogram (problem 9).

The histogram of sizes has at most ``capacity`` entries whatever the number of items,
so the packing itself is planned on the driver: sizes are placed longest first, each
into the pack that has the most room left, and what is kept is a count per packing
pattern (the multiset of sizes in a pack). Every item then takes its place by its rank
among the items of its size; ranks come from two levels of counting, so that a size
held by a third of all items is not ranked in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm import bpe
from memlake.operators import skew
from memlake.sources.tables import Scratch


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes in a pack, number of such packs)], longest sizes first.

    ``histogram`` counts items by size, 1 <= size <= capacity. For each size, from the
    longest, items go into the open packs with the most room; those that find none open
    new packs, which take as many of the size as they can hold.
    """
    packs: dict[tuple[int, ...], int] = {}
    room: list[tuple[int, tuple[int, ...]]] = []  # the most room first
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if room and -room[0][0] >= size:
                free, pattern = heapq.heappop(room)
                free, n = -free, packs.pop(pattern)
                each = min(free // size, max(1, left // n))
                take = min(n, left // each)
                if take < n:
                    packs[pattern] = n - take
                    heapq.heappush(room, (-free, pattern))
            else:
                free, pattern = capacity, ()
                each = min(free // size, left)
                take = left // each
            more = pattern + (size,) * each
            if more in packs:
                packs[more] += take
            else:
                packs[more] = take
                heapq.heappush(room, (-(free - size * each), more))
            left -= take * each
    return sorted(packs.items(), key=lambda x: (tuple(-s for s in x[0]), x[1]))


def pattern_slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, last rank, first container, items of the size per container, slot of the first in the pack) by pattern.

    The items of one size ranked ``first rank``.. fill the containers from ``first
    container`` on, ``per`` of them into each.
    """
    used: dict[int, int] = {}
    rows, container = [], 0
    for pattern, n in packs:
        for size in dict.fromkeys(pattern):
            per, at = pattern.count(size), used.get(size, 0)
            rows.append((size, at, at + per * n - 1, container, per, pattern.index(size)))
            used[size] = at + per * n
        container += n
    return rows


def _items(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, start, size): the item itself, or its full parts and the rest if it alone exceeds the capacity."""
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    starts = F.when(n > capacity, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = sizes.select(F.col(key).alias("k"), n.alias("n"), F.posexplode(starts).alias("part", "start"))
    return rows.select("k", "part", F.col("start").cast("int").alias("start"), F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("size"))


def pack(spark: SparkSession, sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", least_hot: int = skew.LEAST) -> DataFrame:
    """key, part, start, size, container, slot: every item in a container of ``capacity``.

    Only an item larger than the capacity is divided: ``part`` numbers its pieces from 0
    and ``start`` is a piece's offset in units. Items of size 0 (also null or negative
    sizes) use no room and lie in container 0, slot -1. Equal sizes are ranked by a hash of the
    key, then the key, so the result depends on the data alone; rows delivered twice are
    items of their own. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    scratch = Scratch(spark, "packing")
    items = scratch.write(_items(sizes, key, size, capacity))
    hot = skew.hot_keys(items, "size", least_hot)
    items = skew.salt(items, "size", F.struct("k", "part"), hot)
    counts = items.where(F.col("size") > 0).groupBy("size", "salt").agg(F.count("*").alias("n"))
    counted = counts.collect()  # at most capacity + items / least_hot rows
    offsets, histogram = [], {}
    for s, salt, n in sorted(counted):
        offsets.append((s, salt, histogram.get(s, 0)))
        histogram[s] = histogram.get(s, 0) + n
    packs = plan_packs(histogram, capacity)
    offset = spark.createDataFrame(offsets, "size int, salt int, before long")
    slots = spark.createDataFrame(pattern_slots(packs), "size int, lo long, hi long, container long, per long, slot int")
    # rank r of size s sits in the pattern whose ranks reach furthest below r: patterns are runs of ranks
    runs = slots.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "container", "per", "slot"))).alias("runs"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(F.xxhash64("k", "part"), "k", "part")) - 1
    ranked = items.withColumn("r", rank.cast("long"))
    # both sides are bounded by the capacity, not by the number of items
    ranked = ranked.join(F.broadcast(offset), ["size", "salt"], "left").join(F.broadcast(runs), "size", "left")
    at = F.filter("runs", lambda x: (x["lo"] <= F.col("r") + F.col("before")) & (x["hi"] >= F.col("r") + F.col("before")))[0]
    ranked = ranked.withColumn("at", at).withColumn("r", F.col("r") + F.col("before") - F.col("at.lo"))
    container = F.coalesce(F.col("at.container") + F.expr("r div at.per"), F.lit(0))
    slot = F.coalesce(F.col("at.slot") + F.expr("cast(r % at.per as int)"), F.lit(-1))
    return ranked.select(F.col("k").alias(key), "part", "start", "size", container.cast("long").alias("container"), slot.cast("int").alias("slot"))


def pack_documents(df: DataFrame, capacity: int = 2048, text: str = "text", key: str = "doc_id", vocabulary: str = bpe.BYTE_BPE_50K) -> DataFrame:
    """``pack`` of texts by their number of tokens."""
    return pack(df.sparkSession, bpe.token_counts(df, text, key, vocabulary), capacity, key)


def pack_report(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_items, used, unused, fill (share of the room that is used)."""
    by = packed.where(F.col("size") > 0).groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    r = by.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("s"), F.lit(0)).alias("used"))
    room = F.col("n_containers") * capacity
    return r.withColumn("unused", room - F.col("used")).withColumn("fill", F.round(F.col("used") / F.greatest(room, F.lit(1)), 6))
