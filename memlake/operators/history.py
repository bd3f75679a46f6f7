"""History of changing attributes, from readings taken at snapshots (problem 1).

Presence bitmaps: the readings of an entity, in order of their start, are the
positions of a bitmap; every attribute state (hash) has its own bitmap with a bit
for each reading that showed it. A run of consecutive bits is a period in which the
state held; a gap in a state's bitmap ends its run, and a later run is a period of its
own. By the problem's definition exports that did not see an entity are no readings
of it, so positions count its readings, not all exports.

Scale: one shuffle on (entity, slice). Cold entities have a single slice; a hot
entity (see ``skew``) is cut at its start quantiles into slices of about equal size,
whose border runs (two per slice) are stitched afterwards. Bitmaps are words of 64
bits, so no group collects more than 64 readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import skew

STATE = ("content_hash", "type", "tier", "confidence", "paused")
WORD = 64
#: Quantiles of a hot entity; it is cut at as many of them as it has shares.
SLICES = 1000


def reading_start(updated: str = "updated_at", created: str = "created_at") -> Column:
    """Microseconds at which a reading starts: ``updated`` unless null or before ``created``, else ``created``."""
    u, c = F.col(updated), F.col(created)
    return F.unix_micros(F.when(u.isNotNull() & (c.isNull() | (u >= c)), u).otherwise(c))


def state_hash(columns: tuple[str, ...] = STATE) -> Column:
    """64-bit hash of the attributes; nulls keep their place, so (null, x) and (x, null) differ."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def readings(snapshots: DataFrame, present: DataFrame, key: str = "storage_key", state: tuple[str, ...] = STATE) -> DataFrame:
    """(mem_key, start_us, prio, snap_us, load_us, state, version) of both tables.

    Rows with a null key, and rows whose start is null (both times null), belong to
    no place in a history and are left out; a snapshot of the latter kind still counts
    for the entity's latest ``snapshot_at`` (it stays with a null start until then).
    """
    common = [F.col(key).alias("mem_key"), reading_start().alias("start_us")]
    rest = [state_hash(state).alias("state"), F.col("version").cast("int").alias("version")]
    old = snapshots.select(*common, F.lit(0).alias("prio"), F.unix_micros("snapshot_at").alias("snap_us"), F.unix_micros("loaded_at").alias("load_us"), *rest)
    new = present.select(*common, F.lit(1).alias("prio"), F.lit(None).cast("long").alias("snap_us"), F.lit(None).cast("long").alias("load_us"), *rest)
    return old.unionByName(new).where(F.col("mem_key").isNotNull())


def _slices(rows: DataFrame, least: int) -> DataFrame | None:
    """(mem_key, cuts, h_snap, h_live) of the hot entities, or None."""
    hot = skew.hot_keys(rows, "mem_key", least)
    if hot is None:
        return None
    at = [i / SLICES for i in range(1, SLICES)]
    by = skew.mark(rows, "mem_key", hot).where("salts is not null").groupBy("mem_key", "salts")
    cuts = by.agg(F.percentile_approx("start_us", at, 10_000).alias("q"), F.max("snap_us").alias("h_snap"), F.max("prio").alias("h_live"))
    step = F.greatest(F.lit(1), F.floor(F.lit(SLICES) / F.col("salts")))
    return cuts.select("mem_key", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("cuts"), "h_snap", "h_live")


def validity_periods(snapshots: DataFrame, present: DataFrame, key: str = "storage_key", state: tuple[str, ...] = STATE, least_hot: int = skew.LEAST) -> DataFrame:
    """One row per period of one state: mem_key, version, valid_from_us, valid_to_us.

    Of readings with one start that of ``present`` counts, else the latest
    ``snapshot_at``, then ``loaded_at`` (nulls last); remaining ties are settled by the
    larger state hash, so the result does not depend on the order of rows. ``version``
    is the lowest of the period (null if all are). The last period ends at -1 if the
    entity is in ``present``, else at its latest ``snapshot_at`` (null if all are null).
    Repeated rows change nothing; empty tables give an empty result; further columns
    of either table are ignored.
    """
    rows = readings(snapshots, present, key, state)
    cuts = _slices(rows, least_hot)
    none = F.lit(None).cast("long")
    if cuts is None:
        rows = rows.select("*", F.lit(0).alias("slice"), none.alias("h_snap"), F.lit(None).cast("int").alias("h_live"))
        part = ["mem_key"]
    else:  # at most skew.MAX_HOT entities
        rows = rows.join(F.broadcast(cuts), "mem_key", "left")
        rows = rows.withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x <= F.col("start_us"))))).drop("cuts")
        part = ["mem_key", "slice"]
    rows = rows.repartition(*part)
    own = list(dict.fromkeys([*part, "slice"]))

    best = F.max(F.struct("prio", "snap_us", "load_us", "state", "version"))
    one = rows.groupBy(*own, "start_us").agg(best.alias("r"), F.max("snap_us").alias("snap"), F.max("prio").alias("live"), F.max("h_snap").alias("h_snap"), F.max("h_live").alias("h_live"))
    whole = Window.partitionBy(*part)
    # of a hot entity the latest snapshot is that of all its slices
    one = one.select(*own, "start_us", "r.state", "r.version", F.coalesce("h_snap", F.max("snap").over(whole)).alias("snap"), F.coalesce("h_live", F.max("live").over(whole)).alias("live"))
    one = one.where(F.col("start_us").isNotNull())

    one = one.withColumn("nth", F.row_number().over(whole.orderBy("start_us")) - 1)
    bits = one.groupBy(*own, "snap", "live", F.expr(f"nth div {WORD}").alias("word"), "state").agg(
        F.expr(f"bit_or(shiftleft(1L, cast(nth % {WORD} as int)))").alias("bm"),
        F.collect_list(F.struct((F.col("nth") % WORD).alias("bit"), "start_us", "version")).alias("cells"),
    )
    # a run starts at a set bit whose lower neighbour is not set; its length is the number of trailing ones from there
    runs = bits.withColumn("at", F.expr(f"explode(filter(sequence(0, {WORD - 1}), i -> (shiftrightunsigned(bm & ~shiftleft(bm, 1), i) & 1L) = 1L))"))
    runs = runs.withColumn("upto", F.expr("at + bit_count((~shiftrightunsigned(bm, at) & (shiftrightunsigned(bm, at) + 1L)) - 1L) - 1"))
    runs = runs.withColumn("own", F.expr("filter(cells, c -> c.bit between at and upto)")).select(
        *own, "snap", "live", "state", F.expr(f"word * {WORD} + at").alias("a"), F.expr(f"word * {WORD} + upto").alias("b"),
        F.expr("array_min(transform(own, c -> c.start_us))").alias("since"), F.expr("array_min(transform(own, c -> c.version))").alias("version"),
    )
    # bits that are consecutive across the border of two words of one state's bitmap are one run
    bitmap = Window.partitionBy(*part, "state").orderBy("a")
    runs = runs.withColumn("run", F.sum(F.when(F.lag("b").over(bitmap) + 1 == F.col("a"), 0).otherwise(1)).over(bitmap))
    runs = runs.groupBy(*own, "snap", "live", "run", "state").agg(F.min("a").alias("a"), F.min("since").alias("since"), F.min("version").alias("version"))
    runs = runs.withColumn("until", F.lead("since").over(whole.orderBy("a")))
    if cuts is not None:
        runs = _stitched(runs)
    last = F.when(F.col("live") == 1, F.lit(-1)).otherwise(F.col("snap"))
    return runs.select("mem_key", F.col("version").cast("int").alias("version"), F.col("since").alias("valid_from_us"), F.coalesce("until", last).cast("long").alias("valid_to_us"))


def _stitched(runs: DataFrame) -> DataFrame:
    """Joins the runs of sliced entities across slice borders: only the first and last run of each slice take part."""
    runs = runs.withColumn("border", F.col("until").isNull() | (F.col("a") == 0))
    inner = runs.where(~F.col("border")).select("mem_key", "version", "since", "until", "snap", "live")
    by = Window.partitionBy("mem_key").orderBy("since")
    edge = runs.where("border").withColumn("until", F.coalesce("until", F.lead("since").over(by)))
    same = (F.lag("state").over(by) == F.col("state")) & (F.lag("slice").over(by) != F.col("slice"))
    edge = edge.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(by))
    edge = edge.groupBy("mem_key", "island", "snap", "live").agg(F.min("version").alias("version"), F.min("since").alias("first"), F.max(F.struct("since", "until"))["until"].alias("until"))
    return inner.unionByName(edge.select("mem_key", "version", F.col("first").alias("since"), "until", "snap", "live"))
