"""Hot keys: found exactly by partial counts, divided into shares that a task can hold.

A key is hot when it holds more than ``least`` rows, which is what one task should
hold; it is divided into one share per threshold, so shares stay of one size however
large the key. Hot keys are kept as (64-bit hash, number of shares), twelve bytes each.
By the pigeonhole principle there are at most total / threshold of them, and about as
many shares in all; the threshold rises above ``least`` only where that would pass
``MAX_HOT`` (beyond ``least * MAX_HOT`` = 10^10 rows, where a task gets total / 10^5), so
the list that is sent to all tasks is never longer than ``MAX_HOT``. A cold key that
shares a hot key's hash is divided needlessly, no more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT = 100_000
LEAST = 100_000


@dataclass(frozen=True)
class HotKeys:
    """``table``: (_hot, salts), at most ``MAX_HOT`` rows; ``n`` is their number."""

    table: DataFrame
    n: int


def hot_threshold(total: int, least: int = LEAST) -> int:
    return max(least, -(-total // MAX_HOT))


def from_counts(counts: DataFrame, key: str, total: int, least: int = LEAST) -> HotKeys | None:
    """Hot keys of a table (``key``, n) with one row per key; None if there is none."""
    if total < least:
        return None
    most = hot_threshold(total, least)
    hot = counts.where(F.col(key).isNotNull() & (F.col("n") >= most))
    rows = hot.select(F.xxhash64(key).alias("_hot"), F.ceil(F.col("n") / most).cast("int").alias("salts")).toArrow()  # at most MAX_HOT rows
    if not rows.num_rows:
        return None
    table = counts.sparkSession.createDataFrame(rows).groupBy("_hot").agg(F.max("salts").alias("salts"))
    return HotKeys(table, rows.num_rows)


def hot_keys(df: DataFrame, key: str, least: int = LEAST, total: int | None = None) -> HotKeys | None:
    """Values of ``key`` that hold at least ``hot_threshold`` rows. Nulls are never hot.

    Fewer rows than ``least`` in all cannot have one, which saves the aggregation.
    ``total`` is the number of rows (or an upper bound of it), where known.
    """
    df = df.select(key)
    total = df.count() if total is None else total
    if total < least:
        return None
    return from_counts(df.groupBy(key).agg(F.count("*").alias("n")), key, total, least)


def mark(df: DataFrame, key: str, hot: HotKeys | None) -> DataFrame:
    """Adds ``salts``: the number of shares of a hot key, null for all others."""
    if hot is None:
        return df.withColumn("salts", F.lit(None).cast("int"))
    return df.withColumn("_hot", F.xxhash64(key)).join(F.broadcast(hot.table), "_hot", "left").drop("_hot")


def salt(df: DataFrame, key: str, by: Column, hot: HotKeys | None) -> DataFrame:
    """Adds ``salt``: 0, or for hot keys the share that ``by`` falls into."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    share = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("salts").cast("long")).cast("int"))
    return mark(df, key, hot).withColumn("salt", share).drop("salts")


def replicate(df: DataFrame, key: str, hot: HotKeys | None) -> DataFrame:
    """Adds ``salt``: every row once with 0, rows of hot keys once per share."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    return mark(df, key, hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def salted_join(big: DataFrame, small: DataFrame, key: str, by: Column, hot: HotKeys | None, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``small`` has one row per key and ``big`` may hold hot ones."""
    if hot is None:
        return big.join(small, key, how)
    return salt(big, key, by, hot).join(replicate(small, key, hot), [key, "salt"], how).drop("salt")
