"""Running sums and ranks of groups of any size, on two levels.

Rows are range-partitioned by group and order, so a group with a third of all rows lies
in many partitions; what a partition adds to its group is summed first, then each row
gets the sum before its partition plus that within it. No task sorts a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.tables import Scratch


def running_sum(df: DataFrame, by: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the group's rows up to this one. ``order`` should tell rows apart; a null group is a group."""
    scratch = Scratch(df.sparkSession, "ranks")
    parts = df.withColumn("_amount", amount).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    rows = scratch.write(parts)  # the ranges are drawn from a sample: both uses must see the same ones
    sums = rows.groupBy(*by, "_part").agg(F.sum("_amount").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), before.alias("_before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_p"))
    own = F.sum("_amount").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(sums, same).withColumn(name, own + F.col("_before")).select(*df.columns, name)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: the row's number in its group from 1."""
    return running_sum(df, by, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def nearest_ranks(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and, named as in ``shares``, the value at place int(n * share) of the ascending values (the last one at most): no interpolation. Null values do not count.

    Equal values are counted first, so a value that most rows have is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    upto = running_sum(counts, [by], [F.col(value).asc()], F.col("_n"), "_upto")
    total = counts.groupBy(F.col(by).alias("_g")).agg(F.sum("_n").alias("n"))
    rows = upto.join(total, F.col(by).eqNullSafe(F.col("_g")))
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    pick = [F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()]
    return rows.groupBy(by).agg(F.max("n").alias("n"), *pick)
