"""Running sums in groups that may be hot: dealt by range, never one task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.cuts import durable


def running_sum(rows: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the sum of `value` over the rows of the same group that come before, by `order`.

    Rows are dealt by range of (group, order), so a group with a third of all rows spans as many
    tasks as it needs; sums within a partition are added to those of the group's partitions before.
    """
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    dealt = durable(dealt.withColumn("__at", F.monotonically_increasing_id()), "running").withColumn("__part", F.shiftright("__at", 33))
    total = dealt.groupBy(group, "__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = total.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = out.join(base, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn(name, F.col("__base") + F.col("__own")).drop("__at", "__part", "__own", "__base", "__group", "__p")
