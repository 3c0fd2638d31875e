"""Positions and running sums over groups of any size, without a window that holds a whole group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegate.plans.durable import durable

_PART_BITS = 33


def _cut(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """df in range partitions over (group, order); _at is partition << 33 plus the row's place in it.

    A group of any size spreads over as many partitions as it needs. The result is written, since range bounds come from
    samples and both readers below must see the same cut.
    """
    keys = [F.col(c) for c in group] + list(order)
    cut = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return durable(cut.withColumn("_at", F.monotonically_increasing_id()))


def with_place(df: DataFrame, group: list[str], order: list, name: str = "place") -> DataFrame:
    """Add the 1-based position of each row in its group by `order`.

    The order must be unique within the group, the group columns not null. One range shuffle; the second pass joins a table of
    (partition, group) counts, which has at most one row per group and partition.
    """
    cut = _cut(df, group, order).withColumn("_part", F.shiftright("_at", _PART_BITS))
    heads = cut.groupBy("_part", *group).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", *group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo") + 1).alias("_shift"))
    return cut.join(heads, ["_part", *group]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def with_sum_before(df: DataFrame, group: list[str], order: list, weight: str, before: str = "before", total: str = "total") -> DataFrame:
    """Add the sum of `weight` over the rows that come earlier in the group by `order`, and over the whole group.

    The order must be unique within the group, the group columns not null. The window spans one range partition of a group at most.
    """
    cut = _cut(df, group, order).withColumn("_part", F.shiftright("_at", _PART_BITS))
    heads = cut.groupBy("_part", *group).agg(F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", *group, F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_base"), F.sum("_w").over(Window.partitionBy(*group)).alias(total))
    local = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_run", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    return cut.join(heads, ["_part", *group]).withColumn(before, F.col("_base") + F.col("_run")).drop("_part", "_at", "_run", "_base")


def with_previous(df: DataFrame, group: list[str], order: list, columns: list[str], prefix: str = "previous_") -> DataFrame:
    """Add the given columns of the row before in the group by `order`, null for the first row.

    The order must be unique within the group, the group columns not null. A window spans one range partition of a group at most; the
    last row of each goes to the next one through a table of one row per group and partition.
    """
    cut = _cut(df, group, order).withColumn("_part", F.shiftright("_at", _PART_BITS))
    row = F.struct(*[F.col(c) for c in columns])
    tails = cut.groupBy("_part", *group).agg(F.max_by(row, F.col("_at")).alias("_tail"))
    tails = tails.select("_part", *group, F.lag("_tail").over(Window.partitionBy(*group).orderBy("_part")).alias("_edge"))
    local = Window.partitionBy("_part", *group).orderBy("_at")
    cut = cut.withColumns({"_lag": F.lag(row).over(local), "_first": F.row_number().over(local) == 1})
    before = F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag"))
    joined = cut.join(tails, ["_part", *group]).withColumn("_before", before)
    return joined.withColumns({f"{prefix}{c}": F.col("_before")[c] for c in columns}).drop("_part", "_at", "_lag", "_first", "_edge", "_before")
