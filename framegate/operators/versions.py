"""Of several deliveries of a record, the one that holds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, keep: list[str], in_order: bool = False) -> DataFrame:
    """One row per key: the one with the greatest `at`; columns keys + keep.

    Equal `at` go to the greatest values of `keep` in that order, so the result does not depend on the order of arrival; a null
    `at` comes before any other. Null keys form their own records. Rows are shuffled once by the whole key, which no group of
    records can make heavy, and sorted once behind the shuffle. in_order: that shuffle goes to range partitions over the keys, so the result lies in their order.
    """
    row = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in keep])
    rows = df.select(*keys, row.alias("_row"))
    rows = rows.repartitionByRange(*keys) if in_order else rows.repartition(*keys)
    return rows.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def measured(c: str | Column) -> Column:
    """The value of a score, null where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)
