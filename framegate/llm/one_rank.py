"""One ranking from several differently-scaled scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.llm.top_n import smallest_n
from framegate.operators.versions import measured
from framegate.plans.order import with_place, with_sum_before

ORDERS = ("leximin", "majority")


def percentiles(df: DataFrame, group: list[str], scale: str, ids: list[str], scores: list[str]) -> DataFrame:
    """Each item's percentiles among the items of its group that were scored on the same scale; columns group + ids + vector.

    A percentile is the share of the other items below plus half of those that tie, 1 for an item alone; null where the
    item has no value (null or NaN). `vector` has one entry per score, in the order given. Items are (group, ids); a
    repeated item counts as often as it occurs and keeps its best percentiles. A null scale is a scale of its own. Items with a null in group
    or ids are left out.

    Distinct values are counted before any shuffle, so equal scores are one row however many they are; the running count
    behind a percentile is taken over range partitions, never over a whole group.
    """
    long = df.dropna(subset=[*group, *ids]).select(
        *group, *ids, F.coalesce(F.col(scale).cast("string"), F.lit("")).alias("_scale"), F.col(scale).isNull().alias("_no_scale"),
        F.posexplode(F.array(*[measured(F.col(c).cast("double")) for c in scores])).alias("_score", "_value"),
    ).withColumn("_value", F.col("_value") + F.lit(0.0))
    pool = [*group, "_scale", "_no_scale", "_score"]
    counts = long.where(F.col("_value").isNotNull()).groupBy(*pool, "_value").agg(F.count(F.lit(1)).alias("_n"))
    below = with_sum_before(counts, pool, [F.col("_value")], "_n")
    share = (F.col("before") + (F.col("_n") - 1) / 2) / (F.col("total") - 1)
    share = below.select(*pool, "_value", F.when(F.col("total") == 1, 1.0).otherwise(share).alias("_share"))
    placed = long.join(share, [*pool, "_value"], "left")
    cells = [F.max(F.when(F.col("_score") == i, F.col("_share"))) for i in range(len(scores))]
    return placed.groupBy(*group, *ids).agg(F.array(*cells).alias("vector"))


def rank_key(vector: Column, order: str) -> Column:
    """What items are compared by, greatest first: the percentiles in ascending order, a missing one below all.

    leximin: the weakest first, then the next. majority: the same array read from the weakest percentile that most scores reach
    (the second of four), the entries below it last; so one weak score of four can't decide alone, but two can't be masked.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    ascending = F.array_sort(F.transform(vector, lambda x: F.coalesce(x, F.lit(-1.0))))
    if order == "leximin":
        return ascending
    skipped = F.ceil(F.size(vector) / 2) - 1
    return F.concat(F.slice(ascending, skipped.cast("int") + 1, F.size(vector)), F.slice(ascending, F.lit(1), skipped.cast("int")))


def _descending(key: Column) -> Column:
    return F.transform(key, lambda x: F.lit(0.0) - x)


def one_ranking(df: DataFrame, group: list[str], scale: str, ids: list[str], scores: list[str], order: str = "majority") -> DataFrame:
    """Every item with its percentiles and its place in the one ranking of its group; columns group + ids + vector + place.

    Equal keys go in ascending order of ids. An item without any score comes last.
    """
    items = percentiles(df, group, scale, ids, scores)
    items = items.withColumn("_key", _descending(rank_key(F.col("vector"), order)))
    return with_place(items, group, [F.col("_key"), *map(F.col, ids)]).select(*group, *ids, "vector", "place")


def first_of_ranking(df: DataFrame, group: list[str], scale: str, ids: list[str], scores: list[str], n: int = 1, order: str = "majority") -> DataFrame:
    """The first n items of each group's ranking, without ranking the others; columns group + ids + rank. Items without any score don't count."""
    items = percentiles(df, group, scale, ids, scores).where(F.exists("vector", lambda x: x.isNotNull()))
    return smallest_n(items, group, [_descending(rank_key(F.col("vector"), order)), *map(F.col, ids)], ids, n)
