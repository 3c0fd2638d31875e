"""Top N items within every group."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from framegate.operators.versions import measured


def smallest_n(df: DataFrame, group: list[str], order: list[Column], keep: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The n rows of each group that come first by `order`, with their rank; columns group + keep + rank.

    A bounded heap of n entries per group is built on the map side, merged behind one shuffle, and compares the order columns one
    after the other. What is shuffled is at most n rows per group and map task, so a group of any size costs no single task
    more than that. Rows equal in every order column are told apart by the columns kept.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    entry = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    heaps = df.groupBy(*group).agg(InternalFunction.collect_top_k(entry, n, True).alias("_heap"))
    rows = heaps.select(*group, F.posexplode("_heap").alias("_pos", "_row"))
    return rows.select(*group, *[F.col("_row")[f"k{i}"].alias(c) for i, c in enumerate(keep)], (F.col("_pos") + 1).alias(rank))


def top_n(df: DataFrame, group: list[str], score: str, ids: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The n highest-scoring items of each group, equal scores in ascending order of `ids`; columns group + ids + score + rank.

    Null and NaN scores never count, so a group without any score is absent. Null group values form a group of their own; a null
    id comes before any other. Rows equal in score and ids are different items (make them distinct first if they are not).
    Other columns of df are not read. An empty table gives an empty result.
    """
    scored = df.select(*group, *ids, measured(F.col(score).cast("double")).alias(score)).where(F.col(score).isNotNull())
    return smallest_n(scored, group, [F.lit(0.0) - F.col(score), *map(F.col, ids)], [*ids, score], n, rank)
