"""Picking a subset of an ordered stream under a budget."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.config import Sampler
from framegate.functions.heap import top_values
from framegate.plans.durable import durable
from framegate.plans.order import with_place


def ranked(df: DataFrame, stream: list[str], importance: str = "importance", index: str = "frame_index", name: str = "rank") -> DataFrame:
    """df with its rank in the stream: importance downwards, then frame_index upwards. A filter on the rank reaches the sort as a group limit."""
    order = Window.partitionBy(*stream).orderBy(F.col(importance).desc_nulls_last(), F.col(index).asc())
    return df.withColumn(name, F.row_number().over(order))


def uniform_select(df: DataFrame, stream: list[str], budget: int, index: str = "frame_index") -> DataFrame:
    """Evenly spread rows of each stream: all if the budget covers them, else the rows at half-even rounded even spacing.

    Streams and (stream, index) must not be null or repeat. Rows are numbered over range partitions, so a stream may hold any share of
    all rows.
    """
    counts = df.groupBy(*stream).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_place(df, stream, [F.col(index)], "_i").join(counts, stream).withColumn("_i", F.col("_i") - 1)
    if budget == 1:
        return placed.where("_i = 0").drop("_i", "_n")
    spots = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (budget - 1)).cast("long"))
    return placed.where((F.col("_n") <= budget) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n")


def equal_bin_centres(counts: DataFrame, count: str, budget: int, name: str = "frame_index") -> DataFrame:
    """One row per bin of a video: the frame in the middle of each of min(count, budget) equal bins."""
    bins = F.least(F.col(count), F.lit(budget).cast("long"))
    rows = counts.where(F.col(count) > 0).withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), bins - 1)))
    return rows.withColumn(name, F.least(F.col(count) - 1, F.floor((F.col("_bin") + 0.5) * F.col(count) / bins))).drop("_bin")


#: What a sweep over a stream asks of a row: distance in time from all taken rows, and distance in looks. Sweep 0 sees the anchors only.
SWEEPS = ((False, True), (True, True), (False, True), (False, False))


class Picker:
    """Greedy choice within one stream, fed with its rows sweep by sweep in order. It holds the rows taken, of at most the budget, never the stream."""

    def __init__(self, config: Sampler, scale: float):
        self.config, self.scale = config, scale
        self.index: list[int] = []
        self.times: list[float] = []
        self.looks: list[np.ndarray] = []

    def take(self, sweep: int, index: np.ndarray, times: np.ndarray, looks: np.ndarray) -> list[int]:
        """Positions of the rows that are taken, in order."""
        apart, distinct = SWEEPS[sweep]
        room = self.config.budget - len(self.index)
        out: list[int] = []
        if room <= 0:
            return out
        free = ~np.isin(index, self.index)

        def strike(time: float, look: np.ndarray) -> None:
            if apart:
                free[np.abs(times - time) < self.config.min_distance_seconds] = False
            if distinct:
                free[np.abs(looks - look).mean(axis=1) / self.scale < self.config.duplicate_threshold] = False

        for t, look in zip(self.times, self.looks):
            strike(t, look)
        while len(out) < room and free.any():
            i = int(free.argmax())
            free[i] = False
            out.append(i)
            self.index.append(int(index[i]))
            self.times.append(float(times[i]))
            self.looks.append(looks[i])
            strike(times[i], looks[i])
        return out


def _anchors(df: DataFrame, stream: str, index: str, config: Sampler) -> DataFrame:
    """The evenly spread rows that a stream's choice begins with: a share of the budget, at least one."""
    counts = df.groupBy(stream).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_place(df, [stream], [F.col(index)], "_i").join(counts, stream)
    target = F.least(F.lit(config.budget), F.col("_n"))
    wanted = F.least(target, F.greatest(F.lit(1), F.bround(target * config.coverage_fraction))).cast("int")
    step = lambda k: F.bround(k * (F.col("_n") - 1) / F.greatest(wanted - 1, F.lit(1))).cast("long") + 1
    return placed.where(F.array_contains(F.transform(F.sequence(F.lit(0), wanted - 1), step), F.col("_i"))).drop("_i", "_n")


def greedy_select(df: DataFrame, stream: str, config: Sampler, signature: str, scale: float = 255.0, time: str = "timestamp_s", index: str = "frame_index", importance: str = "importance") -> DataFrame:
    """The rows that the strategy of `config` keeps; columns stream, index, step (the sweep that took it; 0 for anchors).

    signature is a number or an array of numbers of one length. (stream, index) must be unique. Sweep 0 takes evenly spread anchors that are distinct
    (hybrid only), 1 asks for distance in time and distinctness, 2 for distinctness, 3 for nothing; each goes through the rows by
    importance downwards (null and NaN last), then index. The choice of each row depends on all rows taken before it, so a stream is swept by one
    task, which holds the rows taken and one batch; sorting spills. A sweep of a stream whose budget is met is skipped.
    """
    kind = df.schema[stream].dataType.simpleString()
    source = df.select(stream, F.col(index).cast("long").alias(index), F.col(time).cast("double").alias("_time"), importance, F.col(signature).alias("_look"))
    if config.strategy == "uniform":
        return uniform_select(source, [stream], config.budget, index).select(stream, index, F.lit(0).alias("step"))
    if df.schema[signature].dataType.typeName() != "array":
        source = source.withColumn("_look", F.array("_look"))
    source = durable(source.withColumn("_look", F.col("_look").cast("array<double>")))  # swept up to four times
    first = F.when(F.isnan(importance), None).otherwise(F.col(importance).cast("double"))
    rows = source.select(stream, F.explode(F.lit([1, 2, 3])).alias("_sweep"), F.coalesce(-first, F.lit(float("inf"))).alias("_order"), index, "_time", "_look")
    if config.strategy == "hybrid":
        anchors = _anchors(source, stream, index, config)
        rows = rows.unionByName(anchors.select(stream, F.lit(0).alias("_sweep"), F.lit(0.0).alias("_order"), index, "_time", "_look"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, picker = None, None
        for batch in batches:
            if not len(batch):
                continue
            streams, sweeps = batch[stream].to_numpy(object), batch["_sweep"].to_numpy()
            index_, times = batch[index].to_numpy(), batch["_time"].to_numpy(float)
            cuts = np.flatnonzero(np.r_[True, (streams[1:] != streams[:-1]) | (sweeps[1:] != sweeps[:-1]), True])
            taken: list[tuple] = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if picker is None or streams[i] != own:
                    own, picker = streams[i], Picker(config, scale)
                if len(picker.index) < config.budget:
                    looks = np.stack(batch["_look"].iloc[i:j].to_list())
                    taken += [(own, int(index_[i + k]), int(sweeps[i])) for k in picker.take(int(sweeps[i]), index_[i:j], times[i:j], looks)]
            yield pd.DataFrame(taken, columns=[stream, index, "step"])

    ordered = rows.repartition(stream).sortWithinPartitions(stream, "_sweep", "_order", index)
    return ordered.select(stream, "_sweep", index, "_time", "_look").mapInPandas(run, f"{stream} {kind}, {index} long, step int")


def first_valid(df: DataFrame, valid: Column, position: list[str], n: int) -> DataFrame:
    """The first n valid rows in plan order. A limit over a sort, so each task keeps n rows."""
    return df.where(valid).orderBy(*position).limit(n)


def first_valid_per_slot(df: DataFrame, slot: str, key: str, valid: Column, position: str) -> DataFrame:
    """Per slot the first valid key in plan order, null where there is none; the minimum is taken before the shuffle."""
    return df.groupBy(slot).agg(F.min_by(F.when(valid, F.col(key)), F.when(valid, F.col(position))).alias(key), F.count_if(valid).alias("valid_rows"))


def head_of_set(c: Column, n: int = 10) -> Column:
    """Aggregate: the first n values in order, of values that do not repeat. A heap of n entries is kept before and behind the shuffle."""
    return top_values(c, n)
