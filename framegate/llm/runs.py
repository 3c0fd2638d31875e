"""Repeated consecutive events in sequences."""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.operators.versions import measured
from framegate.plans.durable import durable

#: Bits of an event's place in the order within a block, by level. The last level takes what is left of an entity: two open runs per block of
#: the one below (and per range partition).
LEVELS = (12, 24, None)
_RUN = "first_sequence long, last_sequence long, events long, started double, ended double, kind string, first_change double, last_change double, first_at long, last_at long"


def _agglomerate(same: np.ndarray, gap: np.ndarray, change: np.ndarray, max_gap: float, max_change: float) -> np.ndarray:
    """The index of the run that each element ends up in, for elements in order. same/gap/change: between element i and i + 1.

    A linked list of runs and a queue of neighbouring pairs, most similar first (smaller change, then smaller gap, then earlier). A
    pair is as similar as the two elements that touch, and merges if it meets both limits.
    """
    n = len(same) + 1
    ok = same & (gap <= max_gap) & (change <= max_change)
    queue = [(change[i], gap[i], int(i)) for i in np.flatnonzero(ok)]
    heapq.heapify(queue)
    head = np.arange(n)
    tail = np.arange(n)
    while queue:
        _, _, i = heapq.heappop(queue)
        # the run that ends at i and the run that starts at i + 1 become one
        start, end = head[i], tail[i + 1]
        tail[start], head[end] = end, start
    run = np.zeros(n, dtype=np.int64)
    start = 0
    while start < n:
        run[start : tail[start] + 1] = start
        start = tail[start] + 1
    return run


def _merge(entity: list[str], below: int | None, max_gap: float, max_change: float):
    """Runs of a partition that is sorted by (entity, block, first_at), merged within their blocks; open ones touch a block's edge.

    below: bits of the blocks that were merged before. Two runs of one such block are done with each other: they were compared, or
    what lies between them is closed and no longer here.
    """
    keys = [*entity, "_block"]

    def batch(frame: pd.DataFrame) -> pd.DataFrame:
        new = np.ones(len(frame), dtype=bool)
        if len(frame) > 1:
            a, b = frame.iloc[:-1], frame.iloc[1:]
            within = np.logical_and.reduce([(a[k].to_numpy() == b[k].to_numpy()) | (a[k].isna().to_numpy() & b[k].isna().to_numpy()) for k in keys])
            kind_a, kind_b = a["kind"].to_numpy(object), b["kind"].to_numpy(object)
            same = within & (kind_a == kind_b) & a["kind"].notna().to_numpy()
            if below is not None:
                same &= a["last_at"].to_numpy() >> below != b["first_at"].to_numpy() >> below
            gap = np.abs(np.round(b["started"].to_numpy(float) - a["ended"].to_numpy(float), 9))
            change = np.abs(np.round(b["first_change"].to_numpy(float) - a["last_change"].to_numpy(float), 9))
            run = _agglomerate(same, gap, change, max_gap, max_change)
            new[1:] = ~within
        else:
            run = np.zeros(len(frame), dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[starts[1:], len(frame)] - 1
        out = frame.iloc[starts][[*keys, "first_sequence", "started", "kind", "first_change", "first_at"]].reset_index(drop=True)
        for c in ("last_sequence", "ended", "last_change", "last_at"):
            out[c] = frame[c].to_numpy()[ends]
        out["events"] = np.add.reduceat(frame["events"].to_numpy(), starts)
        block_end = np.r_[new[1:], True]
        out["open"] = new[starts] | block_end[ends]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            # the last block may go on in the next batch
            last = frame[keys].iloc[-1]
            tail = np.logical_and.reduce([(frame[k] == last[k]).to_numpy() | (frame[k].isna().to_numpy() & pd.isna(last[k])) for k in keys])
            if tail.all() and held and all(held[0][k].iloc[0] == last[k] or (pd.isna(held[0][k].iloc[0]) and pd.isna(last[k])) for k in keys):
                held.append(frame)
                continue
            done = pd.concat([*held, frame[~tail]], ignore_index=True) if held else frame[~tail].reset_index(drop=True)
            held = [frame[tail]]
            if len(done):
                yield batch(done)
        if held:
            yield batch(pd.concat(held, ignore_index=True))

    return run


def collapse_runs(
    events: DataFrame, entity: list[str], sequence: str, kind: str, time: str, change: str, max_change: float, max_gap: float, placed: bool = False
) -> DataFrame:
    """Every run of repeated events as one row; columns entity + first_sequence, last_sequence, events, started, ended, duration, kind.

    Neighbours by `sequence` (missing numbers do not matter) are one run when they have an equal `kind`, changes at most max_change
    apart and times at most max_gap apart; distances are compared at nine decimals, so 0.05 and 0.04 are 0.01 apart. A null or NaN
    time or change, or a null kind, ends the run on both sides; such an event is a run of one. Null entities form one sequence.
    Rows with a null sequence are left out; rows that repeat one count as neighbours, each an event. An empty table gives an empty result.

    Adjacent agglomeration: within a block of neighbouring events, the most similar neighbouring runs merge until none
    meets the limits. What touches a block's edge is still open and is merged again with its neighbours in the next larger block. Two runs are
    as similar as the events that touch, so the result does not depend on where blocks are cut. Blocks are cut by an event's place in the order of
    range partitions, whatever its number, so an entity of any size and spacing spreads over as many tasks as it needs, and none holds more of it than one block.
    placed: events lie in range partitions over (entity, sequence) already, with no sequence number of an entity twice.
    """
    columns = [*entity, *[c.split()[0] for c in _RUN.split(", ")]]
    value, at = measured(F.col(change).cast("double")), measured(F.col(time).cast("double"))
    runs = events.where(F.col(sequence).isNotNull()).select(
        *entity, F.col(sequence).cast("long").alias("first_sequence"), F.col(sequence).cast("long").alias("last_sequence"), F.lit(1).cast("long").alias("events"),
        at.alias("started"), at.alias("ended"), F.col(kind).cast("string").alias("kind"), value.alias("first_change"), value.alias("last_change"),
    )
    order = [*entity, "first_sequence", "started", "kind", "first_change"]
    runs = runs if placed else runs.repartitionByRange(*order)
    runs = runs.sortWithinPartitions(*order).withColumn("first_at", F.monotonically_increasing_id())
    runs = runs.withColumn("last_at", F.col("first_at"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    closed = None
    for below, bits in zip((None, *LEVELS), LEVELS):
        blocks = runs.withColumn("_block", F.lit(0).cast("long") if bits is None else F.shiftright("first_at", bits))
        if below is not None or bits is None:  # the first blocks lie whole and in order in their range partition
            blocks = blocks.repartition(*entity, "_block").sortWithinPartitions(*entity, "_block", "first_at")
        merged = blocks.mapInPandas(_merge(entity, below, max_gap, max_change), f"{types}, _block long, open boolean")
        if bits is None:
            done = merged.select(*columns)
        else:
            merged = durable(merged)
            done, runs = merged.where("not open").select(*columns), merged.where("open").select(*columns)
        closed = done if closed is None else closed.unionByName(done)
    return closed.select(*entity, "first_sequence", "last_sequence", "events", "started", "ended", (F.col("ended") - F.col("started")).alias("duration"), "kind")
