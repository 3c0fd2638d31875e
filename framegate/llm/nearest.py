"""Matching records by nearest time."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framegate.operators.versions import measured

#: Seconds by which reach is widened before distances are compared exactly.
_SLACK = 1e-8
_FOUND = "left_id long, right_id long, distance double"


def settle(rows: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
    """The nearest right row of each left row within its tolerance. rows: at, side (0 right, 1 left), id, tolerance, in order of
    (stretch, at, side); start: the index at which each row's stretch (an entity, or a slice of one) begins."""
    n = len(rows)
    at, ids = rows["at"].to_numpy(float), rows["id"].to_numpy(np.int64)
    right = rows["side"].to_numpy() == 0
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(right, place, -1))
    before = np.where(before >= start, before, -1)
    after = np.minimum.accumulate(np.where(right, place, n)[::-1])[::-1]
    after = np.where((after < n) & (start[np.minimum(after, n - 1)] == start), after, -1)
    left = np.flatnonzero(~right)
    b, a = before[left], after[left]
    tolerance = rows["tolerance"].to_numpy(float)[left]
    away = lambda k: np.where(k >= 0, np.abs(np.round(at[k] - at[left], 9)), np.inf)
    db, da = away(b), away(a)
    later = (da < db) | ((da == db) & (a >= 0) & (ids[a] < ids[b]))
    distance, hit = np.where(later, da, db), np.where(later, a, b)
    ok = (hit >= 0) & (distance <= np.round(tolerance, 9))
    return pd.DataFrame({"left_id": ids[left][ok], "right_id": ids[hit][ok], "distance": distance[ok]})


class NearestBuffer:
    """Both sides of one stretch of time at a time, for rows that come in order of time.

    The watermark is the time of the newest row. A left row is emitted once a right row at or after it has come or the watermark has
    passed its horizon (time + tolerance); until then it is held. Of the right rows only the newest can still be the nearest
    for a later left row, so older ones are evicted.
    """

    def __init__(self, keys: list[str]):
        self.keys, self.held = keys, None

    def push(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self.held is not None and len(self.held):
            rows = pd.concat([self.held, rows], ignore_index=True)
        n = len(rows)
        new = np.r_[True, np.logical_or.reduce([(rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1]) for k in self.keys])] if n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        if not n:
            return pd.DataFrame({"left_id": [], "right_id": [], "distance": []})
        side, at = rows["side"].to_numpy(), rows["at"].to_numpy(float)
        final = np.arange(n) >= start[-1]
        rights = np.flatnonzero(final & (side == 0))
        newest = rights[-1] if len(rights) else -1
        waiting = final & (side == 1) & (np.arange(n) > newest) & (at + rows["tolerance"].to_numpy(float) + _SLACK >= at[-1])
        keep = waiting.copy()
        if newest >= 0:
            keep[newest] = True
        self.held = rows[keep]
        done = ~waiting
        shift = np.cumsum(done) - 1
        return settle(rows[done].reset_index(drop=True), shift[_first_done(start, done)][done])

    def finish(self) -> pd.DataFrame:
        rows = self.held.reset_index(drop=True) if self.held is not None else pd.DataFrame({"at": [], "side": [], "id": [], "tolerance": []})
        return settle(rows, np.zeros(len(rows), np.int64))


def _first_done(start: np.ndarray, done: np.ndarray) -> np.ndarray:
    """For each row the first row of its stretch that is done."""
    n = len(start)
    following = np.minimum.accumulate(np.where(done, np.arange(n), n - 1)[::-1])[::-1]
    return following[start]


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    buffer = NearestBuffer(["entity", "level", "slice"])
    for frame in frames:
        yield buffer.push(frame)
    yield buffer.finish()


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_entity: str, left_id: str, left_time: str, tolerance: str,
    right_entity: str, right_id: str, right_time: str, slice_seconds: float = 64.0,
) -> DataFrame:
    """The nearest right record of each left record of the same entity within the left record's tolerance; columns left_id, right_id, distance.

    Equal distances go to the smaller right id; distances are compared at nine decimals. A null or NaN tolerance is 0, a negative one
    matches nothing. Left rows with a null id, entity or time (or NaN), or without a right row in reach, are absent; right rows with
    null in id, entity or time never match. A repeated left id gives its nearest match over all its rows. Ids are longs.

    Both sides are cut into slices of time, so an entity of any size spreads over many tasks: a left row goes to the one or two
    slices that its tolerance reaches (wider slices for wider tolerances, by powers of two), right rows at one time are one row.
    Behind one shuffle each task sweeps its slices in order of time with NearestBuffer, which holds the newest right row and the left rows that wait
    for the next one. Left rows of boundless tolerance (2^60 slices and more) share one slice of their entity.
    """
    at = lambda c: measured(F.col(c).cast("double"))
    width = lambda level: F.lit(float(slice_seconds)) * F.pow(F.lit(2.0), level)
    reach = F.coalesce(at(tolerance), F.lit(0.0))
    asked = left.select(F.col(left_entity).alias("entity"), at(left_time).alias("at"), F.col(left_id).cast("long").alias("id"), reach.alias("tolerance"))
    asked = asked.where("entity is not null and at is not null and id is not null and tolerance >= 0")
    asked = asked.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(60), F.ceil(F.log2((F.col("tolerance") + 1e-6) * 2 / slice_seconds)))).cast("int"))
    levels = [r[0] for r in asked.select("level").distinct().collect()]  # 61 values at most
    cut = lambda c: F.floor(c / width(F.col("level")))
    ends = F.array_distinct(F.array(cut(F.col("at") - F.col("tolerance") - _SLACK), cut(F.col("at") + F.col("tolerance") + _SLACK)))
    ends = F.when(F.col("level") < 60, ends).otherwise(F.array(F.lit(0).cast("long")))
    asked = asked.withColumn("slice", F.explode(ends)).withColumn("side", F.lit(1))
    given = right.select(F.col(right_entity).alias("entity"), at(right_time).alias("at"), F.col(right_id).cast("long").alias("id"))
    given = given.where("entity is not null and at is not null and id is not null").groupBy("entity", "at").agg(F.min("id").alias("id"))
    given = given.withColumns({"tolerance": F.lit(0.0), "side": F.lit(0), "level": F.explode(F.lit(levels).cast("array<int>"))})
    given = given.withColumn("slice", F.when(F.col("level") < 60, cut(F.col("at"))).otherwise(F.lit(0).cast("long")))
    order = ["entity", "level", "slice", "at", "side"]
    rows = given.unionByName(asked).select(*order, "id", "tolerance").repartition("entity", "level", "slice").sortWithinPartitions(*order)
    found = rows.mapInPandas(_sweep, _FOUND)
    best = found.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("_best"))
    return best.select("left_id", F.col("_best.right_id").alias("right_id"), F.col("_best.distance").alias("distance"))


def nearest_stream(rows: DataFrame, max_tolerance: float, delay: str, slice_seconds: float = 64.0) -> DataFrame:
    """The same match over a stream; columns entity, left_id, right_id, distance.

    rows: entity string, side int (0 right, 1 left), at timestamp, id long, tolerance double (seconds), as one stream of both sides in
    any order. Per entity and slice of time both sides are buffered in state, so an entity of any size spreads over many keys and a state holds a
    slice, not a history: a left row is in its own slice alone, a right row also in the next one that it can reach. Slices are at least twice as
    long as max_tolerance. Once the watermark (newest time less `delay`) passes a left row's
    horizon it is emitted with its nearest right row, or dropped if there is none. Right rows older than the watermark by
    max_tolerance can match nothing that is still to come and are evicted. Rows that come behind the watermark are late and
    dropped by Spark, which begins with a watermark of 1970, so times lie after that. A null or NaN tolerance is 0; one above max_tolerance is an error, since its right rows may be gone. A repeated left
    id waits until all its rows so far in a slice are past their horizon and gives its nearest match; rows of it that come after that, in another
    slice or under another entity, give a match of their own. Two right rows of one time are told apart by the smaller id.
    """
    if not 0 <= max_tolerance < float("inf"):
        raise ValueError("max_tolerance must be a finite number of seconds, at least 0")
    width = max(slice_seconds, 2 * (max_tolerance + _SLACK))
    seen = rows.where("entity is not null and at is not null and id is not null").withWatermark("at", delay)
    cut = lambda shift: F.floor((F.unix_micros("at") / 1e6 + shift) / width).cast("long")
    reach = max_tolerance + _SLACK
    seen = seen.withColumn("slice", F.explode(F.when(F.col("side") == 1, F.array(cut(0.0))).otherwise(F.array_distinct(F.array(cut(-reach), cut(reach))))))
    state = "at array<double>, side array<int>, id array<long>, tolerance array<double>"
    output = "entity string, left_id long, right_id long, distance double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        parts = []
        if held.exists:
            parts.append(pd.DataFrame(dict(zip(["at", "side", "id", "tolerance"], map(np.asarray, held.get)))))
        for f in frames:
            seconds = f["at"].astype("datetime64[us]").astype("int64") / 1e6
            parts.append(pd.DataFrame({"at": seconds, "side": f["side"], "id": f["id"], "tolerance": f["tolerance"].fillna(0.0)}))
        all_rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True).sort_values(["at", "side", "id", "tolerance"], ascending=[True, True, True, False], ignore_index=True)
        beyond = all_rows[(all_rows["side"] == 1) & (all_rows["tolerance"] > max_tolerance)]
        if len(beyond):
            raise ValueError(f"tolerance {beyond['tolerance'].iloc[0]} of left row {beyond['id'].iloc[0]} of {key[0]} is above max_tolerance {max_tolerance}")
        mark = held.getCurrentWatermarkMs() / 1000
        lefts = all_rows["side"] == 1
        early = lefts & (all_rows["at"] + all_rows["tolerance"] >= mark)
        ready = lefts & ~all_rows["id"].isin(all_rows.loc[early, "id"])
        waiting = lefts & ~ready
        asked = all_rows[ready | (all_rows["side"] == 0)].drop_duplicates(["at", "side", "id"]).reset_index(drop=True)
        rights = asked[asked["side"] == 0].drop_duplicates("at")
        found = settle(pd.concat([rights, asked[asked["side"] == 1]]).sort_values(["at", "side"], ignore_index=True), np.zeros(len(rights) + int((asked["side"] == 1).sum()), np.int64))
        since = min([mark, *all_rows.loc[waiting, "at"]]) - max_tolerance - _SLACK
        rest = all_rows[waiting | (~lefts & (all_rows["at"] >= since))]
        if len(rest):
            held.update(tuple(rest[c].tolist() for c in ("at", "side", "id", "tolerance")))
            horizon = float((rest["at"] + np.where(rest["side"] == 1, rest["tolerance"], max_tolerance)).min())
            held.setTimeoutTimestamp(int(max(horizon, mark) * 1000) + 1)
        elif held.exists:
            held.remove()
        found.insert(0, "entity", key[0])
        yield found.sort_values(["left_id", "distance", "right_id"]).groupby("left_id", as_index=False).first()[["entity", "left_id", "right_id", "distance"]] if len(found) else found

    return seen.groupBy("entity", "slice").applyInPandasWithState(step, output, state, "append", GroupStateTimeout.EventTimeTimeout)
