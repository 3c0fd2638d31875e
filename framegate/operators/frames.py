"""Pixels to signals: a frame is reduced where it is read, and only reduced frames meet their neighbours."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.config import Gate, Sampler
from framegate.functions import geometry
from framegate.functions import pixels as px
from framegate.operators import signals
from framegate.operators.gate import BOX, INPUT
from framegate.plans.order import with_previous
from framegate.sources.video import pixels

_REDUCED = "media_id string, frame_index long, timestamp_s double, scheduled boolean, tiny binary, gray binary, gray_width int"
_PAIR = "media_id string, frame_index long, timestamp_s double, width int, height int, small binary, small_width int, large binary, large_width int"


def _each(frames: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """reduce(row) of every frame, in the task that has it; nothing is shuffled."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([reduce(r) for r in batch.itertuples()], columns=names)

    return frames.mapInPandas(run, schema)


def _image(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, int(width))


def frame_signals(frames: DataFrame, media: DataFrame, config: Sampler = Sampler()) -> DataFrame:
    """Per frame the change against the frame before on a tiny image, and per scheduled frame the change against the scheduled one before.

    media: media_id, fps, frame_count. A frame is read once and leaves its task as a tiny image and, if it is scheduled, a small grey one. Neighbours
    meet over range partitions, so one endless camera spreads over as many tasks as it needs; whole frames are never shuffled by medium (they are joined with
    the schedule, which is a broadcast as long as media are few enough for Spark's size limit).
    """
    plan = media.select("media_id", signals.schedule_step(F.col("fps"), config.candidate_hz).alias("step"), (F.col("frame_count") - 1).alias("last"))

    def reduce(r) -> tuple:
        frame = pixels(r.data, r.width, r.height)
        on = bool(r.frame_index % r.step == 0 or r.frame_index == r.last)
        gray = px.analysis_gray(frame, config.analysis_width) if on else None
        tiny = px.signature(frame).tobytes() if config.spike_guard or on else None
        return r.media_id, r.frame_index, r.timestamp_s, on, tiny, gray.tobytes() if on else None, gray.shape[1] if on else 0

    threshold = config.motion_pixel_threshold

    @F.pandas_udf("struct<coarse_difference: double, coarse_motion: double>")
    def coarse(now: pd.Series, before: pd.Series) -> pd.DataFrame:
        pairs = [(_image(a, 16), _image(b, 16)) if a is not None and b is not None else None for a, b in zip(now, before)]
        return pd.DataFrame([(px.mean_difference(*p), float(px.moved(*p, threshold).mean())) if p else (0.0, 0.0) for p in pairs], columns=["coarse_difference", "coarse_motion"])

    @F.pandas_udf("struct<frame_difference: double, histogram_difference: double, motion_score: double>")
    def full(now: pd.Series, before: pd.Series, width: pd.Series) -> pd.DataFrame:
        pairs = [(_image(a, w), _image(b, w)) if b is not None else None for a, b, w in zip(now, before, width)]
        apart = lambda a, b: px.histogram_distance(px.histogram(a), px.histogram(b))
        return pd.DataFrame([(px.mean_difference(*p), apart(*p), float(px.moved(*p, threshold).mean())) if p else (0.0, 0.0, 0.0) for p in pairs], columns=["frame_difference", "histogram_difference", "motion_score"])

    rows = with_previous(_each(frames.join(plan, "media_id"), reduce, _REDUCED), ["media_id"], [F.col("frame_index")], ["tiny"])
    key = ["media_id", "frame_index"]
    if config.spike_guard:
        rows = rows.withColumn("_c", coarse("tiny", "previous_tiny"))
    else:
        rows = rows.withColumn("_c", F.struct(F.lit(0.0).alias("coarse_difference"), F.lit(0.0).alias("coarse_motion")))
    on = with_previous(rows.where("scheduled").select(*key, "gray", "gray_width"), ["media_id"], [F.col("frame_index")], ["gray"])
    on = on.select(*key, full("gray", "previous_gray", "gray_width").alias("_f"))
    zero = lambda c: F.coalesce(F.col(f"_f.{c}"), F.lit(0.0)).alias(c)
    looks = F.when(F.col("tiny").isNotNull(), F.transform(F.split(F.decode("tiny", "ISO-8859-1"), ""), lambda c: F.ascii(c)))
    return rows.join(on, key, "left").select(
        *key, "timestamp_s", "scheduled", *[zero(c) for c in ("frame_difference", "histogram_difference", "motion_score")], "_c.coarse_difference", "_c.coarse_motion", looks.alias("signature")
    )


def candidates(frames: DataFrame, media: DataFrame, config: Sampler = Sampler()) -> DataFrame:
    """Scored candidates of media: the scheduled frames, and the first frame of each spike between them with its coarse signals."""
    rows = frame_signals(frames, media, config)
    rows = signals.spikes(rows, "coarse_difference", config.spike_threshold, "scheduled") if config.spike_guard else rows.withColumn("spike", F.lit(False))
    kept = rows.where("scheduled or spike").join(media.select("media_id", "fps", (F.col("frame_count") / F.col("fps")).alias("duration")), "media_id")
    pick = lambda full, coarse: F.when(F.col("spike"), coarse).otherwise(F.col(full)).alias(full)
    half = F.when(F.col("spike"), 0.5 / F.col("fps")).otherwise(0.5 / config.candidate_hz)
    kept = kept.select(
        "media_id", "frame_index", "timestamp_s", signals.source_interval(F.col("timestamp_s"), F.col("duration"), half).alias("_i"), pick("frame_difference", F.col("coarse_difference")), pick("histogram_difference", F.lit(0.0)),
        pick("motion_score", F.col("coarse_motion")), F.when(F.col("spike"), "spike_guard").otherwise("scheduled").alias("discovery"), "signature",
    ).select("*", "_i.*").drop("_i")
    return signals.with_importance(kept, "frame_difference", "histogram_difference", "motion_score", ["media_id"], config)


def frame_changes(frames: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """The gate's input from pixels: change of each frame against the one before. Frames are reduced to their two grey images where they are read and
    meet their neighbours over range partitions."""

    def reduce(r) -> tuple:
        small, large = px.analysis_pair(pixels(r.data, r.width, r.height), gate)
        return r.media_id, r.frame_index, r.timestamp_s, r.width, r.height, small.tobytes(), small.shape[1], large.tobytes(), large.shape[1]

    box = ", ".join(f"{b}: int" for b in BOX)

    @F.pandas_udf(f"struct<changed: boolean, fraction: double, discovery: string, {box}>")
    def change(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, v: pd.Series, w: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        out = []
        for small, small_before, large, large_before, i, k, x, y in zip(a, b, c, d, v, w, width, height):
            region, fraction, how = None, 0.0, "none"
            if small_before is not None:
                region, fraction, how = px.detect_change((_image(small, i), _image(large, k)), (_image(small_before, i), _image(large_before, k)), int(x), int(y), gate)
            out.append((region is not None, fraction, how, *([region[n] for n in BOX] if region else [None] * 6)))
        return pd.DataFrame(out, columns=["changed", "fraction", "discovery", *BOX]).astype({n: "Int32" for n in BOX})

    rows = with_previous(_each(frames, reduce, _PAIR), ["media_id"], [F.col("frame_index")], ["small", "large"])
    found = change("small", "previous_small", "large", "previous_large", "small_width", "large_width", "width", "height")
    none = F.lit(None).cast("string")
    rows = rows.select("media_id", "frame_index", "timestamp_s", none.alias("control"), found.alias("_c"), none.alias("action_text"), none.alias("expected_result"))
    return rows.select("media_id", "frame_index", "timestamp_s", "control", "_c.*", "action_text", "expected_result").select(*INPUT)


def peak_differs(frames: DataFrame, events: DataFrame, least: float = 0.02) -> DataFrame:
    """events with has_peak: whether the peak's frame differs enough from the event's own to be shown as well. Two equi joins by frame index."""

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.nan if x is None or y is None else px.visual_difference(pixels(x, i, j), pixels(y, i, j)) for x, y, i, j in zip(a, b, w, h)])

    own = frames.select("media_id", "frame_index", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("data").alias("_own"))
    peak = frames.select("media_id", F.col("frame_index").alias("peak_frame_index"), F.col("data").alias("_peak"))
    joined = events.join(own, ["media_id", "frame_index"], "left").join(peak, ["media_id", "peak_frame_index"], "left")
    shown = F.coalesce(difference("_own", "_peak", "_w", "_h") >= least, F.lit(False))
    return joined.withColumn("has_peak", shown).drop("_own", "_peak", "_w", "_h")


def event_images(frames: DataFrame, events: DataFrame, gate: Gate = Gate(), encode=px.png) -> DataFrame:
    """The images that an event is shown with; columns media_id, sequence_no, timestamp_s, position, role, frame_index, width, height, patches, data.

    events: media_id, sequence_no, timestamp_s, frame_index, reason, peak_frame_index, has_peak and the box; before_frame_index where a forced event has one. Which
    images there are follows geometry.images(): the whole frame for context, the region with its margin for detail, before the action and at the
    peak. An event asks for its frames by (media, index), so only the frames asked for meet an event, one image per row.
    """
    kind = "struct<" + ", ".join(f"{b}: int" for b in BOX) + ">"
    region = F.when(F.col("x").isNotNull(), F.struct(*BOX)) if "x" in events.columns else F.lit(None).cast(kind)
    lacking = {c: F.lit(None).cast(t) for c, t in (("has_peak", "boolean"), ("peak_frame_index", "long")) if c not in events.columns}
    events = events.withColumns(lacking) if lacking else events
    before = F.col("before_frame_index") if "before_frame_index" in events.columns else F.lit(None).cast("long")
    sizes = frames.select("media_id", "frame_index", F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = events.withColumns({"_region": region, "_before": before}).join(sizes, ["media_id", "frame_index"])
    images = geometry.images(F.col("_region"), F.col("_w"), F.col("_h"), F.col("_before").isNotNull(), F.coalesce("has_peak", F.lit(False)), gate.crop_margin, gate.context_width, gate.detail_width)
    rows = rows.select("media_id", "sequence_no", "timestamp_s", "frame_index", "peak_frame_index", "_before", "_region", F.posexplode(images).alias("position", "_i"))
    role = F.col("_i.role")
    shown = F.when(role == "before_action", F.col("_before")).when(role == "change_peak", F.col("peak_frame_index")).otherwise(F.col("frame_index"))
    rows = rows.select("media_id", "sequence_no", "timestamp_s", "position", role.alias("role"), shown.alias("frame_index"), F.col("_i.patches").alias("patches"), F.when(F.col("_i.cut"), geometry.expanded(F.col("_region"), gate.crop_margin)).alias("_cut"), F.col("_i.width").alias("_width"))
    joined = rows.join(frames.select("media_id", "frame_index", F.col("width").alias("_w"), F.col("height").alias("_h"), "data"), ["media_id", "frame_index"])

    @F.pandas_udf("struct<data: binary, width: int, height: int>")
    def drawn(data: pd.Series, w: pd.Series, h: pd.Series, cut: pd.DataFrame, most: pd.Series) -> pd.DataFrame:
        out = []
        for d, i, j, c, m in zip(data, w, h, cut.to_dict("records"), most):
            frame = pixels(d, i, j)
            if c.get("x") is not None and not pd.isna(c["x"]):
                frame = px.crop(frame, {k: int(v) for k, v in c.items()})
            out.append(px.encoded(frame, int(m), encode))
        return pd.DataFrame(out, columns=["data", "width", "height"])

    out = joined.withColumn("_d", drawn("data", "_w", "_h", "_cut", "_width"))
    return out.select("media_id", "sequence_no", "timestamp_s", "position", "role", "frame_index", "_d.width", "_d.height", "patches", "_d.data")
