"""From frames and labels to an evaluation: the gate against a baseline that may show as many frames."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.config import Gate
from framegate.functions.pixels import analysis_pair, detect_change
from framegate.operators import frames as fr
from framegate.operators import gate as gt
from framegate.operators import match, select, signals
from framegate.plans.durable import durable
from framegate.sources.video import pixels


def observe(frames: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """The gate's events over whole media, with what is pending at their end, and whether the change's peak is shown."""
    events = durable(gt.run_gate(fr.frame_changes(frames, gate), gate, flush=True))
    return fr.peak_differs(frames, events, gate.peak_image_min_difference)


def uniform_baseline(media: DataFrame, budget: DataFrame) -> DataFrame:
    """As many evenly spread snapshots per medium as it may show. budget: media_id, budget."""
    rows = media.join(budget, "media_id").where("frame_count > 0 and budget > 0")
    n = F.least(F.col("frame_count"), F.col("budget"))
    bins = rows.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = F.least(F.col("frame_count") - 1, F.floor((F.col("_bin") + 0.5) * F.col("frame_count") / n))
    picked = bins.select("media_id", at.alias("frame_index"), "fps").withColumn("timestamp_s", F.col("frame_index") / F.col("fps"))
    return gt.snapshots(picked)


def verifications(frames: DataFrame, media: DataFrame, labels: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """A forced event per label of an action, with the change between the frames before and after it, and where it is. An error if a frame is missing."""
    asked = labels.where(match.is_action(F.col("category"))).join(media.select("media_id", "fps", "frame_count"), "media_id")
    frame = lambda t: signals.frame_at(F.col(t), F.col("fps"), F.col("frame_count"))
    asked = asked.select("media_id", "label_id", "action_text", "expected_result", frame("before_timestamp").alias("_before"), frame("after_timestamp").alias("frame_index"))
    a = frames.select("media_id", F.col("frame_index").alias("_before"), F.col("data").alias("_a"))
    b = frames.select("media_id", "frame_index", "timestamp_s", "width", "height", F.col("data").alias("_b"))
    rows = asked.join(a, ["media_id", "_before"], "left").join(b, ["media_id", "frame_index"], "left")
    rows = rows.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("action frame is missing for "), F.col("label_id").cast("string"))).cast("boolean")).otherwise(True))

    box = ", ".join(f"{b}: int" for b in gt.BOX)

    @F.pandas_udf(f"struct<change_fraction: double, {box}>")
    def change(a: pd.Series, b: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        pair = lambda d, i, j: analysis_pair(pixels(d, i, j), gate)
        found = [detect_change(pair(y, i, j), pair(x, i, j), i, j, gate) for x, y, i, j in zip(a, b, w, h)]
        out = [(fraction, *([region[n] for n in gt.BOX] if region else [None] * 6)) for region, fraction, _ in found]
        return pd.DataFrame(out, columns=["change_fraction", *gt.BOX]).astype({n: "Int32" for n in gt.BOX})

    rows = rows.withColumn("_c", change("_a", "_b", "width", "height"))
    return rows.select(
        "media_id", "timestamp_s", "frame_index", F.col("_before").alias("before_frame_index"), F.lit("action_verification").alias("reason"), F.lit("forced").alias("discovery"), "_c.*", "action_text", "expected_result"
    )


def scores(labels: DataFrame, observations: DataFrame, media: DataFrame, method: str) -> dict[str, DataFrame]:
    """Matches, and scores per category and in all, of one method. labels: label_id, media_id and the label's fields; observations: media_id and the event's fields."""
    peak = F.col("peak_timestamp") if "peak_timestamp" in observations.columns else F.lit(None).cast("double")
    shown = F.when(F.col("has_peak"), peak) if "has_peak" in observations.columns else peak
    rows = observations.withColumn("peak_timestamp", shown)
    matched = durable(match.best_match(labels, rows, "media_id"))
    state = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("state", "verification")]
    judged = match.judged(matched.join(rows.select("media_id", F.col("sequence_no").alias("matched_sequence"), *state), ["media_id", "matched_sequence"], "left"), "state", "verification").withColumn("method", F.lit(method))
    calls = match.score_observations(rows.withColumn("method", F.lit(method)), matched, ["media_id"], media.agg(F.sum("duration_seconds").alias("duration_seconds")).withColumn("method", F.lit(method)), ["method"])
    return {"matches": matched, "totals": match.score_labels(judged, ["method"]).join(calls, "method", "left"), "categories": match.score_labels(judged, ["method", "category"]), "cases": match.score_labels(judged, ["method", "case_id"])}
