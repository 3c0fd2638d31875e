"""The driver's tables as ordered streams, videos, candidates, labels and observations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.functions.text import relative_path, stripped, vocabulary_key
from framegate.operators.versions import latest, measured
from framegate.plans.durable import durable
from framegate.plans.order import with_place
from framegate.sources.tables import table

SIGNALS = ["frame_difference", "histogram_difference", "motion_score"]


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """events as a stream per user, written once: frame_index from 0 in order of time, timestamp_s from the user's first event."""
    e = table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("media_id"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("motion"), micros.alias("_us"))
    rows = with_place(rows.where("media_id is not null"), ["media_id"], [F.col("_us"), F.col("event_id")], "frame_index").withColumn("frame_index", F.col("frame_index") - 1)
    first = rows.where("frame_index = 0").select("media_id", F.col("_us").alias("_first"))
    return durable(rows.join(first, "media_id").withColumn("timestamp_s", (F.col("_us") - F.col("_first")) / 1e6).drop("_us", "_first"))


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """One row per video as last registered, with its duration (0 without a positive frame rate)."""
    rows = latest(table(spark, folder, "videos").where("video_path is not null"), ["video_path"], "ingested_at", ["fps", "frame_count", "width", "height", "codec_fourcc"])
    fps = measured("fps")
    return rows.withColumn("duration_seconds", F.when(fps > 0, F.coalesce("frame_count", F.lit(0)) / fps).otherwise(0.0))


def candidates(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Scored candidates as last delivered, with NaN scores as null."""
    rows = latest(table(spark, folder, "candidates").where("video_path is not null and frame_index is not null"), ["video_path", "frame_index"], "ingested_at", list(keep))
    return rows.withColumns({c: measured(c) for c in keep if c in (*SIGNALS, "importance")})


def observations(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Perception events as last delivered, their reason without outer blanks in lower case."""
    rows = latest(table(spark, folder, "perception_events").where("video_path is not null and sequence_no is not null"), ["video_path", "sequence_no"], "ingested_at", list(keep))
    return rows.withColumn("reason", F.lower(stripped(F.col("reason")))) if "reason" in keep else rows


def labels(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Labels as delivered last, with the defaults: category other, risk normal, tolerance 0, eligible; transition falls back to case/event."""
    need = list(dict.fromkeys((*keep, "category", "risk", "tolerance", "real_world_eligible", "case_id", "event_id", "source_transition_id")))
    rows = latest(table(spark, folder, "labeled_events").where("label_id is not null"), ["label_id"], "ingested_at", need)
    given = stripped(F.col("source_transition_id"))
    return rows.withColumns({
        "category": F.coalesce(vocabulary_key(F.col("category")), F.lit("other")), "risk": F.coalesce(vocabulary_key(F.col("risk")), F.lit("normal")), "tolerance": F.coalesce(measured("tolerance"), F.lit(0.0)),
        "real_world_eligible": F.coalesce("real_world_eligible", F.lit(True)), "transition": F.when(given != "", F.lower(given)).otherwise(F.concat_ws("/", "case_id", "event_id")),
    })


def case_videos(spark: SparkSession, folder: str) -> DataFrame:
    """case_id and the path of its video."""
    rows = table(spark, folder, "evaluation_cases").where("case_id is not null and video is not null")
    return rows.groupBy("case_id").agg(F.max(relative_path(F.col("video"))).alias("video_path"))
