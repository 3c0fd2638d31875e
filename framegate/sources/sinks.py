"""Where results go: tables, JSON documents and image files."""

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.functions.pixels import png
from framegate.sources.video import frame_name, pixels


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table, partitioned by columns if asked. Rows of one partition value are written by as many tasks as hold them."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_report(value: dict, path: Path | str) -> Path:
    """One document with sorted keys: a report of a bounded number of values."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return path


def write_frames(frames: DataFrame, folder: str, encode=png, suffix: str = "png") -> DataFrame:
    """Frames as image files in their original size, in a folder that every executor sees; columns media_id, frame_index, file.

    A frame that is given twice is written once. The executors write; the result is read to make them do so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples():
                path = Path(folder) / r.file
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(encode(pixels(r.data, r.width, r.height)))
            yield f[["media_id", "frame_index", "file"]]

    named = frames.dropDuplicates(["media_id", "frame_index"]).withColumn("file", frame_name(F.col("frame_index"), F.col("timestamp_s"), suffix))
    return named.mapInPandas(run, "media_id string, frame_index long, file string")


def event_image_name(sequence: Column, timestamp: Column, role: Column, suffix: str = "png") -> Column:
    return F.concat(F.format_string("event_%05d_%012.3fs_", sequence, timestamp), role, F.lit(f".{suffix}"))


def candidate_json(df: DataFrame) -> DataFrame:
    """Candidates in their document form: the interval as an array, signals as an object."""
    return df.select(F.to_json(F.struct(
        "frame_index", F.col("timestamp_s").alias("timestamp"), F.array("source_start", "source_end").alias("source_interval"), "importance", "discovery",
        F.struct("frame_difference", "histogram_difference", "motion_score", "scene_change").alias("signals"),
    )).alias("value"))


def write_event_images(images: DataFrame, folder: str, suffix: str = "png") -> DataFrame:
    """The images of events as files, in a folder that every executor sees; columns media_id, sequence_no, position, role, width, height, patches, file.

    images: as from operators.frames.event_images. The executors write; the result is read to make them do so, and a task that runs again writes the same files.
    """
    columns = ["media_id", "sequence_no", "position", "role", "width", "height", "patches", "file"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for name, data in zip(f["file"], f["data"]):
                path = Path(folder) / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(data)
            yield f[columns]

    own = F.concat(F.substring(F.sha2("media_id", 256), 1, 16), F.lit("/"), event_image_name(F.col("sequence_no"), F.col("timestamp_s"), F.col("role"), suffix))
    kind = images.schema["media_id"].dataType.simpleString()
    return images.withColumn("file", own).mapInPandas(run, f"media_id {kind}, sequence_no long, position int, role string, width int, height int, patches long, file string")


def observation_json(events: DataFrame, files: DataFrame) -> DataFrame:
    """Observations in their document form, each with its images in order (four at most). files: as from write_event_images."""
    image = F.struct("position", "role", "file", "width", "height", "patches")
    shown = files.groupBy("media_id", "sequence_no").agg(F.array_sort(F.collect_list(image)).alias("images"))
    box = ("x", "y", "width", "height", "frame_width", "frame_height")
    rows = events.withColumn("region", F.when(F.col("x").isNotNull(), F.struct(*box))).drop(*box) if "x" in events.columns else events
    rows = rows.join(shown, ["media_id", "sequence_no"], "left")
    return rows.select("media_id", "sequence_no", F.to_json(F.struct(*[c for c in rows.columns if c != "media_id"])).alias("value"))
