"""Frames: rows of (media_id, frame_index, timestamp_s, width, height, data), data in BGR order row by row."""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "media_id string, frame_index long, timestamp_s double, width int, height int, data binary"
MEDIA = "media_id string, fps double, frame_count long, width int, height int, fourcc string, duration_seconds double, error string"
#: Turns one encoded frame into pixels; for codecs that are not plain bitmaps.
Decoder = Callable[[bytes, int, int], np.ndarray]


def fourcc_text(code: Column) -> Column:
    """The four letters of a codec number, lowest byte first, without zero bytes."""
    letters = [F.shiftright(code.cast("long"), 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    return F.concat(*[F.when(c == 0, "").otherwise(F.char(c)) for c in letters])


def media_error(fps: Column, frames: Column, width: Column, height: Column) -> Column:
    """Why a video can't be used, null if it can."""
    bad = F.coalesce((fps <= 0) | F.isnan(fps) | (frames <= 0) | (width <= 0) | (height <= 0), F.lit(True))
    return F.when(bad, "invalid video metadata")


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read_avi(content: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """Header and (offset, length) of each video frame of an AVI container."""
    data = memoryview(content)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    head = {"fps": 0.0, "frame_count": 0, "width": 0, "height": 0, "fourcc": "", "bits": 24}
    frames: list[tuple[int, int]] = []

    def walk(at: int, end: int) -> None:
        for kind, a, size in _chunks(data, at, end):
            if kind == b"LIST":
                walk(a + 4, a + size)
            elif kind == b"strh" and bytes(data[a : a + 4]) == b"vids":
                scale, rate = struct.unpack_from("<II", data, a + 20)
                head["fps"] = rate / scale if scale else 0.0
                head["frame_count"] = struct.unpack_from("<I", data, a + 32)[0]
                head["fourcc"] = bytes(data[a + 4 : a + 8]).rstrip(b"\0").decode("latin-1")
            elif kind == b"strf" and not head["width"]:
                _, head["width"], head["height"], _, head["bits"] = struct.unpack_from("<IiiHH", data, a)
            elif kind in (b"00db", b"00dc"):
                frames.append((a, size))

    walk(12, len(data))
    return head, frames


def write_avi(frames: list[np.ndarray], fps: int) -> bytes:
    """An AVI file of plain bitmaps."""
    h, w = frames[0].shape[:2]
    pad = -w * 3 % 4
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = [chunk(b"00db", np.pad(f[::-1].reshape(h, w * 3), ((0, 0), (0, pad))).tobytes()) for f in frames]
    avih = struct.pack("<IIIIIIIIII16x", 1_000_000 // fps, 0, 0, 0, len(frames), 0, 1, 0, w, h)
    strh = b"vids" + b"DIB " + struct.pack("<IHHIIIIIIII8x", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0)
    strf = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"movi" + b"".join(body)))


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def probe(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Metadata of AVI files, with the reason where one can't be used; columns MEDIA. A path that does not exist is an error at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    head, _ = read_avi(content)
                    out.append((path, head["fps"], head["frame_count"], head["width"], abs(head["height"]), head["fourcc"]))
                except (ValueError, struct.error):
                    out.append((path, 0.0, 0, 0, 0, None))
            yield pd.DataFrame(out, columns=["media_id", "fps", "frame_count", "width", "height", "fourcc"])

    rows = _files(spark, paths).mapInPandas(run, "media_id string, fps double, frame_count long, width int, height int, fourcc string")
    duration = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0)
    return rows.withColumns({"duration_seconds": duration, "error": media_error(*map(F.col, ("fps", "frame_count", "width", "height")))})


def frames_from_avi(spark: SparkSession, paths: str | list[str], decode: Decoder | None = None) -> DataFrame:
    """Every frame of AVI files in order, one file per task. Bitmaps are read here, other codecs by `decode`. A file that holds fewer
    frames than it declares is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                head, places = read_avi(content)
                w, h = head["width"], abs(head["height"])
                if len(places) < head["frame_count"]:
                    raise ValueError(f"decode stopped at frame {len(places)} of {head['frame_count']}")
                for i, (at, size) in enumerate(places):
                    raw = content[at : at + size]
                    if decode is not None:
                        pixels = decode(raw, w, h)
                    elif head["bits"] == 24 and head["fourcc"] in ("DIB", "DIB ", ""):
                        rows = np.frombuffer(raw, np.uint8).reshape(h, -1)[:, : w * 3].reshape(h, w, 3)
                        pixels = rows[::-1] if head["height"] > 0 else rows
                    else:
                        raise ValueError(f"no decoder for {head['fourcc']!r}")
                    yield pd.DataFrame({"media_id": [path], "frame_index": [i], "timestamp_s": [i / head["fps"]], "width": [w], "height": [h], "data": [np.ascontiguousarray(pixels).tobytes()]})

    return _files(spark, paths).mapInPandas(run, FRAMES)


def frames_from_images(spark: SparkSession, folder: str, fps: float) -> DataFrame:
    """Frames kept as image files <media_id>/<anything>_<frame_index>.<png|jpg>, read by Spark's image source, which has the same pixel order."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.*")
    index = F.regexp_extract("origin", r"_(\d+)\.[A-Za-z]+$", 1).cast("long")
    return rows.where("nChannels = 3").select(F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1).alias("media_id"), index.alias("frame_index"), (index / F.lit(float(fps))).alias("timestamp_s"), "width", "height", "data")


def requested(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the frames asked for; wanted: media_id, frame_index. Data of the others is not shuffled where the request is small enough to broadcast."""
    return frames.join(wanted.select("media_id", "frame_index").distinct(), ["media_id", "frame_index"], "left_semi")


def frame_name(frame_index: Column, timestamp: Column, suffix: str = "png") -> Column:
    return F.format_string(f"frame_%09d_%012.3fs.{suffix}", frame_index, timestamp)


def pixels(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)
