"""Seven small videos with known events, drawn with numpy: what selection and gate are measured on."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framegate.sources.video import FRAMES

WIDTH, HEIGHT, FPS, SECONDS, BUDGET = 160, 96, 20.0, 6.0, 6
FRAME_COUNT = int(FPS * SECONDS)
# Fixed values: (case, event, start, end, tolerance), the ground truth of the suite.
EVENTS = (
    ("static_short_motion", "moving_object", 2.50, 3.10, 0.10),
    ("hard_scene_cuts", "cut_one", 2.0, 2.05, 0.10),
    ("hard_scene_cuts", "cut_two", 4.0, 4.05, 0.10),
    ("slow_change", "change_complete", 4.8, 5.2, 0.10),
    ("brief_flash", "flash", 2.60, 2.60, 0.03),
    ("continuous_motion", "local_marker", 2.75, 3.05, 0.10),
    ("repetitive_motion", "color_change", 4.0, 4.3, 0.10),
    ("camera_pan", "local_marker", 3.25, 3.60, 0.10),
)
CASES = tuple(dict.fromkeys(c for c, *_ in EVENTS))


# The drawing of the suite. Boxes are (left, top, right, bottom) with both ends, disks (x, y, radius); colours are blue, green, red.
GRID = (("box", (0, 0, 159, 95), 28), ("box", (0, 72, 159, 72), 65), ("box", (8, 8, 35, 28), 52))
CUTS = ((0, (30, 45, 150)), (40, (140, 45, 30)), (80, (30, 145, 55)))
#: What is there only for some frames: (case, first frame, last frame, shape, place, colour).
MARKS = (
    ("slow_change", 96, 119, "disk", (80, 47, 2), 90),
    ("brief_flash", 52, 52, "box", (0, 0, 159, 95), 255),
    ("continuous_motion", 55, 61, "disk", (80, 48, 5), (0, 0, 255)),
    ("camera_pan", 65, 72, "box", (74, 42, 86, 54), (10, 10, 245)),
)
ROWS, COLUMNS = np.mgrid[0:HEIGHT, 0:WIDTH]


def _draw(frame: np.ndarray, shape: str, place: tuple, color) -> None:
    if shape == "box":
        left, top, right, bottom = place
        frame[top : bottom + 1, max(0, left) : right + 1] = color
    else:
        x, y, radius = place
        frame[(COLUMNS - x) ** 2 + (ROWS - y) ** 2 <= radius**2] = color


def _layers(case: str, index: int) -> Iterator[tuple[str, tuple, object]]:
    """What a frame of a case is drawn of, from back to front, but for its marks."""
    if case in ("static_short_motion", "slow_change", "brief_flash", "repetitive_motion"):
        yield from GRID
    if case == "static_short_motion" and 50 <= index <= 62:
        x = 45 + (index - 50) * 70 // 12
        yield "box", (x, 42, x + 16, 58), 235
    elif case == "hard_scene_cuts":
        yield "box", (0, 0, 159, 95), [color for first, color in CUTS if first <= index][-1]
        yield "disk", (80, 48, 15), 220
    elif case == "slow_change":
        yield "box", (55, 30, 105, 65), 28 + int(32 * min(1.0, max(0.0, (index / FPS - 1) / 4)))
    elif case == "repetitive_motion":
        x = 105 if index // 5 % 2 else 35
        yield "box", (x, 38, x + 18, 57), (20, 20, 250) if 80 <= index <= 86 else 230
    elif case == "camera_pan":
        for x in range(-(index * 3 % 32), WIDTH, 32):
            if x + 15 >= 0:
                yield "box", (x, 0, x + 15, 95), (38, 52, 72)


def render(case: str, t: float) -> np.ndarray:
    """The frame of a case at a time."""
    if case not in CASES:
        raise ValueError(f"unknown case {case}")
    index = round(t * FPS)
    frame = np.zeros((HEIGHT, WIDTH, 3), np.uint8)
    if case == "continuous_motion":  # a ramp that moves 5 pixels a frame
        frame[:] = ((COLUMNS - 5 * index) % WIDTH).astype(np.uint8)[..., None]
    for layer in _layers(case, index):
        _draw(frame, *layer)
    for own, first, last, *mark in MARKS:
        if own == case and first <= index <= last:
            _draw(frame, *mark)
    return frame


def frames(spark: SparkSession, cases: tuple[str, ...] = CASES) -> DataFrame:
    """All frames of the cases, drawn by the executors."""
    names = list(cases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                case, index = names[i // FRAME_COUNT], int(i % FRAME_COUNT)
                out.append((case, index, index / FPS, WIDTH, HEIGHT, render(case, index / FPS).tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES.split(", ")])

    return spark.range(len(names) * FRAME_COUNT).mapInPandas(run, FRAMES)


def media(spark: SparkSession, cases: tuple[str, ...] = CASES) -> DataFrame:
    rows = [(c, FPS, FRAME_COUNT, WIDTH, HEIGHT, SECONDS) for c in cases]
    return spark.createDataFrame(rows, "media_id string, fps double, frame_count long, width int, height int, duration_seconds double")


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{c}/{e}", c, a, b, tol) for c, e, a, b, tol in EVENTS], "label_id string, media_id string, start_s double, end_s double, tolerance double")
