"""Regions of a frame as struct expressions: x, y, width, height, frame_width, frame_height."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def region(x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    parts = dict(x=x, y=y, width=width, height=height, frame_width=frame_width, frame_height=frame_height)
    return F.struct(*[c.cast("int").alias(k) for k, c in parts.items()])


def area_ratio(r: Column) -> Column:
    frame = r["frame_width"] * r["frame_height"]
    return F.when(frame > 0, r["width"] * r["height"] / frame).otherwise(0.0)


def expanded(r: Column, margin: int) -> Column:
    """The region with a margin on each side, within its frame."""
    x, y = F.greatest(F.lit(0), r["x"] - margin), F.greatest(F.lit(0), r["y"] - margin)
    x2 = F.least(r["frame_width"], r["x"] + r["width"] + margin)
    y2 = F.least(r["frame_height"], r["y"] + r["height"] + margin)
    return region(x, y, x2 - x, y2 - y, r["frame_width"], r["frame_height"])


def merged(r: Column) -> Column:
    """Aggregate: the smallest region that holds all regions of a group; an error where their frames differ in size."""
    x, y = F.min(r["x"]), F.min(r["y"])
    w, h = F.max(r["x"] + r["width"]) - x, F.max(r["y"] + r["height"]) - y
    same = (F.min(r["frame_width"]) == F.max(r["frame_width"])) & (F.min(r["frame_height"]) == F.max(r["frame_height"]))
    box = region(x, y, w, h, F.max(r["frame_width"]), F.max(r["frame_height"]))
    return F.when(F.count(r) == 0, None).when(same, box).otherwise(F.raise_error("cannot merge regions from different frame sizes").cast("struct<x:int,y:int,width:int,height:int,frame_width:int,frame_height:int>"))


def normalized(r: Column) -> Column:
    """The region as shares of its frame."""
    w, h = r["frame_width"], r["frame_height"]
    return F.struct((r["x"] / w).alias("x"), (r["y"] / h).alias("y"), (r["width"] / w).alias("width"), (r["height"] / h).alias("height"))


def is_normalized(r: Column) -> Column:
    """Whether a struct of shares lies within the frame, with an area."""
    x, y, w, h = (r[k] for k in ("x", "y", "width", "height"))
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h))
    return F.coalesce(finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1 + 1e-9) & (y + h <= 1 + 1e-9), F.lit(False))


def in_pixels(r: Column, frame_width: Column, frame_height: Column) -> Column:
    """A region of shares in whole pixels: lower ends down, upper ends up, at least one pixel each way."""
    x = F.least(frame_width - 1, F.floor(r["x"] * frame_width))
    y = F.least(frame_height - 1, F.floor(r["y"] * frame_height))
    x2 = F.least(frame_width, F.ceil((r["x"] + r["width"]) * frame_width))
    y2 = F.least(frame_height, F.ceil((r["y"] + r["height"]) * frame_height))
    return F.when(is_normalized(r), region(x, y, F.greatest(F.lit(1), x2 - x), F.greatest(F.lit(1), y2 - y), frame_width, frame_height))


def patches(width: Column, height: Column) -> Column:
    """Patches of 32 x 32 pixels that an image takes."""
    return (F.ceil(width / 32) * F.ceil(height / 32)).cast("long")


def capped(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height of an image after it is scaled down to a width, never up."""
    scaled = F.greatest(F.lit(1).cast("long"), F.bround(height * most / width).cast("long"))
    return F.least(width, F.lit(most)).cast("long"), F.when(width > most, scaled).otherwise(height.cast("long"))


def images(r: Column, frame_width: Column, frame_height: Column, has_before: Column, has_peak: Column, margin: int = 12, context_width: int = 384, detail_width: int = 768) -> Column:
    """The images that go with an event, in order: array of struct(role, width, height, patches, cut); cut: the region with its margin, not the frame.

    Without a region: the whole frame as context. With a region that fills most of the frame once it has its margin: the
    whole frame as detail. Otherwise a small context and the cut-out region as detail. The image before an action comes first, the peak of
    the change last; both are cut as the detail is.
    """

    def image(role: str, w: Column, h: Column, most: int, of_region: Column = F.lit(False)) -> Column:
        cw, ch = capped(w, h, most)
        return F.struct(F.lit(role).alias("role"), cw.alias("width"), ch.alias("height"), patches(cw, ch).alias("patches"), of_region.alias("cut"))

    large = expanded(r, margin)
    kind = "array<struct<role:string,width:bigint,height:bigint,patches:bigint,cut:boolean>>"
    none = F.array().cast(kind)
    cut = F.struct(large.alias("box"), (F.coalesce(area_ratio(large), F.lit(0.0)) >= 0.60).alias("fills"), r.isNull().alias("whole"), frame_width.alias("fw"), frame_height.alias("fh"), has_before.alias("before"), has_peak.alias("peak"))

    def build(v: Column) -> Column:
        w = F.when(v["fills"] | v["whole"], v["fw"]).otherwise(v["box"]["width"])
        h = F.when(v["fills"] | v["whole"], v["fh"]).otherwise(v["box"]["height"])
        part = ~(v["fills"] | v["whole"])
        before = F.when(v["before"], F.array(image("before_action", w, h, detail_width, part))).otherwise(none)
        middle = F.when(v["whole"], F.array(image("context", v["fw"], v["fh"], detail_width))).when(v["fills"], F.array(image("detail", v["fw"], v["fh"], detail_width))).otherwise(
            F.array(image("context", v["fw"], v["fh"], context_width), image("detail", w, h, detail_width, part))
        )
        peak = F.when(v["peak"] & ~v["whole"], F.array(image("change_peak", w, h, detail_width, part))).otherwise(none)
        return F.concat(before, middle, peak)

    return F.transform(F.array(cut), build)[0]
