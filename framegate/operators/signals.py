"""Change signals between neighbours of an ordered stream, and the importance made of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.config import Sampler
from framegate.plans.durable import durable


def in_order(stream: list[str] = ["media_id"], by: str = "frame_index"):
    return Window.partitionBy(*stream).orderBy(by)


def stepped(df: DataFrame, columns: list[str], stream: list[str] = ["media_id"], index: str = "frame_index") -> DataFrame:
    """df with previous_<column> of the frame numbered one less, for streams numbered without gaps: an equi join by (stream, number), which no
    stream makes heavy. Streams with gaps take plans.order.with_previous."""
    before = df.select(*stream, (F.col(index) + 1).alias(index), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return df.join(before, [*stream, index], "left")


def schedule_step(fps: Column, hz: float) -> Column:
    """Frames from one scheduled candidate to the next: fps / hz rounded half to even, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround(fps / hz).cast("long"))


def scheduled(frame_index: Column, frame_count: Column, step: Column) -> Column:
    """Whether a frame is a scheduled candidate: each step-th, and the last."""
    return (frame_index % step == 0) | (frame_index == frame_count - 1)


def source_interval(t: Column, duration: Column, half_width: Column) -> Column:
    """The stretch of source time that a candidate stands for, as struct(source_start, source_end)."""
    return F.struct(F.greatest(F.lit(0.0), t - half_width).alias("source_start"), F.least(duration, t + half_width).alias("source_end"))


def frame_at(t: Column, fps: Column, frame_count: Column) -> Column:
    """The frame nearest to a time, within the video."""
    return F.least(frame_count - 1, F.greatest(F.lit(0).cast("long"), F.bround(t * fps).cast("long")))


def signature_distance(a: Column, b: Column, scale: float = 255.0) -> Column:
    """Mean absolute difference of two signatures over their scale; 1 where their lengths differ or they are empty. Null if either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).otherwise(total / F.size(a) / scale)


def moved_share(a: Column, b: Column, threshold: float) -> Column:
    """The share of entries that differ by at least the threshold."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d >= threshold)) / F.size(a)


def histogram_distance(p: Column, q: Column) -> Column:
    """Bhattacharyya distance of two histograms that each sum to 1."""
    overlap = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - overlap))


def spikes(df: DataFrame, difference: str, threshold: float, scheduled_flag: str, stream: list[str] = ["media_id"]) -> DataFrame:
    """df with `spike`: the first row of each run at or above the threshold, unless it is scheduled anyway. A stream has a row per frame."""
    above = F.coalesce(F.col(difference) >= threshold, F.lit(False))
    rows = stepped(df.withColumn("_above", above), ["_above"], stream)
    return rows.withColumn("spike", F.col("_above") & ~F.coalesce("previous__above", F.lit(False)) & ~F.col(scheduled_flag)).drop("_above", "previous__above")


#: Bins per doubling of a value, for finding where a rank lies.
BINS = 1024


def robust_scales(df: DataFrame, signals: list[str], stream: list[str] = ["media_id"], share: float = 0.95) -> DataFrame:
    """Per stream the divisor of each signal: the 95th percentile (linear) of its positive values, null if there is none above 1e-12.

    Ranks are found in two readings of df (make it lasting first): values are counted by logarithmic bins before the shuffle, and only the rows of
    the one or two bins that hold the percentile's ranks are sorted, so no task sorts or holds a whole stream.
    """
    value = lambda c: F.when(~F.isnan(c) & (F.col(c) > 0), F.col(c).cast("double"))
    key = [*stream, "_signal"]
    rows = df.select(*stream, F.posexplode(F.array(*[value(c) for c in signals])).alias("_signal", "_value")).where("_value is not null")
    rows = rows.withColumn("_bin", F.floor(F.log2("_value") * BINS))
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_at": (F.sum("_n").over(whole) - 1) * share})
    bins = bins.where((F.col("_before") + F.col("_n") > F.floor("_at")) & (F.col("_before") <= F.ceil("_at"))).drop("_n")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*key, "_bin").orderBy("_value")) - 1
    held = rows.join(bins, [*key, "_bin"]).withColumn("_place", place).where((F.col("_place") == F.floor("_at")) | (F.col("_place") == F.ceil("_at")))
    ends = held.groupBy(*key).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.first(F.col("_at") - F.floor("_at")).alias("_part"))
    found = ends.withColumn("_p", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).where("_p > 1e-12")
    scales = found.groupBy(*stream).agg(*[F.max(F.when(F.col("_signal") == i, F.col("_p"))).alias(f"{c}_p95") for i, c in enumerate(signals)])
    return df.select(*stream).distinct().join(scales, stream, "left")


def scaled(signal: Column, p95: Column) -> Column:
    """A signal over its divisor, clipped to [0, 1.5]; 0 without a divisor or a value."""
    value = F.when(~F.isnan(signal), signal)
    return F.coalesce(F.least(F.lit(1.5), F.greatest(F.lit(0.0), value / p95)), F.lit(0.0))


def with_importance(df: DataFrame, frame: str, histogram: str, motion: str, stream: list[str], config: Sampler = Sampler(), name: str = "importance") -> DataFrame:
    """df with the weighted mean of its scaled signals, plus the boost where the raw frame or histogram signal reaches the scene threshold."""
    signals = [frame, histogram, motion]
    weights = [config.frame_weight, config.histogram_weight, config.motion_weight]
    df = durable(df)  # counted, picked from and scaled
    joined = df.join(robust_scales(df, signals, stream), stream)
    mean = sum((scaled(F.col(c), F.col(f"{c}_p95")) * w for c, w in zip(signals, weights)), F.lit(0.0)) / sum(weights)
    raw = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    cut = F.greatest(raw(frame), raw(histogram)) >= config.scene_threshold
    return joined.withColumn(name, mean + F.when(cut, config.scene_boost).otherwise(0.0)).withColumn("scene_change", cut).drop(*[f"{c}_p95" for c in signals])
