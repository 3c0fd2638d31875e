"""The methods on the synthetic suite, side by side."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.config import Sampler
from framegate.operators import frames as fr
from framegate.operators import metrics, select, signals
from framegate.plans.durable import durable
from framegate.sources import synthetic

METHODS = ("uniform", "score_only", "hybrid_no_spike_guard", "hybrid")


def case_results(spark: SparkSession, cases: tuple[str, ...] = synthetic.CASES) -> DataFrame:
    """Per method and case: event_recall, redundancy, temporal_coverage, and what the method had to look at (nothing, for uniform)."""
    media, frames = synthetic.media(spark, cases), synthetic.frames(spark, cases)
    truth = synthetic.truth(spark).where(F.col("media_id").isin(*cases))
    scored = {guard: durable(fr.candidates(frames, media, Sampler(spike_guard=guard, budget=synthetic.BUDGET))) for guard in (True, False)}
    out = None
    for method in METHODS:
        guard = method in ("score_only", "hybrid")
        config = Sampler(budget=synthetic.BUDGET, spike_guard=guard, strategy="hybrid" if method.startswith("hybrid") else method)
        rows = scored[guard]
        picked = select.greedy_select(rows, "media_id", config, "signature").join(rows, ["media_id", "frame_index"])
        picked = durable(picked.join(media.select("media_id", "duration_seconds"), "media_id"))
        recall = metrics.event_recall(truth.withColumn("case", F.col("media_id")), picked, ["case"], "label_id", "timestamp_s", "media_id").select(F.col("case").alias("media_id"), F.col("recall").alias("event_recall"))
        again = metrics.redundancy(picked, "media_id", "frame_index", lambda a, b: signals.signature_distance(F.col(f"{a}.signature"), F.col(f"{b}.signature")), config.duplicate_threshold).select("media_id", "redundancy")
        spread = metrics.temporal_coverage(picked, ["media_id"], "timestamp_s", "duration_seconds", config.budget).select("media_id", F.col("coverage").alias("temporal_coverage"))
        seen = rows.groupBy("media_id").agg(F.count_if(F.col("discovery") == "scheduled").alias("full_analysis_candidates"), F.count_if(F.col("discovery") == "spike_guard").alias("promoted_spikes"))
        if method == "uniform":
            seen = seen.withColumns({"full_analysis_candidates": F.lit(0).cast("long"), "promoted_spikes": F.lit(0).cast("long")})
        seen = seen.withColumn("coarse_scanned_frames", F.lit(synthetic.FRAME_COUNT if guard else 0).cast("long"))
        one = recall.join(again, "media_id").join(spread, "media_id").join(seen, "media_id").withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


def method_results(cases: DataFrame) -> DataFrame:
    """Mean of each measure per method."""
    measures = ["event_recall", "redundancy", "temporal_coverage", "full_analysis_candidates", "promoted_spikes", "coarse_scanned_frames"]
    return metrics.means(cases, ["method"], measures)
