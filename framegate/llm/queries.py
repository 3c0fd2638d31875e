"""The p queries: the operators of this subpackage over the tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.functions.text import relative_path, stripped
from framegate.llm import bpe, group_split, leaks, lookalike, nearest, one_rank, quota_sample, runs, top_n
from framegate.operators.versions import latest
from framegate.plans.durable import durable
from framegate.sources.tables import table

SCORES = ["frame_difference", "histogram_difference", "motion_score", "importance"]


def _labels(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return latest(table(spark, folder, "labeled_events").where("label_id is not null"), ["label_id"], "ingested_at", list(keep))


def _video(c):
    return F.when(relative_path(c) != "", relative_path(c))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """case_id and the video that its rows name."""
    cases = table(spark, folder, "evaluation_cases").where("case_id is not null").select("case_id", _video(F.col("video")).alias("video"))
    return cases.groupBy("case_id").agg(F.max("video").alias("video"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "candidates").where("video_path is not null and frame_index is not null"), ["video_path", "frame_index"], "ingested_at", ["importance"])
    return top_n.top_n(rows, ["video_path"], "importance", ["frame_index"], 6).select("video_path", "frame_index")


def _sample_plan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    labels = quota_sample.leaves(_labels(spark, folder, "category", "risk"), "category", "risk")
    return labels, quota_sample.allocation(labels, table(spark, folder, "sample_profiles"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.report(_sample_plan(spark, folder)[1]).where("needed > existing").select("profile_id", "target_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.report(_sample_plan(spark, folder)[1])


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    labels, plan = _sample_plan(spark, folder)
    return quota_sample.draw(labels, plan, "label_id")


def p2_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows, and how many different labels, the sample has for each target from where."""
    return p2_sample(spark, folder).groupBy("profile_id", "target_id", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label_id").alias("labels"))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    labels = _labels(spark, folder, "case_id", "source_transition_id").join(_cases(spark, folder), "case_id", "left")
    entity = F.when(F.col("video").isNotNull(), F.concat(F.lit("v:"), "video")).when(F.col("case_id").isNotNull(), F.concat(F.lit("c:"), "case_id"))
    transition = F.lower(stripped(F.col("source_transition_id")))
    return group_split.bind(labels, "label_id", [entity, F.when(transition != "", transition)])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).select("label_id", "group_id")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.splits(_groups(spark, folder), "label_id", table(spark, folder, "split_targets"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.shares(p3_splits(spark, folder), table(spark, folder, "split_targets"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "perception_events").where("video_path is not null and sequence_no is not null")
    events = latest(events, ["video_path", "sequence_no"], "ingested_at", ["reason", "change_fraction", "timestamp_s"], in_order=True)
    events = events.withColumn("reason", F.lower(stripped(F.col("reason"))))
    return runs.collapse_runs(events, ["video_path"], "sequence_no", "reason", "timestamp_s", "change_fraction", 0.01, 2.0, placed=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).where("events >= 2").select("video_path", "first_sequence", "last_sequence")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = _labels(spark, folder, "case_id", "start_s", "tolerance").join(_cases(spark, folder), "case_id")
    events = table(spark, folder, "perception_events").where("video_path is not null and sequence_no is not null")
    events = latest(events, ["video_path", "sequence_no"], "ingested_at", ["timestamp_s"])
    found = nearest.nearest_in_time(labels, events, "video", "label_id", "start_s", "tolerance", "video_path", "sequence_no", "timestamp_s")
    return found.select(F.col("left_id").alias("label_id"), F.col("right_id").alias("sequence_no"))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("video_path is not null and frame_index is not null")
    rows = rows.join(table(spark, folder, "rank_panel").select("video_path"), "video_path", "left_semi")
    return durable(latest(rows, ["video_path", "frame_index"], "ingested_at", ["analyzer_build", *SCORES]))  # counted and ranked


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return one_rank.first_of_ranking(_panel(spark, folder), ["video_path"], "analyzer_build", ["frame_index"], SCORES).select("video_path", "frame_index")


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return one_rank.one_ranking(_panel(spark, folder), ["video_path"], "analyzer_build", ["frame_index"], SCORES).select("video_path", "frame_index", "place")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("run_words") >= leaks.WINDOW).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "heldout_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, folder, "documents"), "doc_id", "text")


def p9_form(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.with_form(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p2_sample, p2_drawn, p3_found, p3_splits, p3_shares, p4_found, p4_runs, p5_found, p6_found, p6_ranking, p7_ids, p8_found, p8_leaks, p9_found, p9_classes, p9_form)}
