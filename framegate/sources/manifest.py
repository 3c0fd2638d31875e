"""Evaluation manifests: JSON files of cases with labelled events, as one row per label."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.functions.text import vocabulary_key

EVENT = (
    "id string, start double, `end` double, tolerance double, region struct<x:double,y:double,width:double,height:double>, acceptable_states array<string>, category string, risk string, "
    "before_timestamp double, after_timestamp double, action string, expected_result string, source_transition_id string, real_world_eligible boolean, notes string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labels with case_id, video, goal and the defaults: tolerance 0, risk normal, eligible, category other (version 1), no states.

    Errors when read: a version other than 1 and 2, no cases, a case id that repeats, a version-2 event without a category. Unknown keys
    are ignored.
    """
    event = "struct<" + ", ".join(f"{c.strip().split(' ', 1)[0]}:{c.strip().split(' ', 1)[1]}" for c in _split(EVENT)) + ">"
    rows = spark.read.schema(f"schema_version int, cases array<struct<id:string,video:string,goal:string,events:array<{event}>>>").option("multiLine", True).json(path)
    version = F.col("schema_version")
    problem = F.when(version.isNull() | ~version.isin(1, 2), "manifest schema_version must be 1 or 2").when(F.size(F.coalesce("cases", F.array().cast(rows.schema["cases"].dataType))) == 0, "manifest must contain at least one case")
    problem = problem.when(F.size(F.array_distinct("cases.id")) < F.size("cases"), "manifest has duplicate case ids")
    checked = rows.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    cases = checked.select("schema_version", F.explode("cases").alias("c"))
    events = cases.select("schema_version", F.col("c.id").alias("case_id"), "c.video", "c.goal", F.explode("c.events").alias("e"))
    missing = (F.col("schema_version") == 2) & F.col("e.category").isNull()
    events = events.where(F.when(missing, F.raise_error(F.concat(F.lit("category is missing in "), "e.id")).cast("boolean")).otherwise(True))
    return events.select(
        "case_id", "video", "goal", F.col("e.id").alias("event_id"), F.col("e.start").alias("start_s"), F.col("e.end").alias("end_s"), F.coalesce("e.tolerance", F.lit(0.0)).alias("tolerance"), "e.region",
        F.coalesce("e.acceptable_states", F.array().cast("array<string>")).alias("acceptable_states"), F.coalesce(vocabulary_key(F.col("e.category")), F.lit("other")).alias("category"), F.coalesce(vocabulary_key(F.col("e.risk")), F.lit("normal")).alias("risk"),
        "e.before_timestamp", "e.after_timestamp", F.col("e.action").alias("action_text"), "e.expected_result", "e.source_transition_id", F.coalesce("e.real_world_eligible", F.lit(True)).alias("real_world_eligible"), F.coalesce("e.notes", F.lit("")).alias("notes"),
    )


def _split(fields: str) -> list[str]:
    """Fields at the top level of a DDL list."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]
