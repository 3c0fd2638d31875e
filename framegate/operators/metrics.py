"""Quality measures of selections, and audits of labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.config import CATEGORIES, RISKS, Profile
from framegate.functions.heap import top_values
from framegate.functions.stats import rate


def interval_distance(t: Column, start: Column, end: Column) -> Column:
    """0 inside an interval, otherwise the way to its nearer end."""
    return F.greatest(start - t, t - end, F.lit(0.0))


def by_slice(points: DataFrame, intervals: DataFrame, entity: str, time: str, start: str, end: str, slice_seconds: float) -> DataFrame:
    """Points joined with the intervals they lie in. Both are cut into slices of time, so the join is by (entity, slice) with a residual
    range test and an entity of any size spreads over its slices. An interval is copied to each slice it touches."""
    cut = lambda c: F.floor(c / slice_seconds)
    p = points.withColumn("_slice", cut(F.col(time)))
    i = intervals.withColumn("_slice", F.explode(F.sequence(cut(F.col(start)), cut(F.col(end)))))
    return p.join(i, [entity, "_slice"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_slice")


def event_recall(events: DataFrame, selected: DataFrame, group: list[str], key: str, time: str, entity: str, slice_seconds: float = 64.0) -> DataFrame:
    """Per group the share of labelled intervals [start_s - tolerance, end_s + tolerance] that hold a selected time; 1 without labels.

    events: group + key, entity, start_s, end_s, tolerance. selected: entity, time.
    """
    reach = events.select(*group, key, entity, (F.col("start_s") - F.col("tolerance")).alias("_a"), (F.col("end_s") + F.col("tolerance")).alias("_b"))
    hit = by_slice(selected.select(entity, time), reach, entity, time, "_a", "_b", slice_seconds).select(*group, key).distinct()
    all_rows = events.select(*group, key).join(hit.withColumn("_hit", F.lit(1)), [*group, key], "left")
    out = all_rows.groupBy(*group).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("recalled"))
    return out.withColumn("recall", rate(F.col("recalled"), F.col("events"), 1.0))


def redundancy(selected: DataFrame, stream: str, index: str, distance, threshold: float) -> DataFrame:
    """Per stream the share of rows nearer than the threshold to any earlier row; 0 under two rows. `distance(a, b)` takes two row aliases.

    The pairs are those of a selection, of at most the budget's rows per stream, not of all rows.
    """
    later, earlier = selected.alias("later"), selected.alias("earlier")
    close = (F.col(f"later.{stream}") == F.col(f"earlier.{stream}")) & (F.col(f"earlier.{index}") < F.col(f"later.{index}"))
    pairs = later.join(earlier, close).where(distance("earlier", "later") < threshold)
    hits = pairs.select(F.col(f"later.{stream}").alias(stream), F.col(f"later.{index}").alias(index)).distinct().groupBy(stream).agg(F.count(F.lit(1)).alias("_hits"))
    rows = selected.groupBy(stream).agg(F.count(F.lit(1)).alias("selected")).join(hits, stream, "left")
    return rows.select(stream, "selected", F.coalesce("_hits", F.lit(0).cast("long")).alias("redundant"), rate(F.coalesce("_hits", F.lit(0)), F.col("selected")).alias("redundancy"))


def temporal_coverage(selected: DataFrame, stream: list[str], time: str, duration: str, budget: int) -> DataFrame:
    """Per stream the share of equal bins of its duration that hold a selected time; as many bins as rows, the budget at most."""
    counts = selected.groupBy(*stream).agg(F.least(F.lit(budget), F.count(F.lit(1))).alias("_bins"))
    rows = selected.join(counts, stream)
    at = F.when(F.col(duration) > 0, F.least(F.col("_bins") - 1, (F.col(time) / F.col(duration) * F.col("_bins")).cast("long"))).otherwise(0)
    out = rows.groupBy(*stream).agg(F.count_distinct(at).alias("covered"), F.max("_bins").cast("long").alias("bins"))
    return out.withColumn("coverage", F.col("covered") / F.col("bins"))


def means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean of each metric over cases."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def importance_summary(df: DataFrame, stream: list[str], importance: str = "importance") -> DataFrame:
    """Rows, and the least, greatest and mean importance, 0 where there is none."""
    value = F.when(~F.isnan(importance), F.col(importance))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*stream).agg(F.count(F.lit(1)).alias("rows"), zero(F.min(value)).alias("importance_min"), zero(F.max(value)).alias("importance_max"), zero(F.avg(value)).alias("importance_mean"))


def audit_counts(labels: DataFrame, profile: Profile) -> DataFrame:
    """A row per category (with target and deficit) and per risk (target null): kind, name, labels, eligible, target, deficit.

    labels: category, risk, real_world_eligible. Names without labels count 0; one aggregation serves both vocabularies.
    """
    spark = labels.sparkSession
    names = [("category", c, profile.targets.get(c, 0)) for c in CATEGORIES] + [("risk", r, None) for r in RISKS]
    wanted = spark.createDataFrame(names, "kind string, name string, target long")
    each = labels.select("real_world_eligible", F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("risk").alias("kind"), F.col("risk").alias("name")))).alias("e"))
    counts = each.groupBy(F.col("e.kind").alias("kind"), F.col("e.name").alias("name")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce("real_world_eligible", F.lit(True))).alias("_e"))
    out = wanted.join(counts, ["kind", "name"], "left").withColumns({"labels": F.coalesce("_n", F.lit(0)), "eligible": F.coalesce("_e", F.lit(0))})
    return out.select("kind", "name", "labels", "eligible", "target", F.when(F.col("kind") == "category", F.greatest(F.lit(0), F.col("target") - F.col("eligible"))).alias("deficit"))


def audit_marks(labels: DataFrame) -> DataFrame:
    """One row: labels, those with a region, with acceptable states, with both, and the different transitions of eligible labels. labels: region, acceptable_states,
    transition, real_world_eligible."""
    region, states = F.col("region").isNotNull(), F.coalesce(F.size("acceptable_states") > 0, F.lit(False))
    return labels.agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(region).alias("with_region"), F.count_if(states).alias("with_states"), F.count_if(region & states).alias("with_both"),
        F.count_distinct(F.when(F.coalesce("real_world_eligible", F.lit(True)), F.col("transition"))).alias("independent_transitions"),
    )


def duplicate_transitions(labels: DataFrame, transition: Column, key: Column, shown: int | None = None) -> DataFrame:
    """Transitions that more than one label uses, a row per label: transition, labels (how many use it), key. With `shown` a row per transition with
    the first keys in order instead: transition, labels, keys."""
    rows = labels.select(transition.alias("transition"), key.alias("_k")).where("transition is not null")
    counts = rows.groupBy("transition").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1")
    if shown is None:
        return rows.withColumnRenamed("_k", "key").join(counts, "transition")
    firsts = rows.join(counts.select("transition"), "transition", "left_semi").groupBy("transition")
    return counts.join(firsts.agg(top_values(F.col("_k"), shown).alias("keys")), "transition")


def profile_complete(labels: DataFrame, cases: int, profile: Profile) -> DataFrame:
    """One row: whether the eligible labels reach the profile, with the conditions. labels: category, transition, real_world_eligible.

    Every category must reach its target, as many different transitions as labels asked for must be there, cases must be enough,
    and where the profile wants it no transition may serve two labels.
    """
    ok = labels.where(F.coalesce("real_world_eligible", F.lit(True)))
    a = audit_counts(labels, profile).where("kind = 'category'").agg(F.coalesce(F.sum("deficit"), F.lit(0)).alias("missing"))
    uses = ok.groupBy("transition").agg(F.count(F.lit(1)).alias("n"))
    t = uses.agg(F.count("transition").alias("independent"), F.count_if((F.col("n") > 1) & F.col("transition").isNotNull()).alias("reused"))
    row = a.withColumn("_k", F.lit(0)).join(t.withColumn("_k", F.lit(0)), "_k").drop("_k")
    row = row.withColumn("case_deficit", F.lit(max(0, profile.min_cases - cases)).cast("long"))
    unique_ok = (F.col("reused") == 0) | F.lit(not profile.unique_transitions)
    return row.withColumn("profile_complete", (F.col("missing") == 0) & (F.col("independent") >= sum(profile.targets.values())) & (F.col("case_deficit") == 0) & unique_ok)
