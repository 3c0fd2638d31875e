"""Labels against observations: matches, scores and human reviews."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.functions.stats import rate, wilson
from framegate.functions.text import state_key
from framegate.operators.metrics import interval_distance

ACTIONS = ("action_success", "action_failure")
VERDICTS = ("evidence_visible", "semantic_correct", "task_state_correct")


def is_action(category: Column) -> Column:
    return F.coalesce(category.isin(*ACTIONS), F.lit(False))


def best_match(labels: DataFrame, observations: DataFrame, entity: str, slice_seconds: float = 64.0) -> DataFrame:
    """The observation nearest to each label's interval within its tolerance; labels without one keep nulls.

    labels: label_id, entity, start_s, end_s, tolerance, category. observations: entity, sequence_no, timestamp_s, reason,
    peak_timestamp (null or NaN: no image of the peak). Labels of action categories match action verifications only, others never. An observation stands
    for its own time and for its peak; the nearer counts, then the smaller sequence number, then its own time.

    Labels are copied to the slices of time that they reach, observations lie in one; the join is by (entity, class, slice), and the
    best per label is a minimum of narrow structs, taken before the shuffle.
    """
    cut = lambda c: F.floor(c / slice_seconds)
    reach = labels.select(entity, "label_id", "start_s", "end_s", "tolerance", is_action(F.col("category")).alias("_action"))
    reach = reach.withColumn("_slice", F.explode(F.sequence(cut(F.col("start_s") - F.col("tolerance")), cut(F.col("end_s") + F.col("tolerance")))))
    peak = F.when(~F.isnan("peak_timestamp"), F.col("peak_timestamp"))
    times = observations.select(
        entity, "sequence_no", "timestamp_s", "reason", (F.col("reason") == "action_verification").alias("_action"), F.posexplode(F.array(F.col("timestamp_s"), peak)).alias("_role", "_t")
    ).where("_t is not null and not isnan(_t)").withColumn("_slice", cut(F.col("_t")))
    near = reach.join(times, [entity, "_action", "_slice"])
    near = near.withColumn("_d", F.round(interval_distance(F.col("_t"), F.col("start_s"), F.col("end_s")), 9)).where("_d <= tolerance")
    best = near.groupBy("label_id").agg(F.min(F.struct("_d", "sequence_no", "_role", "reason", "timestamp_s", "_t")).alias("_m"))
    joined = labels.join(best, "label_id", "left")
    role = F.when(F.col("_m._role") == 0, "current").when(F.col("_m._role") == 1, "change_peak")
    return joined.select(
        *labels.columns, F.col("_m").isNotNull().alias("triggered"), F.col("_m.sequence_no").alias("matched_sequence"), F.col("_m.reason").alias("matched_reason"),
        F.col("_m.timestamp_s").alias("matched_timestamp"), role.alias("matched_role"), F.col("_m._t").alias("matched_role_timestamp"), F.col("_m._d").alias("distance"),
    )


def false_calls(observations: DataFrame, matches: DataFrame, keys: list[str], sequence: str = "sequence_no") -> DataFrame:
    """The observations that no label matched."""
    used = matches.where("triggered").select(*keys, F.col("matched_sequence").alias(sequence)).distinct()
    return observations.join(used, [*keys, sequence], "left_anti")


def judged(matches: DataFrame, state: str, verification: str) -> DataFrame:
    """matches with what the interpretation got right: exact_state_correct, expected_verification, verification_correct, false_confirmation; null where nothing is asked."""
    wanted = F.transform(F.coalesce("acceptable_states", F.array().cast("array<string>")), lambda s: state_key(s))
    exact = F.when(F.size(wanted) > 0, F.coalesce(F.array_contains(wanted, state_key(F.col(state))), F.lit(False)))
    expected = F.when(F.col("category") == "action_success", "confirmed").when(F.col("category") == "action_failure", "not_confirmed")
    got = F.col(verification)
    return matches.withColumns({
        "exact_state_correct": exact, "expected_verification": expected, "verification_correct": F.when(expected.isNotNull(), F.coalesce(got == expected, F.lit(False))),
        "false_confirmation": F.when(F.col("category") == "action_failure", F.coalesce(got == "confirmed", F.lit(False))),
    })


def _share(name: str, n: str, d: str, empty: float | None) -> dict[str, Column]:
    return {name: rate(F.col(n), F.col(d), empty), f"{name}_ci95": wilson(F.col(n), F.col(d))}


def score_labels(matches: DataFrame, by: list[str]) -> DataFrame:
    """Per group the labels, what triggered, and what judged() found, with rates and 95 % intervals."""
    out = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("labeled_events"), F.count_if("triggered").alias("triggered_events"),
        F.count("exact_state_correct").alias("exact_state_events"), F.count_if("exact_state_correct").alias("exact_state_correct"),
        F.count("verification_correct").alias("verification_events"), F.count_if("verification_correct").alias("verification_correct"),
        F.count_if("false_confirmation").alias("automatic_false_confirmations"),
    )
    return out.withColumns({
        **_share("trigger_recall", "triggered_events", "labeled_events", 1.0), **_share("exact_state_accuracy", "exact_state_correct", "exact_state_events", None),
        **_share("verification_accuracy", "verification_correct", "verification_events", None),
    })


def score_observations(observations: DataFrame, matches: DataFrame, keys: list[str], durations: DataFrame, by: list[str], sequence: str = "sequence_no") -> DataFrame:
    """Per group the observations and those that no label matched, in all and per minute; durations: by + duration_seconds."""
    used = matches.where("triggered").select(*keys, F.col("matched_sequence").alias(sequence), F.lit(True).alias("_used")).distinct()
    rows = observations.join(used, [*keys, sequence], "left").withColumn("_free", F.col("_used").isNull())
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.count_if("_free").alias("false_observations"),
        F.count_if(F.col("_free") & (F.col("reason") == "initial")).alias("unmatched_initial_observations"),
    )
    out = counts.join(durations, by, "left").withColumn("_m", F.coalesce(F.col("duration_seconds") / 60, F.lit(0.0)))
    return out.select(
        *by, "observations", "false_observations", "unmatched_initial_observations", (F.col("false_observations") - F.col("unmatched_initial_observations")).alias("unmatched_non_initial_observations"),
        F.when(F.col("_m") > 0, F.col("false_observations") / F.col("_m")).otherwise(0.0).alias("false_calls_per_minute"), F.when(F.col("_m") > 0, F.col("observations") / F.col("_m")).otherwise(0.0).alias("calls_per_minute"),
    )


def review_rows(matches: DataFrame, method: str, case: str = "case_id", event: str = "event_id") -> DataFrame:
    """The review sheet: one row per label, verdicts open; a false confirmation is only asked of failed actions."""
    return matches.select(
        case, event, F.lit(method).alias("method"), "triggered", "matched_sequence", F.array("start_s", "end_s").alias("label_time_range"), "category", "risk",
        F.concat(F.lit("cases/"), F.col(case), F.lit(f"/{method}/observations.json")).alias("observation_file"),
        *[F.lit(None).cast("boolean").alias(v) for v in VERDICTS], F.when(F.col("category") != "action_failure", F.lit(False)).alias("false_confirmation"), F.lit("").alias("review_notes"),
    )


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df as it is; an error when it is read if a key repeats."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in df.columns if c not in keys])).alias("_r"))
    checked = counted.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.concat_ws("/", *keys))).cast("boolean")).otherwise(True))
    return checked.select(*keys, *[F.col("_r")[c].alias(c) for c in df.columns if c not in keys])


def score_reviews(matches: DataFrame, reviews: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Counts and rates of human reviews per group. matches: keys, by, triggered, category. reviews: keys, the three verdicts, false_confirmation.

    A label that nothing triggered counts as reviewed and failed. End to end needs all three verdicts. A rate is null until every
    label of the group is reviewed; the rate of false confirmations is over all failed actions.
    """
    rows = matches.join(require_unique(reviews.select(*keys, *VERDICTS, "false_confirmation"), keys, "review row"), keys, "left")
    hit, failed_action = F.col("triggered"), F.col("category") == "action_failure"
    each = {}
    for v in VERDICTS:
        each[f"{v}_reviewed"], each[f"{v}_passed"] = F.count_if(~hit | F.col(v).isNotNull()), F.count_if(hit & F.col(v))
    all_given = F.col(VERDICTS[0]).isNotNull() & F.col(VERDICTS[1]).isNotNull() & F.col(VERDICTS[2]).isNotNull()
    each["end_to_end_reviewed"] = F.count_if(~hit | all_given)
    each["end_to_end_passed"] = F.count_if(hit & F.col(VERDICTS[0]) & F.col(VERDICTS[1]) & F.col(VERDICTS[2]))
    each["action_failure_events"] = F.count_if(failed_action)
    each["false_confirmation_reviewed"] = F.count_if(failed_action & (~hit | F.col("false_confirmation").isNotNull()))
    each["false_confirmations"] = F.count_if(failed_action & hit & F.col("false_confirmation"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *[c.alias(k) for k, c in each.items()])
    n, failures = F.col("events"), F.col("action_failure_events")
    done = {}
    for v in (*VERDICTS, "end_to_end"):
        full = F.col(f"{v}_reviewed") == n
        done[f"{v}_review_coverage"] = rate(F.col(f"{v}_reviewed"), n, 1.0)
        done["end_to_end_success_rate" if v == "end_to_end" else f"{v}_rate"] = F.when(full, rate(F.col(f"{v}_passed"), n))
    full = F.col("false_confirmation_reviewed") == failures
    done["false_confirmation_review_coverage"] = rate(F.col("false_confirmation_reviewed"), failures, 1.0)
    done["false_confirmation_rate"] = F.when((failures > 0) & full, F.col("false_confirmations") / failures)
    done["false_confirmation_rate_ci95"] = F.when(full, wilson(F.col("false_confirmations"), failures))
    complete = full
    for v in (*VERDICTS, "end_to_end"):
        complete = complete & (F.col(f"{v}_reviewed") == n)
    return out.withColumns({**done, "review_complete": complete})
