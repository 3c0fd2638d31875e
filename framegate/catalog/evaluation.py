"""Labels against observations, reviews, audits and checks of rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.catalog.selection import CASES, LABELS, VIDEOS
from framegate.config import CATEGORIES, CLAIM180, RISKS
from framegate.functions import geometry
from framegate.functions.text import state_key
from framegate.operators import checks, match, metrics
from framegate.operators.versions import latest
from framegate.plans.durable import durable
from framegate.sources import logs
from framegate.sources.streams import case_videos, labels, observations, videos
from framegate.sources.tables import table

_LABEL = ("start_s", "end_s", "acceptable_states")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder, *_LABEL).join(case_videos(spark, folder), "case_id")
    return rows.where("not isnan(start_s) and not isnan(end_s)").select("label_id", "case_id", "event_id", "video_path", "start_s", "end_s", "tolerance", "category", "risk", "acceptable_states")


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder, "reason", "timestamp_s", "peak_timestamp", "discovery", "change_fraction", "expected_result")


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    return match.best_match(durable(_known(spark, folder)), _observed(spark, folder), "video_path")  # labels reach for slices, and take what they got


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Matches with a rule in the place of an interpreter: the state is the event's discovery, and a change of a tenth of the frame confirms."""
    seen = durable(_observed(spark, folder))
    o = seen.select("video_path", F.col("sequence_no").alias("matched_sequence"), F.col("discovery").alias("state"), F.when(F.col("change_fraction") >= 0.1, "confirmed").otherwise("not_confirmed").alias("verification"))
    matched = match.best_match(durable(_known(spark, folder)), seen, "video_path")
    return match.judged(matched.join(o, ["video_path", "matched_sequence"], "left"), "state", "verification")


def best_match(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select("label_id", "triggered", "matched_sequence", "matched_reason", "matched_role", F.round("distance", 6).alias("distance"))


def _of_labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The observations of videos that have labels, and the labels' matches among them."""
    known = durable(_known(spark, folder))
    seen = durable(_observed(spark, folder).join(known.select("video_path").distinct(), "video_path", "left_semi"))
    return seen, durable(match.best_match(known, seen, "video_path"))


def false_calls(spark: SparkSession, folder: str) -> DataFrame:
    return match.false_calls(*_of_labelled(spark, folder), ["video_path"]).select("video_path", "sequence_no", "reason")


def observation_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = match.score_observations(*_of_labelled(spark, folder), ["video_path"], videos(spark, folder).select("video_path", "duration_seconds"), ["video_path"])
    return out.select(*out.columns[:5], F.round("false_calls_per_minute", 6).alias("false_calls_per_minute"), F.round("calls_per_minute", 6).alias("calls_per_minute"))


_COUNTS = ("labeled_events", "triggered_events", "exact_state_events", "exact_state_correct", "verification_events", "verification_correct", "automatic_false_confirmations")
_RATES = {"trigger_recall": ("triggered_events", "labeled_events"), "exact_state_accuracy": ("exact_state_correct", "exact_state_events"), "verification_accuracy": ("verification_correct", "verification_events")}


def _flat(df: DataFrame, by: list[str]) -> DataFrame:
    rates = [F.round(c, 6).alias(c) for c in _RATES]
    ends = [F.round(F.col(f"{c}_ci95")[i], 6).alias(f"{c}_{n}") for c in _RATES for i, n in enumerate(("low", "high"))]
    return df.select(*by, *_COUNTS, *rates, *ends)


def method_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(match.score_labels(_judged(spark, folder).withColumn("method", F.lit("gate")), ["method"]), ["method"])


def category_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(match.score_labels(_judged(spark, folder), ["category"]), ["category"])


def case_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(match.score_labels(_judged(spark, folder), ["case_id"]), ["case_id"])


def review_sheet(spark: SparkSession, folder: str) -> DataFrame:
    rows = match.review_rows(_matched(spark, folder), "gate")
    return rows.select("case_id", "event_id", "method", "triggered", "matched_sequence", "category", "risk", "observation_file", "false_confirmation")


def review_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews made by rule from the label's number: most given, some left open."""
    m = _matched(spark, folder)
    given = lambda k, yes: F.when(F.col("label_id") % k != 0, F.col("label_id") % yes != 1)
    reviews = m.select("label_id", given(11, 3).alias("evidence_visible"), given(13, 4).alias("semantic_correct"), given(17, 5).alias("task_state_correct"), given(7, 6).alias("false_confirmation"))
    out = match.score_reviews(m, reviews, ["label_id"], ["category"])
    counts = ["events", *[f"{v}_{k}" for v in (*match.VERDICTS, "end_to_end") for k in ("reviewed", "passed")], "action_failure_events", "false_confirmation_reviewed", "false_confirmations"]
    return out.select("category", *counts, F.round("end_to_end_review_coverage", 6).alias("end_to_end_review_coverage"), F.round("false_confirmation_rate", 6).alias("false_confirmation_rate"), "review_complete")


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.audit_counts(labels(spark, folder), CLAIM180)


def audit_marks(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.audit_marks(labels(spark, folder, "region", "acceptable_states"))


def duplicate_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.duplicate_transitions(labels(spark, folder), F.col("transition"), F.col("label_id")).select("transition", "labels", F.col("key").alias("label_id"))


def profile_complete(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder)
    cases = table(spark, folder, "evaluation_cases").select("case_id").distinct().count()
    return metrics.profile_complete(rows, cases, CLAIM180)


def state_names(spark: SparkSession, folder: str) -> DataFrame:
    each = labels(spark, folder, "acceptable_states").select("label_id", F.posexplode("acceptable_states").alias("pos", "state"))
    return each.select("label_id", F.col("pos").cast("long").alias("pos"), state_key(F.col("state")).alias("state"))


def label_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return labels(spark, folder).select("label_id", "category", "risk", "tolerance", "real_world_eligible", "transition")


def label_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that labels break as they were delivered, before spellings and defaults are put right."""
    keep = ["case_id", "event_id", "start_s", "end_s", "tolerance", "category", "risk", "region", "before_timestamp", "after_timestamp", "action_text", "expected_result"]
    rows = latest(table(spark, folder, "labeled_events").where("label_id is not null"), ["label_id"], "ingested_at", keep)
    return checks.violations(rows, "label_id", checks.label_rules())


def region_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Per video and frame size the smallest region that holds all of its regions."""
    rows = observations(spark, folder, "region").where("region is not null")
    out = rows.groupBy("video_path", F.col("region.frame_width").alias("fw"), F.col("region.frame_height").alias("fh")).agg(geometry.merged(F.col("region")).alias("r"))
    out = out.withColumn("wide", geometry.expanded(F.col("r"), 12))
    return out.select("video_path", "r.*", F.round(geometry.area_ratio(F.col("wide")), 6).alias("expanded_ratio"))


def region_pixels(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder, "region").where("region is not null").join(case_videos(spark, folder), "case_id").join(videos(spark, folder), "video_path")
    return rows.select("label_id", geometry.in_pixels(F.col("region"), F.col("width"), F.col("height")).alias("r")).where("r is not null").select("label_id", "r.x", "r.y", "r.width", "r.height")


def image_roles(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder, "reason", "region", "peak_timestamp").join(videos(spark, folder).where("width > 0 and height > 0"), "video_path")
    has_peak = F.col("peak_timestamp").isNotNull() & ~F.isnan("peak_timestamp")
    sized = F.when(F.col("region").isNotNull() & (F.col("region.frame_width") > 0), F.col("region"))
    w, h = F.coalesce(sized["frame_width"], F.col("width")), F.coalesce(sized["frame_height"], F.col("height"))
    images = geometry.images(sized, w, h, F.col("reason") == "action_verification", has_peak)
    each = rows.select("video_path", "sequence_no", F.posexplode(images).alias("pos", "i"))
    return each.select("video_path", "sequence_no", F.col("pos").cast("long").alias("pos"), "i.role", "i.width", "i.height", "i.patches")


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Run logs made from the events of a user (one line each), parsed for the last valid usage."""
    e = table(spark, folder, "events")
    valid = F.col("event_type") != "error"
    line = F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), F.col("event_id").cast("string"), F.when(valid, ',"output_tokens":7').otherwise(""), F.lit("}}"))
    text = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    out = logs.last_usage(text, "user_id", "log")
    return out.select("user_id", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


QUERIES = {f.__name__: f for f in (
    best_match, false_calls, observation_scores, method_totals, category_scores, case_scores, review_sheet, review_scores, audit_counts, audit_marks, duplicate_transitions, profile_complete,
    state_names, label_defaults, label_violations, region_merge, region_pixels, image_roles, usage_totals,
)}

_OBSERVED = """SELECT * REPLACE (lower(trim(reason)) AS reason, CASE WHEN NOT isnan(timestamp_s) THEN timestamp_s END AS timestamp_s, CASE WHEN NOT isnan(peak_timestamp) THEN peak_timestamp END AS peak_timestamp)
 FROM perception_events QUALIFY row_number() OVER (PARTITION BY video_path, sequence_no ORDER BY ingested_at DESC) = 1"""
_M = f"""WITH l AS (SELECT * FROM ({LABELS}) JOIN ({CASES}) USING (case_id) WHERE NOT isnan(start_s) AND NOT isnan(end_s)), o AS ({_OBSERVED}),
t AS (SELECT *, timestamp_s AS t, 0 AS role FROM o WHERE timestamp_s IS NOT NULL UNION ALL SELECT *, peak_timestamp, 1 FROM o WHERE peak_timestamp IS NOT NULL),
d AS (SELECT l.label_id, t.*, round(greatest(l.start_s - t.t, t.t - l.end_s, 0.0), 9) AS dist FROM l JOIN t ON t.video_path = l.video_path AND (t.reason = 'action_verification') = (l.category IN ('action_success', 'action_failure'))
 WHERE round(greatest(l.start_s - t.t, t.t - l.end_s, 0.0), 9) <= l.tolerance QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY dist, sequence_no, role) = 1),
m AS (SELECT l.*, d.label_id IS NOT NULL AS triggered, d.sequence_no AS matched_sequence, d.reason AS matched_reason, CASE d.role WHEN 0 THEN 'current' WHEN 1 THEN 'change_peak' END AS matched_role, d.dist AS distance,
 d.discovery AS state, CASE WHEN d.change_fraction >= 0.1 THEN 'confirmed' WHEN d.label_id IS NOT NULL THEN 'not_confirmed' END AS verification FROM l LEFT JOIN d USING (label_id)),
q AS (SELECT o.*, u.video_path IS NULL AS free FROM (SELECT * FROM o SEMI JOIN l USING (video_path)) o LEFT JOIN (SELECT DISTINCT video_path, matched_sequence FROM m WHERE triggered) u ON u.video_path = o.video_path AND u.matched_sequence = o.sequence_no),
j AS (SELECT *, CASE WHEN len(acceptable_states) > 0 THEN coalesce(list_contains(list_transform(acceptable_states, lambda s: regexp_replace(replace(lower(trim(s)), '-', '_'), '\\s+', '_', 'g')), state), false) END AS exact_ok,
 CASE category WHEN 'action_success' THEN coalesce(verification = 'confirmed', false) WHEN 'action_failure' THEN coalesce(verification = 'not_confirmed', false) END AS ver_ok, coalesce(category = 'action_failure' AND verification = 'confirmed', false) AS fc FROM m)
"""
_Z = "1.959963984540054"


def _wilson_sql(k: str, n: str) -> str:
    z2 = f"({_Z} * {_Z})"
    mid, half = f"(({k} / {n}) + {z2} / (2 * {n})) / (1 + {z2} / {n})", f"{_Z} * sqrt(greatest(0, ({k} / {n}) * (1 - {k} / {n}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {mid} - {half}), 6) END, CASE WHEN {n} > 0 THEN round(least(1.0, {mid} + {half}), 6) END"


def _scores_sql(by: str) -> str:
    rates = ", ".join(f"CASE WHEN {n} > 0 THEN round({k} / {n}, 6) END AS {c}" for c, (k, n) in _RATES.items())
    ends = ", ".join(e + f" AS {c}_{x}" for c, (k, n) in _RATES.items() for e, x in zip(_wilson_sql(k, n).split(", CASE WHEN", 1) and ["CASE WHEN" + p if i else p for i, p in enumerate(_wilson_sql(k, n).split(", CASE WHEN", 1))], ("low", "high")))
    return _M + f"""SELECT *, {rates}, {ends} FROM (SELECT {by}, count(*) AS labeled_events, count(*) FILTER (triggered) AS triggered_events, count(exact_ok) AS exact_state_events, count(*) FILTER (exact_ok) AS exact_state_correct,
 count(ver_ok) AS verification_events, count(*) FILTER (ver_ok) AS verification_correct, count(*) FILTER (fc) AS automatic_false_confirmations FROM j GROUP BY 1)"""


def _review_sql() -> str:
    marks = {"evidence_visible": (11, 3), "semantic_correct": (13, 4), "task_state_correct": (17, 5)}
    given = {v: f"label_id % {k} <> 0" for v, (k, _) in marks.items()}
    good = {v: f"(label_id % {k} <> 0 AND label_id % {y} <> 1)" for v, (k, y) in marks.items()}
    parts = ", ".join(f"count(*) FILTER (NOT triggered OR {given[v]}) AS {v}_reviewed, count(*) FILTER (triggered AND {good[v]}) AS {v}_passed" for v in marks)
    whole = ", ".join(f"{v}_reviewed" for v in marks)
    return _M + f"""SELECT *, round(end_to_end_reviewed / events, 6) AS end_to_end_review_coverage, CASE WHEN action_failure_events > 0 AND false_confirmation_reviewed = action_failure_events THEN round(false_confirmations / action_failure_events, 6) END AS false_confirmation_rate,
 least({whole}, end_to_end_reviewed) = events AND false_confirmation_reviewed = action_failure_events AS review_complete FROM (SELECT category, count(*) AS events, {parts},
 count(*) FILTER (NOT triggered OR ({" AND ".join(given.values())})) AS end_to_end_reviewed, count(*) FILTER (triggered AND {" AND ".join(good.values())}) AS end_to_end_passed, count(*) FILTER (category = 'action_failure') AS action_failure_events,
 count(*) FILTER (category = 'action_failure' AND (NOT triggered OR label_id % 7 <> 0)) AS false_confirmation_reviewed, count(*) FILTER (category = 'action_failure' AND triggered AND label_id % 7 <> 0 AND label_id % 6 <> 1) AS false_confirmations FROM m GROUP BY category)"""


_TARGETS = ", ".join(f"('category', '{c}', {CLAIM180.targets.get(c, 0)})" for c in CATEGORIES) + ", " + ", ".join(f"('risk', '{r}', NULL)" for r in RISKS)
_AUDIT = f"""SELECT kind, name, count(c.kind2) AS labels, count(*) FILTER (c.real_world_eligible) AS eligible, target, CASE WHEN kind = 'category' THEN greatest(0, target - count(*) FILTER (c.real_world_eligible)) END AS deficit
 FROM (SELECT kind, name, target::BIGINT AS target FROM (VALUES {_TARGETS}) v(kind, name, target)) w LEFT JOIN (SELECT 'category' AS kind2, category AS name2, real_world_eligible FROM ({LABELS}) UNION ALL SELECT 'risk', risk, real_world_eligible FROM ({LABELS})) c ON kind = kind2 AND name = name2 GROUP BY kind, name, target"""
_DUPLICATES = f"SELECT * FROM (SELECT transition, count(*) OVER (PARTITION BY transition) AS labels, label_id FROM ({LABELS}) WHERE transition IS NOT NULL) WHERE labels > 1"
_BOX = f"""SELECT *, greatest(0, x - 12) AS ex, greatest(0, y - 12) AS ey, least(frame_width, x + width + 12) - greatest(0, x - 12) AS ew, least(frame_height, y + height + 12) - greatest(0, y - 12) AS eh"""


def _image(role: str, w: str, h: str, most: int) -> str:
    a, b = f"least({w}, {most})::BIGINT", f"(CASE WHEN {w} > {most} THEN greatest(1, CAST(round_even({h} * {most} / {w}, 0) AS BIGINT)) ELSE {h} END)::BIGINT"
    return f"{{'role': '{role}', 'width': {a}, 'height': {b}, 'patches': (ceil({a} / 32) * ceil({b} / 32))::BIGINT}}"


_WHOLE, _CUT = ("fw", "fh"), ("cw", "ch")
SQL = {
    "best_match": _M + "SELECT label_id, triggered, matched_sequence, matched_reason, matched_role, round(distance, 6) AS distance FROM m",
    "false_calls": _M + "SELECT video_path, sequence_no, reason FROM q WHERE free",
    "observation_scores": _M + f"""SELECT * EXCLUDE (minutes), CASE WHEN minutes > 0 THEN round(false_observations / minutes, 6) ELSE 0 END AS false_calls_per_minute, CASE WHEN minutes > 0 THEN round(observations / minutes, 6) ELSE 0 END AS calls_per_minute
 FROM (SELECT q.video_path, count(*) AS observations, count(*) FILTER (free) AS false_observations, count(*) FILTER (free AND reason = 'initial') AS unmatched_initial_observations, count(*) FILTER (free AND reason IS DISTINCT FROM 'initial') AS unmatched_non_initial_observations,
 coalesce(max(v.duration_seconds) / 60, 0) AS minutes FROM q LEFT JOIN ({VIDEOS}) v ON v.video_path = q.video_path GROUP BY q.video_path)""",
    "method_totals": _scores_sql("'gate' AS method"),
    "category_scores": _scores_sql("category"),
    "case_scores": _scores_sql("case_id"),
    "review_sheet": _M + "SELECT case_id, event_id, 'gate' AS method, triggered, matched_sequence, category, risk, 'cases/' || case_id || '/gate/observations.json' AS observation_file, CASE WHEN category <> 'action_failure' THEN false END AS false_confirmation FROM m",
    "review_scores": _review_sql(),
    "audit_counts": _AUDIT,
    "audit_marks": f"""SELECT count(*) AS labels, count(region) AS with_region, count(*) FILTER (len(acceptable_states) > 0) AS with_states, count(*) FILTER (region IS NOT NULL AND len(acceptable_states) > 0) AS with_both,
 count(DISTINCT transition) FILTER (real_world_eligible) AS independent_transitions FROM ({LABELS})""",
    "duplicate_transitions": _DUPLICATES,
    "profile_complete": f"""SELECT *, missing = 0 AND independent >= 180 AND case_deficit = 0 AND reused = 0 AS profile_complete FROM (SELECT (SELECT coalesce(sum(deficit), 0)::BIGINT FROM ({_AUDIT}) WHERE kind = 'category') AS missing,
 (SELECT count(DISTINCT transition) FROM ({LABELS}) WHERE real_world_eligible) AS independent, (SELECT count(*) FROM (SELECT transition FROM ({LABELS}) WHERE real_world_eligible AND transition IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS reused,
 (SELECT greatest(0, 30 - count(DISTINCT case_id)) FROM evaluation_cases) AS case_deficit)""",
    "state_names": f"SELECT label_id, pos - 1 AS pos, regexp_replace(replace(lower(trim(acceptable_states[pos])), '-', '_'), '\\s+', '_', 'g') AS state FROM (SELECT label_id, acceptable_states, unnest(range(1, len(acceptable_states) + 1)) AS pos FROM ({LABELS}))",
    "label_defaults": f"SELECT label_id, category, risk, tolerance, real_world_eligible, transition FROM ({LABELS})",
    "label_violations": checks.LABEL_SQL.format(labels="SELECT * FROM labeled_events QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY ingested_at DESC) = 1"),
    "region_merge": f"""WITH g AS (SELECT video_path, min(region.x) AS x, min(region.y) AS y, max(region.x + region.width) - min(region.x) AS width, max(region.y + region.height) - min(region.y) AS height, region.frame_width AS frame_width, region.frame_height AS frame_height
 FROM ({_OBSERVED}) WHERE region IS NOT NULL GROUP BY video_path, region.frame_width, region.frame_height) SELECT * EXCLUDE (ex, ey, ew, eh), CASE WHEN frame_width * frame_height > 0 THEN round(ew * eh / (frame_width * frame_height), 6) ELSE 0 END AS expanded_ratio FROM ({_BOX} FROM g)""",
    "region_pixels": f"""SELECT label_id, x, y, greatest(1, x2 - x) AS width, greatest(1, y2 - y) AS height FROM (SELECT label_id, least(width - 1, floor(region.x * width))::INTEGER AS x, least(height - 1, floor(region.y * height))::INTEGER AS y, least(width, ceil((region.x + region.width) * width))::INTEGER AS x2,
 least(height, ceil((region.y + region.height) * height))::INTEGER AS y2 FROM ({LABELS}) JOIN ({CASES}) USING (case_id) JOIN ({VIDEOS}) USING (video_path) WHERE region.x >= 0 AND region.y >= 0 AND region.width > 0 AND region.height > 0 AND region.x + region.width <= 1 + 1e-9 AND region.y + region.height <= 1 + 1e-9)""",
    "image_roles": f"""WITH r AS (SELECT o.video_path, sequence_no, reason = 'action_verification' AS has_before, peak_timestamp IS NOT NULL AS has_peak, CASE WHEN region.frame_width > 0 THEN region END AS g, coalesce(CASE WHEN region.frame_width > 0 THEN region.frame_width END, v.width) AS fw,
 coalesce(CASE WHEN region.frame_width > 0 THEN region.frame_height END, v.height) AS fh FROM ({_OBSERVED}) o JOIN ({VIDEOS}) v ON v.video_path = o.video_path WHERE v.width > 0 AND v.height > 0),
b AS ({_BOX.replace("*,", "r.*, g.x AS x, g.y AS y, g.width AS width, g.height AS height, g.frame_width AS frame_width, g.frame_height AS frame_height,")} FROM r),
e AS (SELECT *, g IS NOT NULL AND ew * eh / (frame_width * frame_height) >= 0.60 AS fills FROM b), c AS (SELECT *, CASE WHEN fills OR g IS NULL THEN fw ELSE ew END AS cw, CASE WHEN fills OR g IS NULL THEN fh ELSE eh END AS ch FROM e),
i AS (SELECT video_path, sequence_no, list_concat(list_concat(CASE WHEN has_before THEN [{_image("before_action", *_CUT, 768)}] ELSE [] END, CASE WHEN g IS NULL THEN [{_image("context", *_WHOLE, 768)}] WHEN fills THEN [{_image("detail", *_WHOLE, 768)}]
 ELSE [{_image("context", *_WHOLE, 384)}, {_image("detail", *_CUT, 768)}] END), CASE WHEN has_peak AND g IS NOT NULL THEN [{_image("change_peak", *_CUT, 768)}] ELSE [] END) AS images FROM c),
u AS (SELECT video_path, sequence_no, images, unnest(range(1, len(images) + 1)) AS p FROM i) SELECT video_path, sequence_no, p - 1 AS pos, images[p].role AS role, images[p].width AS width, images[p].height AS height, images[p].patches AS patches FROM u""",
    "usage_totals": "SELECT user_id, max(event_id) AS input_tokens, 7::BIGINT AS output_tokens, max(event_id) + 7 AS total_tokens FROM events WHERE event_type <> 'error' GROUP BY user_id",
}
