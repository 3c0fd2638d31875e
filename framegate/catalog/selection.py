"""Schedules, signals, importance and selection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.config import Sampler
from framegate.operators import metrics, select, signals
from framegate.plans.durable import durable
from framegate.sources.streams import SIGNALS, candidates, case_videos, labels, stream, videos
from framegate.sources.tables import table

BUDGET = 6
#: Settings for the event stream, whose times are in seconds over days and whose value stands for the look of a frame.
GREEDY = dict(budget=BUDGET, min_distance_seconds=864000.0, duplicate_threshold=0.09, coverage_fraction=0.25)


def video_probe(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.coalesce((F.col("fps") <= 0) | F.isnan("fps") | (F.col("frame_count") <= 0) | (F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True))
    return videos(spark, folder).select("video_path", "frame_count", F.round("duration_seconds", 6).alias("duration_seconds"), (~bad).alias("usable"))


def candidate_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Which scored candidates lie on their video's schedule; a test per row, since a live camera has no last frame to list up to."""
    v = videos(spark, folder).where("fps > 0 and not isnan(fps) and frame_count > 0").withColumn("step", signals.schedule_step(F.col("fps"), 4.0))
    rows = candidates(spark, folder).join(v, "video_path")
    return rows.select("video_path", "frame_index", "step", signals.scheduled(F.col("frame_index"), F.col("frame_count"), F.col("step")).alias("scheduled"))


def source_intervals(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder, "timestamp_s", "discovery").join(videos(spark, folder).where("fps > 0 and not isnan(fps)"), "video_path")
    half = F.when(F.col("discovery") == "spike_guard", 0.5 / F.col("fps")).otherwise(0.5 / 4.0)
    i = signals.source_interval(F.col("timestamp_s"), F.col("duration_seconds"), half)
    rows = rows.withColumn("_i", i)
    return rows.select("video_path", "frame_index", F.round("_i.source_start", 6).alias("source_start"), F.round("_i.source_end", 6).alias("source_end"))


def label_frames(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder, "start_s").join(case_videos(spark, folder), "case_id").join(videos(spark, folder).where("fps > 0 and not isnan(fps) and frame_count > 0"), "video_path")
    return rows.where("not isnan(start_s)").select("label_id", signals.frame_at(F.col("start_s"), F.col("fps"), F.col("frame_count")).alias("frame_index"))


def lag_difference(spark: SparkSession, folder: str) -> DataFrame:
    d = F.abs(F.col("value") - F.col("previous_value"))
    return _stepped(spark, folder).select("media_id", "frame_index", F.round(F.coalesce(d, F.lit(0.0)), 6).alias("difference"))


def _stepped(spark: SparkSession, folder: str) -> DataFrame:
    return signals.stepped(stream(spark, folder), ["value"])


def histogram_distance(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", F.to_date(F.col("ts").cast("timestamp")).alias("day"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    hist = counts.select("day", F.array(*[F.col(k) / F.col("n") for k in kinds]).alias("h"))
    pairs = hist.select(F.date_add("day", 1).alias("day"), F.col("h").alias("before")).join(hist, "day")
    return pairs.select(F.col("day").cast("string").alias("day"), F.round(signals.histogram_distance(F.col("before"), F.col("h")), 6).alias("distance"))


def _signatures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").alias("frame_index"), F.col("embedding").cast("array<double>").alias("signature"))
    return rows.withColumn("before", F.lag("signature").over(signals.in_order()))


def signature_distance(spark: SparkSession, folder: str) -> DataFrame:
    d = signals.signature_distance(F.col("signature"), F.col("before"), 1.0)
    return _signatures(spark, folder).where("before is not null").select("media_id", "frame_index", F.round(d, 6).alias("distance"))


def motion_fraction(spark: SparkSession, folder: str) -> DataFrame:
    share = signals.moved_share(F.col("signature"), F.col("before"), 0.1)
    return _signatures(spark, folder).where("before is not null").select("media_id", "frame_index", F.round(share, 6).alias("motion"))


def spike_promotion(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stepped(spark, folder).withColumn("difference", F.abs(F.col("value") - F.col("previous_value")))
    rows = rows.join(rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")), "media_id")
    rows = rows.withColumn("scheduled", signals.scheduled(F.col("frame_index"), F.col("n"), F.lit(3)))
    rows = signals.spikes(rows, "difference", 60.0, "scheduled")
    kept = rows.where("scheduled or spike")
    return kept.select("media_id", "frame_index", F.when(F.col("spike"), "spike_guard").otherwise("scheduled").alias("discovery"))


def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    scales = signals.robust_scales(durable(candidates(spark, folder, *SIGNALS)), SIGNALS, ["video_path"])
    return scales.select("video_path", *[F.round(f"{c}_p95", 9).alias(f"{c}_p95") for c in SIGNALS])


def _scored(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return signals.with_importance(candidates(spark, folder, *SIGNALS, *more), *SIGNALS, ["video_path"])


def importance(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("video_path", "frame_index", F.round("importance", 9).alias("importance"), "scene_change")


def importance_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).withColumn("importance", F.round("importance", 9))
    return select.ranked(rows, ["video_path"]).where(f"rank <= {BUDGET}").select("video_path", "frame_index", "importance", F.col("rank").cast("long").alias("rank"))


def importance_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.importance_summary(candidates(spark, folder, "importance"), ["video_path"])
    return out.select("video_path", "rows", *[F.round(f"importance_{k}", 9).alias(f"importance_{k}") for k in ("min", "max", "mean")])


def uniform_select(spark: SparkSession, folder: str) -> DataFrame:
    return select.uniform_select(candidates(spark, folder, "timestamp_s"), ["video_path"], BUDGET).select("video_path", "frame_index")


def equal_bin_centres(spark: SparkSession, folder: str) -> DataFrame:
    return select.equal_bin_centres(videos(spark, folder).select("video_path", "frame_count"), "frame_count", BUDGET).select("video_path", "frame_index")


def _greedy(strategy: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = stream(spark, folder).withColumn("importance", F.col("motion").cast("double"))
        return select.greedy_select(rows, "media_id", Sampler(strategy=strategy, **GREEDY), "value", 1000.0).select("media_id", "frame_index", F.col("step").cast("long").alias("step"))

    return query


def event_recall(spark: SparkSession, folder: str) -> DataFrame:
    known = labels(spark, folder, "start_s", "end_s").join(case_videos(spark, folder), "case_id").where("not isnan(start_s) and not isnan(end_s)")
    picked = select.uniform_select(candidates(spark, folder, "timestamp_s"), ["video_path"], BUDGET)
    out = metrics.event_recall(known, picked, ["category"], "label_id", "timestamp_s", "video_path")
    return out.select("category", "events", "recalled", F.round("recall", 6).alias("recall"))


def redundancy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").alias("frame_index"), F.col("embedding").cast("array<double>").alias("signature"))
    picked = select.uniform_select(rows, ["media_id"], 32)
    out = metrics.redundancy(picked, "media_id", "frame_index", lambda a, b: signals.signature_distance(F.col(f"{a}.signature"), F.col(f"{b}.signature"), 1.0), 0.12)
    return out.select("media_id", "selected", "redundant", F.round("redundancy", 6).alias("redundancy"))


def _coverage(spark: SparkSession, folder: str, method: str) -> DataFrame:
    rows = candidates(spark, folder, "timestamp_s", "importance")
    picked = select.uniform_select(rows, ["video_path"], BUDGET) if method == "uniform" else select.ranked(rows, ["video_path"]).where(f"rank <= {BUDGET}")
    timed = picked.join(videos(spark, folder).select("video_path", "duration_seconds"), "video_path").where("timestamp_s is not null and not isnan(timestamp_s)")
    return metrics.temporal_coverage(timed, ["video_path"], "timestamp_s", "duration_seconds", BUDGET).withColumn("method", F.lit(method))


def temporal_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _coverage(spark, folder, "uniform").select("video_path", "covered", "bins", F.round("coverage", 6).alias("coverage"))


def method_means(spark: SparkSession, folder: str) -> DataFrame:
    both = _coverage(spark, folder, "uniform").unionByName(_coverage(spark, folder, "importance"))
    out = both.groupBy("method").agg(F.count(F.lit(1)).alias("cases"), F.avg("coverage").alias("coverage"), F.avg("bins").alias("bins"))
    return out.select("method", "cases", F.round("coverage", 6).alias("coverage"), F.round("bins", 6).alias("bins"))


QUERIES = {f.__name__: f for f in (
    video_probe, candidate_schedule, source_intervals, label_frames, lag_difference, histogram_distance, signature_distance, motion_fraction, spike_promotion, robust_scale, importance,
    importance_topk, importance_summary, uniform_select, equal_bin_centres, event_recall, redundancy, temporal_coverage, method_means,
)} | {"score_only_select": _greedy("score_only"), "hybrid_select": _greedy("hybrid")}

STREAM = """SELECT user_id AS media_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS motion,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp_s FROM events"""
CANDIDATES = """SELECT video_path, frame_index, timestamp_s, discovery, CASE WHEN NOT isnan(frame_difference) THEN frame_difference END AS frame_difference, CASE WHEN NOT isnan(histogram_difference) THEN histogram_difference END AS histogram_difference,
 CASE WHEN NOT isnan(motion_score) THEN motion_score END AS motion_score, CASE WHEN NOT isnan(importance) THEN importance END AS importance FROM candidates QUALIFY row_number() OVER (PARTITION BY video_path, frame_index ORDER BY ingested_at DESC) = 1"""
VIDEOS = """SELECT *, CASE WHEN fps > 0 AND NOT isnan(fps) THEN coalesce(frame_count, 0) / fps ELSE 0 END AS duration_seconds FROM videos QUALIFY row_number() OVER (PARTITION BY video_path ORDER BY ingested_at DESC, fps DESC NULLS LAST, frame_count DESC NULLS LAST) = 1"""
KEY = "replace(replace(lower(trim({0}, ' ' || chr(9) || chr(10))), '-', '_'), ' ', '_')"
CASES = r"""SELECT case_id, max(regexp_replace(regexp_replace(regexp_replace(regexp_replace(video, '/\.(/|$)', '/', 'g'), '/+', '/', 'g'), '^\./', ''), '(^|/)[^/]+/\.\.(/|$)', '\1', 'g')) AS video_path
 FROM evaluation_cases WHERE case_id IS NOT NULL AND video IS NOT NULL GROUP BY case_id"""
LABELS = f"""SELECT * REPLACE (coalesce({KEY.format("category")}, 'other') AS category, coalesce({KEY.format("risk")}, 'normal') AS risk, coalesce(CASE WHEN NOT isnan(tolerance) THEN tolerance END, 0) AS tolerance, coalesce(real_world_eligible, true) AS real_world_eligible),
 coalesce(nullif(lower(trim(source_transition_id, ' ' || chr(9) || chr(10))), ''), concat_ws('/', case_id, event_id)) AS transition FROM labeled_events QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY ingested_at DESC) = 1"""
_P95 = "quantile_cont(CASE WHEN {0} > 0 THEN {0} END, 0.95)"
_SCALES = f"""SELECT video_path, {", ".join(f"CASE WHEN {_P95.format(c)} > 1e-12 THEN {_P95.format(c)} END AS {c}_p95" for c in SIGNALS)} FROM c GROUP BY video_path"""
_SCALED = "coalesce(least(1.5, greatest(0.0, {0} / {0}_p95)), 0.0)"
_SCORED = f"""WITH c AS ({CANDIDATES}), s AS ({_SCALES}),
i AS (SELECT c.video_path, frame_index, greatest(coalesce(frame_difference, 0), coalesce(histogram_difference, 0)) >= 0.45 AS scene_change,
 round({_SCALED.format("frame_difference")} * 0.45 + {_SCALED.format("histogram_difference")} * 0.20 + {_SCALED.format("motion_score")} * 0.35 + CASE WHEN greatest(coalesce(frame_difference, 0), coalesce(histogram_difference, 0)) >= 0.45 THEN 0.25 ELSE 0 END, 9) AS importance
 FROM c JOIN s USING (video_path))
"""


def _uniform(source: str, key: str, budget: int) -> str:
    return f"""SELECT * EXCLUDE (i, n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY frame_index) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM ({source}))
 WHERE n <= {budget} OR list_contains(list_transform(range(0, {budget}), lambda k: CAST(round_even(k * (n - 1) / {budget - 1}, 0) AS BIGINT)), i)"""


def _coverage_sql(picked: str) -> str:
    return f"""SELECT video_path, count(DISTINCT CASE WHEN duration_seconds > 0 THEN least(bins - 1, trunc(timestamp_s / duration_seconds * bins)::BIGINT) ELSE 0 END) AS covered, max(bins) AS bins
 FROM (SELECT p.*, v.duration_seconds, least({BUDGET}, greatest(1, count(*) OVER (PARTITION BY p.video_path))) AS bins FROM ({picked}) p JOIN ({VIDEOS}) v USING (video_path) WHERE NOT isnan(timestamp_s)) GROUP BY video_path"""


_TOP = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY importance DESC NULLS LAST, frame_index) AS r FROM ({CANDIDATES})) WHERE r <= {BUDGET}"


def _greedy_sql(hybrid: bool) -> str:
    """Passes as one ordered source per stream, taken by a recursion that carries what it has chosen."""
    g = GREEDY
    target = f"least({BUDGET}, n)"
    anchors = f"least({target}, greatest(1, CAST(round_even({target} * {g['coverage_fraction']}, 0) AS BIGINT)))"
    first = f"""SELECT media_id, n, frame_index, timestamp_s, value, 0 AS step, row_number() OVER (PARTITION BY media_id ORDER BY frame_index) AS rk FROM b
 WHERE list_contains(CASE WHEN {anchors} = 1 THEN [0] ELSE list_transform(range(0, {anchors}), lambda k: CAST(round_even(k * (n - 1) / ({anchors} - 1), 0) AS BIGINT)) END, frame_index) UNION ALL """
    return f"""WITH RECURSIVE s AS ({STREAM}), b AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM s),
o AS ({first if hybrid else ""}SELECT media_id, n, frame_index, timestamp_s, value, step, row_number() OVER (PARTITION BY media_id, step ORDER BY motion DESC NULLS LAST, frame_index) AS rk FROM b, (SELECT unnest([1, 2, 3]) AS step)),
q AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY step, rk) AS pos FROM o),
r AS (SELECT DISTINCT media_id, 0::BIGINT AS pos, []::STRUCT(f BIGINT, t DOUBLE, v DOUBLE, s INTEGER)[] AS acc FROM b
 UNION ALL SELECT r.media_id, q.pos, CASE WHEN len(acc) < least({BUDGET}, q.n) AND len(list_filter(acc, lambda a: a.f = q.frame_index OR (q.step = 1 AND abs(a.t - q.timestamp_s) < {g["min_distance_seconds"]})
 OR (q.step < 3 AND abs(a.v - q.value) / 1000.0 < {g["duplicate_threshold"]}))) = 0 THEN list_append(acc, {{'f': q.frame_index, 't': q.timestamp_s, 'v': q.value, 's': q.step}}) ELSE acc END FROM r JOIN q ON q.media_id = r.media_id AND q.pos = r.pos + 1),
z AS (SELECT media_id, unnest(acc) AS a FROM (SELECT media_id, acc FROM r QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY pos DESC) = 1))
SELECT media_id, a.f AS frame_index, a.s::BIGINT AS step FROM z"""


_DIFF = "abs(value - lag(value) OVER (PARTITION BY media_id ORDER BY frame_index))"
_SIGNATURES = "SELECT label::BIGINT AS media_id, vec_id AS frame_index, list_transform(embedding, lambda x: x::DOUBLE) AS signature, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings"
_KINDS = ("click", "error", "purchase", "signup", "view")
_ABS = "list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))"
_USABLE = "fps > 0 AND NOT isnan(fps) AND frame_count > 0"
SQL = {
    "video_probe": f"SELECT video_path, frame_count, round(duration_seconds, 6) AS duration_seconds, coalesce(NOT (fps <= 0 OR isnan(fps) OR frame_count <= 0 OR width <= 0 OR height <= 0), false) AS usable FROM ({VIDEOS})",
    "candidate_schedule": f"""SELECT video_path, frame_index, step, frame_index % step = 0 OR frame_index = frame_count - 1 AS scheduled
 FROM (SELECT c.video_path, c.frame_index, v.frame_count, greatest(1, CAST(round_even(fps / 4.0, 0) AS BIGINT)) AS step FROM ({CANDIDATES}) c JOIN ({VIDEOS}) v USING (video_path) WHERE {_USABLE})""",
    "source_intervals": f"""SELECT video_path, frame_index, round(greatest(0.0, timestamp_s - h), 6) AS source_start, round(least(duration_seconds, timestamp_s + h), 6) AS source_end
 FROM (SELECT c.*, v.duration_seconds, CASE WHEN discovery = 'spike_guard' THEN 0.5 / fps ELSE 0.125 END AS h FROM ({CANDIDATES}) c JOIN ({VIDEOS}) v USING (video_path) WHERE fps > 0 AND NOT isnan(fps))""",
    "label_frames": f"SELECT label_id, least(frame_count - 1, greatest(0, CAST(round_even(start_s * fps, 0) AS BIGINT))) AS frame_index FROM ({LABELS}) l JOIN ({CASES}) k USING (case_id) JOIN ({VIDEOS}) v USING (video_path) WHERE {_USABLE} AND NOT isnan(start_s)",
    "lag_difference": f"SELECT media_id, frame_index, round(coalesce({_DIFF}, 0), 6) AS difference FROM ({STREAM})",
    "histogram_distance": f"""WITH h AS (SELECT ts::DATE AS day, {", ".join(f"count(*) FILTER (event_type = '{k}') / count(*) AS {k}" for k in _KINDS)} FROM events GROUP BY 1)
SELECT CAST(b.day AS VARCHAR) AS day, round(sqrt(greatest(0.0, 1 - ({" + ".join(f"sqrt(a.{k} * b.{k})" for k in _KINDS)}))), 6) AS distance FROM h a JOIN h b ON b.day = a.day + 1""",
    "signature_distance": f"SELECT media_id, frame_index, round(list_sum({_ABS.format(a='signature', b='before')}) / len(signature), 6) AS distance FROM ({_SIGNATURES}) WHERE before IS NOT NULL",
    "motion_fraction": f"SELECT media_id, frame_index, round(len(list_filter({_ABS.format(a='signature', b='before')}, lambda d: d >= 0.1)) / len(signature), 6) AS motion FROM ({_SIGNATURES}) WHERE before IS NOT NULL",
    "spike_promotion": f"""WITH d AS (SELECT *, {_DIFF} AS difference, count(*) OVER (PARTITION BY media_id) AS n FROM ({STREAM})),
a AS (SELECT *, coalesce(difference >= 60, false) AS above, frame_index % 3 = 0 OR frame_index = n - 1 AS scheduled FROM d),
s AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY media_id ORDER BY frame_index), false) AND NOT scheduled AS spike FROM a)
SELECT media_id, frame_index, CASE WHEN spike THEN 'spike_guard' ELSE 'scheduled' END AS discovery FROM s WHERE scheduled OR spike""",
    "robust_scale": f"WITH c AS ({CANDIDATES}), s AS ({_SCALES}) SELECT video_path, {', '.join(f'round({c}_p95, 9) AS {c}_p95' for c in SIGNALS)} FROM s",
    "importance": _SCORED + "SELECT video_path, frame_index, importance, scene_change FROM i",
    "importance_topk": _SCORED + f"SELECT video_path, frame_index, importance, row_number() OVER (PARTITION BY video_path ORDER BY importance DESC, frame_index) AS rank FROM i QUALIFY rank <= {BUDGET}",
    "importance_summary": f"SELECT video_path, count(*) AS rows, round(coalesce(min(importance), 0), 9) AS importance_min, round(coalesce(max(importance), 0), 9) AS importance_max, round(coalesce(avg(importance), 0), 9) AS importance_mean FROM ({CANDIDATES}) GROUP BY video_path",
    "uniform_select": f"SELECT video_path, frame_index FROM ({_uniform(CANDIDATES, 'video_path', BUDGET)})",
    "equal_bin_centres": f"""SELECT video_path, least(frame_count - 1, floor((b + 0.5) * frame_count / least(frame_count, {BUDGET}))::BIGINT) AS frame_index FROM (SELECT video_path, frame_count, unnest(range(0, least(frame_count, {BUDGET}))) AS b FROM ({VIDEOS}) WHERE frame_count > 0)""",
    "score_only_select": _greedy_sql(False),
    "hybrid_select": _greedy_sql(True),
    "event_recall": f"""WITH l AS (SELECT * FROM ({LABELS}) JOIN ({CASES}) USING (case_id) WHERE NOT isnan(start_s) AND NOT isnan(end_s)), p AS ({_uniform(CANDIDATES, "video_path", BUDGET)}),
h AS (SELECT label_id FROM l SEMI JOIN p ON p.video_path = l.video_path AND p.timestamp_s BETWEEN l.start_s - l.tolerance AND l.end_s + l.tolerance)
SELECT category, count(*) AS events, count(h.label_id) AS recalled, round(count(h.label_id) / count(*), 6) AS recall FROM l LEFT JOIN h USING (label_id) GROUP BY category""",
    "redundancy": f"""WITH p AS ({_uniform("SELECT label::BIGINT AS media_id, vec_id AS frame_index, list_transform(embedding, lambda x: x::DOUBLE) AS signature FROM embeddings", "media_id", 32)}),
h AS (SELECT DISTINCT b.media_id, b.frame_index FROM p a JOIN p b ON a.media_id = b.media_id AND a.frame_index < b.frame_index WHERE list_sum({_ABS.format(a="a.signature", b="b.signature")}) / len(a.signature) < 0.12)
SELECT media_id, count(*) AS selected, count(h.frame_index) AS redundant, round(count(h.frame_index) / count(*), 6) AS redundancy FROM p LEFT JOIN h USING (media_id, frame_index) GROUP BY media_id""",
    "temporal_coverage": f"SELECT video_path, covered, bins::BIGINT AS bins, round(covered / bins, 6) AS coverage FROM ({_coverage_sql(_uniform(CANDIDATES, 'video_path', BUDGET))})",
    "method_means": f"""SELECT method, count(*) AS cases, round(avg(covered / bins), 6) AS coverage, round(avg(bins), 6) AS bins FROM (SELECT 'uniform' AS method, * FROM ({_coverage_sql(_uniform(CANDIDATES, "video_path", BUDGET))}) UNION ALL SELECT 'importance', * FROM ({_coverage_sql(_TOP)})) GROUP BY method""",
}
