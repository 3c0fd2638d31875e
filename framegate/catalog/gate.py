"""The change gate over the event stream: a change is a step of at least 30 between neighbours, times run over days."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.catalog.selection import BUDGET, STREAM, _uniform
from framegate.config import Gate
from framegate.operators import gate, select, signals
from framegate.sources.streams import stream

STEP = 30.0
SLOW = Gate(min_event_interval_seconds=3600.0, max_active_seconds=86400.0)


def gate_rows(rows: DataFrame) -> DataFrame:
    rows = signals.stepped(rows, ["value"]).withColumn("difference", F.abs(F.col("value") - F.col("previous_value")))
    changed = F.coalesce(F.col("difference") >= STEP, F.lit(False))
    return gate.gate_input(rows, changed, F.coalesce("difference", F.lit(0.0)) / 1000, F.lit("global_fraction"))


_KEEP = ("media_id", "sequence_no", "frame_index", "reason", "discovery")


def _view(events: DataFrame, *more: str) -> DataFrame:
    return events.select(*_KEEP, F.round("change_fraction", 6).alias("change_fraction"), "peak_frame_index", *more)


def gate_events(spark: SparkSession, folder: str) -> DataFrame:
    return _view(gate.run_gate(gate_rows(stream(spark, folder)), SLOW))


def gate_flush(spark: SparkSession, folder: str) -> DataFrame:
    return _view(gate.run_gate(gate_rows(stream(spark, folder)), SLOW, flush=True))


def gate_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase is verified right after its frame."""
    whole = stream(spark, folder)
    rows = gate_rows(whole)
    bought = whole.where("event_type = 'purchase'").withColumns({"action_text": F.lit("buy"), "expected_result": F.lit("receipt")})
    forced = gate.gate_input(bought, F.lit(False), F.lit(0.0), F.lit("none"), control=F.lit("verify"))
    return _view(gate.run_gate(rows.unionByName(forced), SLOW))


def gate_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    picked = select.uniform_select(stream(spark, folder), ["media_id"], BUDGET)
    return gate.snapshots(picked).select(*_KEEP)


def gate_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline's snapshots with the purchases verified after them."""
    whole = stream(spark, folder)
    base = gate.snapshots(select.uniform_select(whole, ["media_id"], BUDGET))
    bought = whole.where("event_type = 'purchase'").withColumns({"reason": F.lit("action_verification"), "discovery": F.lit("forced"), "change_fraction": F.lit(0.0)})
    return gate.append_verifications(base, bought).select(*_KEEP)


def gate_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens over the emitted events; every fifth call reported nothing."""
    events = gate.run_gate(gate_rows(stream(spark, folder)), SLOW).withColumns({
        "called": F.col("reason") != "initial", "input_tokens": F.when(F.col("sequence_no") % 5 != 0, F.col("sequence_no") + 100), "output_tokens": F.when(F.col("sequence_no") % 5 != 0, F.lit(9).cast("long")),
    })
    return gate.gate_totals(events, ["media_id"])


def stream_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The same events by a streaming query over files, with their status ('event': no interpreter is given)."""
    import uuid

    from framegate.plans.durable import durable, shared_folder
    from framegate.streaming.live_gate import live_gate

    rows = durable(gate_rows(stream(spark, folder)).repartition("media_id"))
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    source = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    query = live_gate(source, SLOW).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return _view(spark.read.parquet(f"{place}/out"), "status")


QUERIES = {f.__name__: f for f in (gate_events, gate_flush, gate_forced, gate_snapshots, gate_appended, gate_totals, stream_gate)}


def _gate_sql(forced: bool = False, flush: bool = False) -> str:
    """The machine as a recursion over a stream's rows: what is pending, since when, how large, and the last event.

    k is the kind of event that row i causes; the peak shown is the one before the row clears it.
    """
    rows = "SELECT media_id, frame_index, timestamp_s, changed, fraction, 0 AS ctl FROM f"
    if forced:
        rows += " UNION ALL SELECT media_id, frame_index, timestamp_s, false, 0.0, 1 FROM f WHERE event_type = 'purchase'"
    rows_end = " UNION ALL SELECT media_id, i + 1, frame_index, timestamp_s, false, 0.0, 2 FROM s0 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY i DESC) = 1" if flush else ""
    ready, age = "s.timestamp_s - r.le >= 3600", "s.timestamp_s - coalesce(r.since, s.timestamp_s) >= 86400"
    kind = f"""CASE WHEN s.ctl = 2 THEN CASE WHEN r.pending THEN 'stream_end' END WHEN s.ctl = 1 THEN 'action_verification' WHEN s.changed AND {age} AND {ready} THEN 'active_timeout'
 WHEN NOT s.changed AND r.pending AND {ready} THEN 'change_stable' END"""
    return f"""WITH RECURSIVE f AS (SELECT *, coalesce(d >= {STEP}, false) AS changed, coalesce(d, 0) / 1000 AS fraction FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY media_id ORDER BY frame_index)) AS d FROM ({STREAM}))),
s0 AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY frame_index, ctl) - 1 AS i, frame_index, timestamp_s, changed, fraction, ctl FROM ({rows})),
s AS (SELECT * FROM s0{rows_end}),
r AS (SELECT media_id, i, frame_index, 'initial' AS k, 1.0::DOUBLE AS out_fraction, NULL::BIGINT AS out_peak, 'initial' AS out_how, false AS pending, 0.0::DOUBLE AS fraction, NULL::BIGINT AS peak, NULL::DOUBLE AS since, timestamp_s AS le FROM s WHERE i = 0
 UNION ALL SELECT media_id, i, frame_index, k, CASE WHEN k = 'action_verification' THEN 0.0 ELSE nf END, CASE WHEN k <> 'action_verification' THEN np END, CASE WHEN k = 'action_verification' THEN 'forced' ELSE 'global_fraction' END,
 CASE WHEN k IS NULL THEN pending OR changed ELSE false END, CASE WHEN k IS NULL THEN nf ELSE 0.0 END, CASE WHEN k IS NULL THEN np END, CASE WHEN k IS NULL THEN CASE WHEN changed THEN coalesce(since, timestamp_s) ELSE since END END, CASE WHEN k IS NULL THEN le ELSE timestamp_s END
 FROM (SELECT s.media_id, s.i, s.frame_index, s.timestamp_s, s.changed, r.pending, r.since, r.le, {kind} AS k, CASE WHEN s.changed AND s.fraction > r.fraction THEN s.fraction ELSE r.fraction END AS nf, CASE WHEN s.changed AND s.fraction > r.fraction THEN s.frame_index ELSE r.peak END AS np FROM r JOIN s ON s.media_id = r.media_id AND s.i = r.i + 1)),
e AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY i) - 1 AS sequence_no, frame_index, k AS reason, out_how AS discovery, round(out_fraction, 6) AS change_fraction, out_peak AS peak_frame_index FROM r WHERE k IS NOT NULL)
"""


_EVENTS = "SELECT media_id, sequence_no, frame_index, reason, discovery, change_fraction, peak_frame_index FROM e"
_SNAPSHOTS = f"SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY frame_index) - 1 AS sequence_no, frame_index, 'scheduled_baseline' AS reason, 'uniform' AS discovery FROM ({_uniform(STREAM, 'media_id', BUDGET)})"
SQL = {
    "gate_events": _gate_sql() + _EVENTS,
    "stream_gate": _gate_sql() + _EVENTS.replace("SELECT ", "SELECT 'event' AS status, ", 1),
    "gate_flush": _gate_sql(flush=True) + _EVENTS,
    "gate_forced": _gate_sql(forced=True) + _EVENTS,
    "gate_snapshots": _SNAPSHOTS,
    "gate_appended": f"""{_SNAPSHOTS} UNION ALL SELECT p.media_id, coalesce(n, 0) + row_number() OVER (PARTITION BY p.media_id ORDER BY timestamp_s, frame_index) - 1, frame_index, 'action_verification', 'forced'
 FROM (SELECT * FROM ({STREAM}) WHERE event_type = 'purchase') p LEFT JOIN (SELECT media_id, count(*) AS n FROM ({_SNAPSHOTS}) GROUP BY media_id) USING (media_id)""",
    "gate_totals": _gate_sql() + """SELECT media_id, count(*) AS events, count(*) FILTER (c) AS ai_calls, count(*) FILTER (c AND u) AS ai_calls_with_reported_usage, sum(CASE WHEN c AND u THEN sequence_no + 100 END)::BIGINT AS reported_input_tokens,
 sum(CASE WHEN c AND u THEN 9 END)::BIGINT AS reported_output_tokens, count(*) FILTER (c AND NOT u) AS ai_calls_without_reported_usage, count(*) FILTER (c) > 0 AND count(*) FILTER (c AND NOT u) = 0 AS reported_usage_complete
 FROM (SELECT *, reason <> 'initial' AS c, sequence_no % 5 <> 0 AS u FROM e) GROUP BY media_id""",
}
