"""Percentiles, sweeps, images, interpreters, the live run and what plans rest on, on small fixtures."""

import hashlib
import json
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framegate import cli
from framegate.config import Gate, Requirements, Sampler, Streaming
from framegate.operators import claims, evaluate, frames, gate, interpret, locks, metrics, select, signals
from framegate.plans import durable as tables
from framegate.sources import sinks, synthetic
from framegate.streaming.live_gate import LiveRun, Session, live_gate


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the interpreter of the tests goes to the workers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_percentile_is_numpy(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.choice([None, float("nan"), 0.0, -1.0, 0.5, rng.random(), rng.random() * 1e-3]), rng.choice([1e-13, 0.0])) for _ in range(400)] + [("c", None, 2.0), ("d", 7.0, None)]
    df = spark.createDataFrame(data, "s string, x double, y double").repartition(5)
    got = {r["s"]: (r["x_p95"], r["y_p95"]) for r in signals.robust_scales(df, ["x", "y"], ["s"]).collect()}
    for s in "abcd":
        own = [x for k, x, _ in data if k == s and x is not None and x > 0]
        assert got[s][0] == (pytest.approx(np.percentile(own, 95), rel=1e-12) if own else None)
    assert got["a"][1] is None and got["c"] == (None, 2.0) and got["d"][1] is None
    assert rows(signals.robust_scales(df.limit(0), ["x"], ["s"])) == []


def brute_greedy(items, config, scale, anchors):
    """items: (index, time, importance, look) of one stream. The choice with the whole stream in hand."""
    items = sorted(items)
    target, taken = min(config.budget, len(items)), []
    near = lambda i, j: np.abs(np.array(items[i][3]) - np.array(items[j][3])).mean() / scale
    if anchors:
        count = min(target, max(1, round(target * config.coverage_fraction)))
        spots = sorted({int(np.rint(k * (len(items) - 1) / max(1, count - 1))) for k in range(count)}) if count > 1 else [0]
        for i in spots:
            if all(near(i, j) >= config.duplicate_threshold for j, _ in taken):
                taken.append((i, 0))
    order = sorted(range(len(items)), key=lambda i: (-(items[i][2] if items[i][2] is not None and items[i][2] == items[i][2] else -np.inf), items[i][0]))
    for step in (1, 2, 3):
        for i in order:
            if len(taken) == target:
                break
            clash = any(i == j or (step == 1 and abs(items[i][1] - items[j][1]) < config.min_distance_seconds) or (step < 3 and near(i, j) < config.duplicate_threshold) for j, _ in taken)
            if not clash:
                taken.append((i, step))
    return sorted((items[i][0], step) for i, step in taken)


def test_sweeps_choose_as_a_whole_stream_would(spark):
    rng = random.Random(3)
    data = [(s, i * 2, i * 0.2, rng.choice([None, float("nan"), 0.5, 0.5, rng.random()]), [float(rng.randrange(4) * 3), 1.0]) for s, n in (("a", 40), ("b", 3), ("c", 1), ("d", 25)) for i in range(n)]
    df = spark.createDataFrame(data, "media_id string, frame_index long, timestamp_s double, importance double, signature array<double>").repartition(6)
    for strategy in ("hybrid", "score_only"):
        for fraction in (0.0, 0.25, 1.0):
            config = Sampler(budget=9, strategy=strategy, coverage_fraction=fraction, duplicate_threshold=0.01)
            got = select.greedy_select(df, "media_id", config, "signature")
            for s in "abcd":
                want = brute_greedy([d[1:] for d in data if d[0] == s], config, 255.0, strategy == "hybrid")
                assert rows(got.where(F.col("media_id") == s), "frame_index", "step") == sorted(want, key=repr), (strategy, fraction, s)
    assert rows(select.greedy_select(df.limit(0), "media_id", Sampler(), "signature")) == []


def test_every_key_of_a_reused_transition(spark):
    df = spark.createDataFrame([(i, "t") for i in range(30)] + [(99, "u"), (100, None), (101, None)], "k long, t string")
    assert rows(metrics.duplicate_transitions(df, F.col("t"), F.col("k"))) == sorted((("t", i, 30) for i in range(30)), key=repr)
    assert rows(metrics.duplicate_transitions(df, F.col("t"), F.col("k"), 3)) == [("t", 30, [0, 1, 2])]


def test_audit_marks(spark):
    df = spark.createDataFrame([((0.1,), ["a"], "t", True), ((0.1,), [], "t", None), (None, ["b"], "u", False)], "region struct<x:double>, acceptable_states array<string>, transition string, real_world_eligible boolean")
    assert rows(metrics.audit_marks(df)) == [(3, 2, 2, 1, 1)]


def test_frames_of_one_medium_in_many_tasks(spark):
    """A medium that is cut anywhere gives what a loop over its frames gives."""
    from framegate.functions import pixels as px

    case = "static_short_motion"
    drawn = [synthetic.render(case, i / 20) for i in range(120)]
    got = frames.frame_signals(synthetic.frames(spark, (case,)).repartition(7), synthetic.media(spark, (case,))).orderBy("frame_index").collect()
    last = None
    for i, r in enumerate(got):
        assert r["coarse_difference"] == pytest.approx(px.mean_difference(px.signature(drawn[i]), px.signature(drawn[i - 1])) if i else 0.0)
        assert r["signature"] == px.signature(drawn[i]).ravel().tolist() and r["scheduled"] == (i % 5 == 0 or i == 119)
        if r["scheduled"]:
            assert r["frame_difference"] == pytest.approx(px.mean_difference(px.luma(drawn[i]), px.luma(drawn[last])) if last is not None else 0.0)
            last = i
        else:
            assert r["frame_difference"] == 0.0


def _told(event, last):
    return {"state": f"{event['sequence_no']}:{len(event['images'])}", "verification": "confirmed" if "Goal: g" in event["prompt"] else None}


def test_images_and_interpreter(spark, tmp_path):
    source = synthetic.frames(spark, ("brief_flash", "static_short_motion"))
    events = evaluate.observe(source)
    images = frames.event_images(source, events).collect()
    by = {}
    for r in images:
        by.setdefault((r["media_id"], r["sequence_no"]), []).append((r["position"], r["role"], r["width"], r["height"]))
        assert r["data"][:8] == b"\x89PNG\r\n\x1a\n" and r["patches"] == -(-r["width"] // 32) * -(-r["height"] // 32)
    assert sorted(by["brief_flash", 0]) == [(0, "context", 160, 96)]
    moving = sorted(i for k, v in by.items() if k[0] == "static_short_motion" and k[1] > 0 for i in v)
    assert {r for _, r, *_ in moving} >= {"context", "detail"} and all(w < 160 for _, role, w, _ in moving if role == "detail")
    files = sinks.write_event_images(frames.event_images(source, events), str(tmp_path / "i")).collect()
    assert len(files) == len(images) and all((tmp_path / "i" / f["file"]).read_bytes() for f in files)
    told = interpret.interpreted(interpret.with_images(interpret.with_prompt(events, "g"), frames.event_images(source, events)), _told)
    assert all(r["state"].split(":")[0] == str(r["sequence_no"]) and r["state"].split(":")[1] != "0" and r["verification"] == "confirmed" for r in told.collect()) and "images" not in told.columns
    _told.metadata = lambda: {"model": "rule"}
    assert interpret.metadata(_told) == {"name": "_told", "model": "rule"} and interpret.metadata(None) == {"name": "none"}
    schema = interpret.answer_schema()
    assert schema["properties"]["evidence"]["type"] == "array" and "confirmed" in schema["properties"]["verification"]["enum"] and set(schema["required"]) == set(schema["properties"])


def test_command_line_writes_images_and_asks(spark, tmp_path, capsys):
    from framegate.sources import video

    (tmp_path / "a.avi").write_bytes(video.write_avi([synthetic.render("hard_scene_cuts", i / 20) for i in range(60)], 20))
    assert cli.main(["observe", str(tmp_path / "a.avi"), str(tmp_path / "o"), "--interpreter", f"{__name__}:_told", "--goal", "g"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["observations"] >= 2 and out["interpreter"]["name"] == "_told" and out["config"]["stable_frames"] == 1
    documents = [json.loads(r["value"]) for r in spark.read.json(str(tmp_path / "o" / "documents")).collect()]
    assert all(d["images"] and (tmp_path / "o" / "images" / d["images"][0]["file"]).is_file() and d["verification"] == "confirmed" for d in documents)


def test_live_counters_detail_and_backlog():
    session = Session(Gate(min_event_interval_seconds=0.0), Streaming(pending_events=3, retries=0, history_events=5), goal="watch")
    row = lambda t, control=None, box=None, text=None: (float(t), t, control, False, 0.0, "none", box, text, None)
    with pytest.raises(ValueError):
        session.feed(row(0, "detail"))
    session.feed(row(0))
    out = session.feed(row(1, "detail", [1, 2, 3, 4, 9, 9], " look closer ")) + session.drain(lambda e, last: e["goal"])
    assert [(r[2], r[6], r[12], r[18]) for r in out] == [(0, None, None, "watch"), (0, 1, None, "look closer")]
    with pytest.raises(ValueError):
        session.feed(row(2, "detail", None, "  "))
    late = [r for t in range(3, 9) for r in session.feed(row(t, "snapshot"))]  # an interpreter that lags: the queue holds three
    assert [r[16] for r in late] == ["failed"] * 3 and len(session.drain(lambda e, last: "x", most=2)) == 2 and len(session.queue) == 1
    stats = session.stats()
    assert (stats["frames_submitted"], stats["detail_requests"], stats["events_dropped"], stats["max_observed_queue_depth"], stats["interpretations_completed"], stats["current_queue_depth"], stats["retained_events"]) == (1, 1, 3, 3, 4, 1, 5)
    assert Session.load(session.gate, session.streaming, session.dump(), "watch").stats() == stats


def test_live_run_polls_waits_and_closes(spark, tmp_path):
    given = gate.gate_input(spark.range(30).selectExpr("'a' media_id", "id frame_index", "double(id) timestamp_s"), F.lit(False), F.lit(0.0), F.lit("none"), control=F.lit("snapshot"))
    given.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    with LiveRun(live_gate(source, Gate(), counters=True), str(tmp_path / "out")) as run:
        assert run.wait_until_idle(60.0)
        first = run.poll(10)
        rest = run.poll()
        assert [r["sequence_no"] for r in first] == list(range(10)) and len(rest) == 21 and run.poll() == []
        counters = next(r for r in rest if r["status"] == "counters")
        assert json.loads(counters["interpretation"])["detector_events"] == 30 and [r["status"] for r in first] == ["event"] * 10
        with pytest.raises(ValueError):
            run.poll(-1)
        with pytest.raises(ValueError):
            run.wait_until_idle(-1.0)
        assert run.close(timeout=30.0) and run.close()


def test_scratch_tables_go(spark):
    import os

    def there(df):
        return [p for f in df.inputFiles() if os.path.exists(p := f.removeprefix("file://"))]

    kept = tables.durable(spark.range(5))
    with tables.scratch(spark):
        gone = tables.durable(spark.range(7))
        files = [f.removeprefix("file://") for f in gone.inputFiles()]
        assert there(gone)
    assert not any(map(os.path.exists, files)) and kept.count() == 5


def test_draws_by_hash_are_brute_force(spark, monkeypatch):
    sums = {f"w{i:02d}": (i * 3 - 20, i + 1) for i in range(17)}
    df = spark.createDataFrame([(k, *v) for k, v in sums.items()], "workflow_id string, total long, members long").repartition(4)
    want, ids = [], sorted(sums)
    for sample in range(1, 41):
        drawn = []
        for slot in range(1, 18):
            x = (sample * 8191 + slot * 131071 + 5 * 1000003) % claims.PRIME
            for k, c in claims.ROUNDS:
                x = (x * x + x * k + c) % claims.PRIME
            drawn.append(sums[ids[x % 17]])
        want.append((sample, sum(t for t, _ in drawn), sum(m for _, m in drawn)))
    for held in (claims.HELD, 0):  # sums sent to every task, and merged
        monkeypatch.setattr(claims, "HELD", held)
        assert rows(claims.hashed_draws(df, 40, 5)) == sorted(want, key=repr)
    assert rows(claims.hashed_draws(df.limit(0), 40, 5)) == []


def _drawn(values: list, samples: int, seed: int, prime: int) -> list:
    """Bootstrap samples by a plain loop over draws: sample, total, members."""
    out = []
    for sample in range(1, samples + 1):
        own = []
        for slot in range(1, len(values) + 1):
            x = (sample * 8191 + slot * 131071 + seed * 1000003) % prime
            for k, c in claims.ROUNDS:
                x = (x * x + x * k + c) % prime
            own.append(values[x % len(values)])
        known = [t for t, _ in own if t is not None]
        out.append((sample, sum(known) if known else None, sum(m for _, m in own)))
    return out


def test_draws_by_hash_are_not_rows(spark, monkeypatch):
    """More draws than a disk takes: they are summed up where they are made, on a circle whose places are hashed once."""
    monkeypatch.setattr(claims, "HELD", 700)
    monkeypatch.setattr(claims, "BLOCK", 1000)
    values = [(i % 7 - 3, i % 5 + 1) for i in range(1500)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "workflow_id long, total long, members long").repartition(3)
    got = claims.hashed_draws(df, 12, 7)
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert rows(got) == sorted(_drawn(values, 12, 7, claims.PRIME), key=repr)


def test_draws_by_hash_around_the_circle(spark, monkeypatch):
    monkeypatch.setattr(claims, "PRIME", 127)  # the runs of places overlap, pass the circle's end, and go around it whole
    monkeypatch.setattr(claims, "SPAN", 50)
    for n in (1, 60, 126, 127, 128, 300):
        values = [(i * i - 40, i % 3 + 1) for i in range(n)]
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "workflow_id long, total long, members long").repartition(3)
        assert rows(claims.hashed_draws(df, 30, 9)) == sorted(_drawn(values, 30, 9, 127), key=repr), n


def test_draws_by_hash_of_unknown_and_broken_totals(spark):
    values = [(None, 2), (0.5, 1), (None, 3), (-1.25, 4)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "workflow_id long, total double, members long")
    want = _drawn(values, 60, 3, claims.PRIME)
    assert any(t is None for _, t, _ in want)
    assert rows(claims.hashed_draws(df, 60, 3)) == sorted(want, key=repr)
    whole = df.withColumn("total", (F.col("total") * 4).cast("long"))
    assert rows(claims.hashed_draws(whole, 60, 3)) == sorted([(b, None if t is None else int(t * 4), m) for b, t, m in want], key=repr)


def test_comparison_reads_the_pairs_once(spark):
    """With draws by hash it does not make the pairs anew for each interval; both intervals are those of the plain loop."""
    events = [(f"e{i}", f"w{i * i % 23:02d}", ("action_failure", "other", None)[i % 3], None if i % 31 == 0 else i % 4 > 0, i % 5 == 0, i % 2 > 0, None if i % 27 == 0 else i % 7 == 0) for i in range(400)]
    names = ["event_id", "workflow_id", "category", "success", "false_confirmation", "base_success", "base_false_confirmation"]
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    kind = "event_id string, workflow_id string, category string, success boolean, false_confirmation boolean, base_success boolean, base_false_confirmation boolean"
    pairs = spark.createDataFrame(events, kind).mapInPandas(counted, kind)
    r = claims.compare_systems(pairs, Requirements(bootstrap_samples=100, bootstrap_seed=5), claims.hashed_draws).first()
    assert read.value == len(events)
    events = [dict(zip(names, e)) for e in events]
    failures = [e for e in events if e["category"] == "action_failure"]
    for rows_, c, seed, low, high in ((events, "success", 5, "accuracy_low", "accuracy_high"), (failures, "false_confirmation", 6, "false_confirmation_low", "false_confirmation_high")):
        sums = {}
        for e in rows_:
            total, members = sums.get(e["workflow_id"], (None, 0))
            if None not in (e[c], e[f"base_{c}"]):
                total = (total or 0) + e[c] - e[f"base_{c}"]
            sums[e["workflow_id"]] = (total, members + 1)
        means = [t / m for _, t, m in _drawn([sums[w] for w in sorted(sums)], 100, seed, claims.PRIME) if t is not None]
        assert (r[low], r[high]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    mean = lambda rows_, c: (lambda known: sum(known) / len(known))([e[c] for e in rows_ if e[c] is not None])
    assert (r["candidate_accuracy"], r["baseline_accuracy"]) == (mean(events, "success"), mean(events, "base_success"))
    assert (r["candidate_false_confirmation_rate"], r["baseline_false_confirmation_rate"]) == (mean(failures, "false_confirmation"), mean(failures, "base_false_confirmation"))
    assert (r["events"], r["workflows"], r["action_failures"]) == (400, len({e["workflow_id"] for e in events}), len(failures))
    empty = claims.compare_systems(pairs.limit(0), Requirements(bootstrap_samples=100), claims.hashed_draws).first()
    assert (empty["events"], empty["workflows"], empty["action_failures"], empty["candidate_accuracy"], empty["accuracy_low"], empty["accuracy_high"]) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_intervals_drawn_together_are_those_drawn_alone(spark, monkeypatch):
    monkeypatch.setattr(claims, "HELD", 40)
    kind = "workflow_id long, total long, members long"
    one, other = (spark.createDataFrame([(i, i * i - 40, i % 3 + 1) for i in range(n)], kind) for n in (100, 30))
    several = [(one, 5), (one.limit(0), 6), (other.withColumn("total", F.col("total") / 2), 6)]
    for (sums, seed), drawn in zip(several, claims.hashed_together(several, 30)):
        assert rows(drawn) == rows(claims.hashed_draws(sums, 30, seed))
    assert rows(claims.hashed_together(several, 30)[0]) == sorted(_drawn([(i * i - 40, i % 3 + 1) for i in range(100)], 30, 5, claims.PRIME), key=repr)


def test_contracts_and_claim_text():
    assert claims.claim_text([], "a") is None and "a" in claims.claim_text(["y", "x"], "a") and "x, y" in claims.claim_text(["y", "x"], "a")
    problems = claims.contract_problems({"systems": [{"id": "s", "kind": "other", "events": [{"event_id": "e"}, {"event_id": "e"}]}], "review": None})
    assert "system 0: kind is missing or invalid" in problems and "system 0 event 0: success is missing or invalid" in problems and "system 0: an event is listed more than once" in problems and any(p.startswith("review") for p in problems)


def _plan_with_actions(root):
    ids = [f"case-{i:02d}" for i in range(30)]
    (root / "actions").mkdir(exist_ok=True)
    listed = []
    for i in ids:
        action = {"schema_version": 1, "case_id": i, "actions": [{"id": "a1", "type": "wait_for", "expected_outcome": "success", "expected_result": "done"}, {"id": "a2", "type": "click", "expected_outcome": "failure"}]}
        data = json.dumps(action).encode()
        (root / "actions" / f"{i}.json").write_bytes(data)
        listed.append({"case_id": i, "action_file": f"actions/{i}.json", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    locks.write_object(root / "actions.json", {"schema_version": 1, "collector_revision": "b" * 40, "cases": listed})
    from framegate.config import CLAIM180

    return {
        "schema_version": 1, "protocol_id": "p", "protocol_repository": "r", "protocol_revision": "a" * 40, "case_ids": ids, "category_targets": CLAIM180.targets, "actions_manifest": locks.file_contract(root, "actions.json"),
        "workflow_sources": [{"case_id": i, "url": f"https://example.org/{i}", "goal": "g"} for i in ids],
        "target_events": [{"case_id": i, "slot_id": "s", "events": [{"action_id": "a1", "category": "loading_completion"}, {"action_id": "a2", "category": "action_failure"}]} for i in ids],
    }


def test_preregistration_rests_on_its_actions(spark, tmp_path):
    plan = _plan_with_actions(tmp_path)
    locks.write_object(tmp_path / "plan.json", plan)
    (tmp_path / "locks").mkdir()
    locks.preregister(tmp_path / "plan.json", tmp_path / "locks" / "pre.json")
    assert locks.preregistration_problems(tmp_path / "locks" / "pre.json", spark) == []
    (tmp_path / "actions" / "case-03.json").write_text("{}")
    assert "integrity" in locks.preregistration_problems(tmp_path / "locks" / "pre.json", spark)[0]
    plan["target_events"][2]["events"][0]["category"] = "action_failure"
    locks.write_object(tmp_path / "plan.json", plan)
    assert any("changed" in p for p in locks.preregistration_problems(tmp_path / "locks" / "pre.json", spark))


def test_target_problems(spark):
    actions = spark.createDataFrame([("c", "a", "wait_for", True, "success", "x"), ("c", "b", "click", False, "failure", None), ("c", "d", "click", True, "success", "y"), ("c", "d", "click", True, "success", "y")], "case_id string, action_id string, type string, required boolean, expected_outcome string, expected_result string")
    targets = spark.createDataFrame([("c", "s", "a", "loading_completion", "x"), ("c", "s", "a", "loading_completion", "z"), ("c", "s", "b", "action_failure", None), ("c", "s", "d", "other", None), ("c", "s", "e", "other", None), ("c", "s", "b", "loading_completion", None)], "case_id string, slot_id string, action_id string, category string, expected_result string")
    got = rows(locks.target_problems(actions, targets), "action_id", "problem")
    assert got == sorted([("a", "expected result differs"), ("b", "action is not required"), ("b", "action is not required"), ("b", "outcome does not fit the category"), ("b", "loading target must wait and succeed"), ("d", "action is missing or duplicated"), ("e", "action is missing or duplicated")], key=repr)


def test_supplement_rests_on_three_files(tmp_path):
    files = {"preregistration": {"kind": "held_out_preregistration", "preregistration_id": None, "x": 1}}

    def write(name, value):
        identity, time = locks.BASE_EVIDENCE[name]
        value[identity] = locks.fingerprint(value, tuple(c for c in (identity, time) if c))
        locks.write_object(tmp_path / f"{name}.json", value)
        return locks.file_contract(tmp_path, f"{name}.json") | {"identity": value[identity]}

    evidence = {"preregistration": write("preregistration", files["preregistration"])}
    collection = {"preregistration_id": files["preregistration"]["preregistration_id"], "generated_at_utc": "now"}
    evidence["collection_summary"] = write("collection_summary", collection)
    inventory = {"collection_id": collection["collection_id"], "model_outputs_seen": False, "supplement_deficits": {"action_failure": 2}}
    evidence["event_inventory"] = write("event_inventory", inventory)
    assert locks.supplement_base(tmp_path, evidence) == {"action_failure": 2}
    seen = evidence | {"event_inventory": write("event_inventory", inventory | {"model_outputs_seen": True})}
    with pytest.raises(locks.LockError, match="seen"):
        locks.supplement_base(tmp_path, seen)
    with pytest.raises(locks.LockError, match="integrity"):
        locks.supplement_base(tmp_path, evidence)


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    data = bytes(range(256)) * 10000
    (tmp_path / "a b.bin").write_bytes(data)
    r = locks.file_facts(spark, [str(tmp_path / "a b.bin")]).first()
    assert (r["bytes"], r["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())


def test_bounds_of_settings():
    assert Gate(min_changed_fraction=0.0).min_changed_fraction == 0.0
    for kind, bad in ((Gate, dict(local_analysis_width=100)), (Gate, dict(max_active_seconds=0)), (Sampler, dict(candidate_hz=float("nan"))), (Sampler, dict(budget=True)), (Streaming, dict(ring_frames=0))):
        with pytest.raises(ValueError):
            kind(**bad)
