"""Command line: python -m framegate.cli COMMAND ... Exit codes: 0 done, 1 the answer is no, 2 bad input."""

import argparse
import importlib
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.config import CLAIM180, PILOT60, STRATEGIES, Gate, Sampler
from framegate.operators import claims, evaluate, frames, interpret, locks, match, metrics, select, signals
from framegate.operators.gate import append_verifications, gate_totals
from framegate.plans.durable import durable, scratch
from framegate.sources import sinks, video
from framegate.sources.manifest import read_manifest

PROFILES = {p.name: p for p in (PILOT60, CLAIM180)}


def _session() -> SparkSession:
    return SparkSession.builder.appName("framegate").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a report, whose number does not grow with the data."""
    return [json.loads(r) for r in df.toJSON().collect()]


def _loaded(name: str | None):
    """A function or object named module:attribute, null for none. It travels to the executors by value."""
    if not name:
        return None
    path, _, attribute = name.partition(":")
    module = importlib.import_module(path)
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, attribute)


def _video(spark: SparkSession, path: str | list[str], decoder: str | None = None) -> tuple[DataFrame, DataFrame]:
    media = video.probe(spark, path)
    bad = media.where("error is not null").select("media_id", "error").first()
    if bad:
        raise ValueError(f"{bad['media_id']}: {bad['error']}")
    return media, video.frames_from_avi(spark, path, _loaded(decoder))


def analyze(spark: SparkSession, a) -> int:
    media, rows = _video(spark, a.video, a.decoder)
    config = Sampler(budget=a.budget, strategy=a.strategy)
    scored = durable(frames.candidates(rows, media, config))
    picked = durable(select.greedy_select(scored, "media_id", config, "signature").join(scored, ["media_id", "frame_index"]))
    sinks.write_table(sinks.candidate_json(scored), f"{a.output}/timeline")
    files = sinks.write_frames(video.requested(rows, picked), f"{a.output}/frames").count()
    summary = _rows(metrics.importance_summary(scored, ["media_id"]))
    near = metrics.redundancy(picked, "media_id", "frame_index", lambda x, y: signals.signature_distance(F.col(f"{x}.signature"), F.col(f"{y}.signature")), config.duplicate_threshold)
    known = media.select("media_id", "fps", "frame_count", "width", "height", "fourcc", "duration_seconds")
    sinks.write_report({"schema_version": 1, "selected": files, "summary": summary, "redundancy": _rows(near), "videos": _rows(known), "config": asdict(config)}, Path(a.output) / "report.json")
    print(json.dumps({"selected": files, "summary": summary}, sort_keys=True))
    return 0


def _shown(spark: SparkSession, rows: DataFrame, events: DataFrame, goal: str, interpreter, folder: str) -> DataFrame:
    """Events with their images written as files and, if there is an interpreter, its answers; written as a table and as documents."""
    images = durable(frames.event_images(rows, events))
    files = durable(sinks.write_event_images(images, f"{folder}/images"))
    if interpreter is not None:
        events = durable(interpret.interpreted(interpret.with_images(interpret.with_prompt(events, goal), images), interpreter).drop("prompt"))
    sinks.write_table(events, f"{folder}/observations")
    sinks.write_json(sinks.observation_json(events, files), f"{folder}/documents")
    return events


def observe(spark: SparkSession, a) -> int:
    _, rows = _video(spark, a.video, a.decoder)
    interpreter = _loaded(a.interpreter)
    _shown(spark, rows, evaluate.observe(rows), a.goal, interpreter, a.output)
    out = {"schema_version": 2, "observations": spark.read.parquet(f"{a.output}/observations").count(), "interpreter": interpret.metadata(interpreter), "config": asdict(Gate())}
    sinks.write_report(out, Path(a.output) / "report.json")
    print(json.dumps(out, sort_keys=True, default=str))
    return 0


def evaluate_manifest(spark: SparkSession, a) -> int:
    labels = read_manifest(spark, a.manifest)
    paths = [str((Path(a.manifest).parent / r[0]).resolve()) for r in labels.select("video").distinct().collect()]
    media, rows = _video(spark, paths, a.decoder)
    names = spark.createDataFrame([(f"file:{p}", p) for p in paths], "media_id string, path string")
    own = labels.withColumn("path", F.concat(F.lit(str(Path(a.manifest).parent.resolve()) + "/"), "video")).join(names, "path")
    own = durable(own.withColumn("label_id", F.concat_ws("/", "case_id", "event_id")))
    gate = durable(evaluate.observe(rows))
    budget = gate.groupBy("media_id").agg(F.count(F.lit(1)).alias("budget"))
    forced = durable(evaluate.verifications(rows, media, own))
    interpreter = _loaded(a.interpreter)
    out = {"schema_version": 1, "config": asdict(Gate()), "interpreter": interpret.metadata(interpreter)}
    for method, events in (("gate", gate), ("uniform", evaluate.uniform_baseline(media, budget))):
        full = _shown(spark, rows, durable(append_verifications(events, forced)), a.goal, interpreter, f"{a.output}/{method}")
        scored = evaluate.scores(own, full, media, method)
        sinks.write_json(match.review_rows(scored["matches"], method), f"{a.output}/{method}/review")
        sinks.write_json(scored["cases"], f"{a.output}/{method}/cases")
        usage = _rows(gate_totals(full.withColumns({"method": F.lit(method), "called": F.lit(interpreter is not None)}), ["method"]))
        out[method] = {"totals": _rows(scored["totals"]), "categories": _rows(scored["categories"]), "usage": usage, "cases": f"{method}/cases"}
        sinks.write_table(scored["matches"], f"{a.output}/{method}/matches")
    out["evaluation_id"] = locks.fingerprint(out)
    sinks.write_report(out, Path(a.output) / "evaluation.json")
    print(json.dumps(out, sort_keys=True, default=str))
    return 0


def score(spark: SparkSession, a) -> int:
    out = {}
    for method in ("gate", "uniform"):
        matches = spark.read.parquet(f"{a.evaluation}/{method}/matches")
        reviews = spark.read.schema("case_id string, event_id string, evidence_visible boolean, semantic_correct boolean, task_state_correct boolean, false_confirmation boolean").json(f"{a.evaluation}/{method}/review")
        out[method] = _rows(match.score_reviews(matches, reviews, ["case_id", "event_id"], ["category"]))
    sinks.write_report(out, Path(a.evaluation) / "score.json")
    print(json.dumps(out, sort_keys=True))
    return 0


def _audit(spark: SparkSession, path: str, profile: str) -> dict:
    labels = read_manifest(spark, path).withColumn("transition", F.coalesce("source_transition_id", F.concat_ws("/", "case_id", "event_id")))
    cases = labels.select("case_id").distinct().count()
    done = metrics.profile_complete(labels, cases, PROFILES[profile])
    return {"profile": profile, "cases": cases, "counts": _rows(metrics.audit_counts(labels, PROFILES[profile])), "marks": _rows(metrics.audit_marks(labels)), **_rows(done)[0]}


def audit(spark: SparkSession, a) -> int:
    out = _audit(spark, a.manifest, a.profile)
    print(json.dumps(out, sort_keys=True))
    return 0 if out["profile_complete"] else 1


def freeze(spark: SparkSession, a) -> int:
    profile = CLAIM180.name if a.role == "held_out" else PILOT60.name
    print(locks.freeze(spark, a.manifest, _audit(spark, a.manifest, profile), a.role, a.output, a.preregistration)["freeze_id"])
    return 0


def preregister(spark: SparkSession, a) -> int:
    print(locks.preregister(a.plan, a.output)["preregistration_id"])
    return 0


def supplement(spark: SparkSession, a) -> int:
    given = locks.read_object(a.plan, "supplement plan")
    print(locks.preregister_supplement(a.base, given["deficits"], given["targets"], a.output, given.get("base_evidence"))["supplement_id"])
    return 0


def verify(spark: SparkSession, a) -> int:
    out = locks.verify_freeze(spark, a.freeze, a.root or Path(a.freeze).parent)
    print(json.dumps(out, sort_keys=True))
    return 0 if out["valid"] else 1


def assess(spark: SparkSession, a) -> int:
    out = claims.assess(spark, a.comparison)
    if a.output:
        sinks.write_report(out, a.output)
    print(json.dumps(out, sort_keys=True, default=str))
    return 0 if out["claim_supported"] else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framegate")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        p.set_defaults(run=run)
        return p

    def options(p: argparse.ArgumentParser, *more: str) -> argparse.ArgumentParser:
        p.add_argument("--decoder", help="module:function that turns (bytes, width, height) of a coded frame into pixels")
        if "interpreter" in more:
            p.add_argument("--interpreter", help="module:function that takes (event, last state) and gives a dict with state and verification")
            p.add_argument("--goal", default="")
        return p

    p = options(command("analyze", analyze, "video", "output"))
    p.add_argument("--budget", type=int, default=32)
    p.add_argument("--strategy", choices=STRATEGIES, default="hybrid")
    options(command("observe", observe, "video", "output"), "interpreter")
    options(command("evaluate", evaluate_manifest, "manifest", "output"), "interpreter")
    command("score", score, "evaluation")
    command("audit-manifest", audit, "manifest").add_argument("--profile", choices=sorted(PROFILES), default=PILOT60.name)
    p = command("freeze-manifest", freeze, "manifest", "output")
    p.add_argument("--role", choices=locks.ROLES, required=True)
    p.add_argument("--preregistration")
    command("preregister-heldout", preregister, "plan", "output")
    command("preregister-claim180-supplement", supplement, "base", "plan", "output")
    command("verify-freeze", verify, "freeze").add_argument("--root")
    command("assess-claim", assess, "comparison").add_argument("--output")
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        spark = _session()
        with scratch(spark):
            return a.run(spark, a)
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
