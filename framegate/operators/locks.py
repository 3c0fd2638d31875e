"""Integrity: fingerprints, file checks, plans and what a collection delivered against them."""

import hashlib
import json
import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.config import CLAIM180, PILOT60, Profile

IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
REVISION = re.compile(r"[0-9a-f]{40,64}")
ROLES = ("development", "held_out")
STATUSES = ("valid", "invalid", "startup_failed", "missing")


class LockError(ValueError):
    """A plan, lock or collection that breaks a rule."""


def _require(ok: bool, text: str) -> None:
    if not ok:
        raise LockError(text)


def canonical(value: object) -> bytes:
    """JSON with sorted keys and no blanks, as UTF-8: the bytes that fingerprints are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def fingerprint(value: dict, without: tuple[str, ...] = ()) -> str:
    return hashlib.sha256(canonical({k: v for k, v in value.items() if k not in without})).hexdigest()


def file_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes and sha256 of files of any size, read by the executors.

    Files on a file system that every executor sees (file:) are read in pieces of 1 MiB; of other stores up to 2 GB at once, as Spark reads binary files.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            digests = []
            for path in f["path"]:
                digest = hashlib.sha256()
                with open(unquote(path.removeprefix("file:")), "rb") as file:
                    while piece := file.read(1 << 20):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield f.assign(sha256=digests)

    near = listed.where(F.col("path").startswith("file:")).mapInPandas(run, "path string, bytes long, sha256 string")
    far = spark.read.format("binaryFile").load(paths).where(~F.col("path").startswith("file:")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return near.unionByName(far)


def verify(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """expected (key, bytes, sha256) held against actual: exists, bytes_match, hash_match, valid."""
    a = actual.select(*key, F.col("bytes").alias("_b"), F.col("sha256").alias("_h"), F.lit(True).alias("_there"))
    rows = expected.join(a, key, "left")
    exists, size, digest = F.coalesce("_there", F.lit(False)), F.coalesce(F.col("_b") == F.col("bytes"), F.lit(False)), F.coalesce(F.col("_h") == F.col("sha256"), F.lit(False))
    return rows.select(*key, exists.alias("exists"), size.alias("bytes_match"), digest.alias("hash_match"), (exists & size & digest).alias("valid"))


def all_valid(checks: DataFrame, by: list[str]) -> DataFrame:
    return checks.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("failed"), F.bool_and("valid").alias("valid"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """Rows per collection status, those without rows as 0."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], f"{status} string")
    return wanted.join(rows.groupBy(status).agg(F.count(F.lit(1)).alias("_n")), status, "left").select(status, F.coalesce("_n", F.lit(0).cast("long")).alias("rows"))


def count_mismatches(counted: DataFrame, declared: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose counted and declared numbers differ; a key that one side lacks counts as 0 there."""
    b = declared.select(key, F.col(value).alias("_d"))
    rows = counted.select(key, F.col(value).alias("_c")).join(b, key, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(key, zero("_c").alias("counted"), zero("_d").alias("declared")).where("counted <> declared")


def slot_templates(events: DataFrame, slot: str, candidate: str, template: list[str], per_candidate: int) -> DataFrame:
    """Per slot: its candidates, whether each has the given number of distinct target events, and whether all have the same template."""
    shape = F.sort_array(F.collect_list(F.struct(*template)))
    each = events.groupBy(slot, candidate).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(*template).alias("_u"), F.sha2(F.to_json(shape), 256).alias("_shape"))
    return each.groupBy(slot).agg(
        F.count(F.lit(1)).alias("candidates"), F.bool_and((F.col("_n") == per_candidate) & (F.col("_u") == F.col("_n"))).alias("complete"), F.count_distinct("_shape").alias("templates"),
    ).withColumn("balanced", F.col("complete") & (F.col("templates") == 1))


def exactly_one(targets: DataFrame, actions: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Targets held against action rows: matches (rows with the keys that are ok), valid when there is exactly one."""
    hits = actions.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = targets.join(hits, keys, "left").withColumn("matches", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")
    return rows.withColumn("valid", F.col("matches") == 1)


# --- plans, on the driver: single small documents -------------------------------------------------------------------


def read_object(path: Path | str, what: str) -> dict:
    path = Path(path)
    _require(path.is_file(), f"{what} does not exist: {path}")
    try:
        value = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise LockError(f"{what} is not valid JSON: {e}") from e
    _require(isinstance(value, dict), f"{what} must be an object")
    return value


def write_object(path: Path | str, value: dict) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def inside(root: Path, relative: str) -> Path:
    """A path that must not leave its folder."""
    target = (root / relative).resolve()
    _require(target.is_relative_to(root.resolve()), f"{relative} leaves {root}")
    return target


def file_contract(root: Path, relative: str) -> dict:
    data = inside(root, relative).read_bytes()
    return {"path": relative, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def check_plan(plan: dict, profile: Profile = CLAIM180) -> None:
    """A held-out plan: known ids, targets of the profile, sources in the order of the ids, a full revision."""
    _require(plan.get("schema_version") == 1, "plan schema_version must be 1")
    for f in ("protocol_id", "protocol_repository", "protocol_revision"):
        _require(isinstance(plan.get(f), str) and bool(plan[f].strip()), f"plan {f} is missing")
    _require(bool(REVISION.fullmatch(plan["protocol_revision"])), "protocol_revision must be a full revision")
    ids = plan.get("case_ids")
    _require(isinstance(ids, list) and all(isinstance(i, str) and IDENTIFIER.fullmatch(i) for i in ids), "case_ids must be identifiers")
    _require(len(ids) >= profile.min_cases and len(set(ids)) == len(ids), "case_ids must be unique and enough")
    _require(plan.get("category_targets") == profile.targets, f"category_targets must be those of {profile.name}")
    sources = plan.get("workflow_sources")
    _require(isinstance(sources, list) and [s.get("case_id") for s in sources] == ids, "workflow_sources must follow case_ids")
    _require(all(str(s.get("url", "")).startswith("https://") for s in sources), "workflow sources must be https")
    if (selection := plan.get("collection_selection")) is not None:
        check_selection(selection, ids, profile)


def check_selection(selection: dict, ids: list[str], profile: Profile) -> None:
    """Which of the cases will count: the first valid ones in order, or the first valid one of each slot."""
    mode, wanted = selection.get("mode"), selection.get("required_valid_cases")
    _require(mode in ("first_valid_in_plan_order", "first_valid_per_slot_in_plan_order"), "unknown selection mode")
    _require(isinstance(wanted, int) and profile.min_cases <= wanted <= len(ids), "required_valid_cases is out of range")
    if mode == "first_valid_per_slot_in_plan_order":
        slots = selection.get("slots")
        _require(isinstance(slots, list) and len(slots) == wanted, "there must be one slot per required case")
        members = [c for s in slots for c in s.get("candidate_case_ids", [])]
        _require(sorted(members) == sorted(ids), "slots must partition the cases")
        _require(all(len(s["candidate_case_ids"]) >= 2 for s in slots), "a slot needs at least two candidates")


def preregister(plan_path: Path | str, out: Path | str) -> dict:
    """Lock a plan before anything is collected: its file's hash, its content, and a fingerprint that leaves the time of day out."""
    plan = read_object(plan_path, "plan")
    check_plan(plan)
    place, root = Path(plan_path).resolve(), Path(out).resolve().parent
    contract = file_contract(place.parent, place.name) | {"path": os.path.relpath(place, root)}
    lock = {"schema_version": 1, "kind": "held_out_preregistration", "plan": contract, "content": plan, "created_at_utc": datetime.now(UTC).isoformat()}
    lock["preregistration_id"] = fingerprint(lock, ("created_at_utc", "preregistration_id"))
    write_object(out, lock)
    return lock


def preregister_supplement(base: Path | str, deficits: dict[str, int], targets: list[dict], out: Path | str, evidence: dict | None = None) -> dict:
    """Lock a supplement for categories that fell short; only failed actions and loading may be collected again, and no output may have been seen."""
    lock = read_object(base, "preregistration")
    _require(lock.get("kind") == "held_out_preregistration", "the base must be a preregistration")
    _require(set(deficits) <= {"action_failure", "loading_completion"} and all(v > 0 for v in deficits.values()), "a supplement covers failed actions and loading only")
    _require(not lock.get("model_outputs_seen", False), "model outputs have been seen")
    if evidence is not None:
        _require(supplement_base(Path(base).resolve().parent, evidence) == deficits, "the deficits are not those of the base inventory")
    have: dict[str, int] = {}
    for t in targets:
        have[t["category"]] = have.get(t["category"], 0) + 1
    _require(all(have.get(c, 0) >= n for c, n in deficits.items()), "the targets do not cover the deficits")
    value = {"schema_version": 1, "kind": "held_out_supplement", "base": lock["preregistration_id"], "deficits": deficits, "targets": targets, "model_outputs_seen": False, "created_at_utc": datetime.now(UTC).isoformat()}
    value["supplement_id"] = fingerprint(value, ("created_at_utc", "supplement_id"))
    write_object(out, value)
    return value


def preregistration_problems(path: Path | str, spark: SparkSession | None = None) -> list[str]:
    """What is wrong with a preregistration today: its id, its kind, the plan's file and content, and the files that the plan names."""
    lock = read_object(path, "preregistration")
    root = Path(path).resolve().parent
    problems = []
    if lock.get("kind") != "held_out_preregistration":
        problems.append("unknown kind")
    if lock.get("preregistration_id") != fingerprint(lock, ("created_at_utc", "preregistration_id")):
        problems.append("fingerprint is invalid")
    try:
        place = (root / lock["plan"]["path"]).resolve()
        if file_contract(place.parent, place.name) | {"path": lock["plan"]["path"]} != lock["plan"]:
            problems.append("plan file was changed")
        plan = read_object(place, "plan")
        check_plan(plan)
        if plan != lock["content"]:
            problems.append("plan differs from the locked one")
        if plan.get("actions_manifest") is not None:
            spark = spark or SparkSession.active()
            files = actions_manifest(spark, place.parent, plan["actions_manifest"], plan["case_ids"])
            if plan.get("target_events") is not None:
                wrong = target_problems(action_table(spark, files), target_table(spark, plan)).limit(1).collect()
                problems += [f"target event: {r['problem']}" for r in wrong]
    except (LockError, OSError, KeyError) as e:
        problems.append(str(e))
    return problems


def verify_preregistration(path: Path | str, spark: SparkSession | None = None) -> bool:
    return not preregistration_problems(path, spark)


def actions_manifest(spark: SparkSession, root: Path, reference: dict, case_ids: list[str]) -> dict[str, Path]:
    """The action file of each case, from a manifest that must be as declared, name the cases of the plan in its order, and whose files must all be as declared."""
    path = inside(root, reference["path"])
    _require(path.is_file() and file_contract(root, reference["path"]) == {k: reference[k] for k in ("path", "bytes", "sha256")}, "actions manifest integrity check failed")
    manifest = read_object(path, "actions manifest")
    _require(manifest.get("schema_version") == 1, "actions manifest schema_version must be 1")
    _require(bool(REVISION.fullmatch(str(manifest.get("collector_revision", "")).lower())), "collector_revision must be a full revision")
    rows = manifest.get("cases", [])
    _require([r.get("case_id") for r in rows] == case_ids, "the actions manifest must name the cases of the plan in its order")
    files = {r["case_id"]: inside(path.parent, r["action_file"]) for r in rows}
    _require(all(f.is_file() for f in files.values()), "an action file is missing")
    expected = spark.createDataFrame([(f"file:{files[r['case_id']]}", r["bytes"], r["sha256"]) for r in rows], "path string, bytes long, sha256 string")
    broken = verify(expected, file_facts(spark, sorted({str(f) for f in files.values()})), ["path"]).where("not valid").limit(1).collect()
    _require(not broken, f"action file integrity check failed: {broken[0]['path'] if broken else ''}")
    return files


_ACTION = "struct<id: string, type: string, required: boolean, expected_outcome: string, expected_result: string>"


def action_table(spark: SparkSession, files: dict[str, Path]) -> DataFrame:
    """The actions of action files: case_id, action_id, type, required, expected_outcome, expected_result."""
    paths = spark.createDataFrame([(c, f"file:{p}") for c, p in files.items()], "_case string, path string")
    texts = spark.read.text([str(p) for p in files.values()], wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    texts = texts.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(paths, "path")
    parsed = texts.select("_case", F.from_json("value", f"case_id string, actions array<{_ACTION}>").alias("f"))
    rows = parsed.select(F.col("_case").alias("case_id"), F.explode("f.actions").alias("a"))
    return rows.select("case_id", F.col("a.id").alias("action_id"), "a.type", F.coalesce("a.required", F.lit(True)).alias("required"), F.coalesce("a.expected_outcome", F.lit("success")).alias("expected_outcome"), "a.expected_result")


def target_table(spark: SparkSession, plan: dict) -> DataFrame:
    """The target events of a plan: case_id, slot_id, action_id, category, expected_result."""
    rows = [(r["case_id"], r.get("slot_id"), e["action_id"], e["category"], e.get("expected_result")) for r in plan["target_events"] for e in r.get("events", [r])]
    return spark.createDataFrame(rows, "case_id string, slot_id string, action_id string, category string, expected_result string")


def target_problems(actions: DataFrame, targets: DataFrame) -> DataFrame:
    """What is wrong with target events, a row per problem: case_id, action_id, problem.

    A target must name exactly one action of its case, which must be required; a failure is expected of it exactly if its category is action_failure; the
    result expected must be the action's, where the target states one; a loading target must wait, and succeed. One join by (case, action).
    """
    found = actions.groupBy("case_id", "action_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("required").alias("_required"), F.max("expected_outcome").alias("_outcome"), F.max("expected_result").alias("_result"), F.max("type").alias("_type")
    )
    rows = targets.join(found, ["case_id", "action_id"], "left")
    failure = F.col("category") == "action_failure"
    rules = {
        "action is missing or duplicated": F.coalesce(F.col("_n"), F.lit(0)) != 1,
        "action is not required": ~F.col("_required"),
        "outcome does not fit the category": failure != (F.col("_outcome") == "failure"),
        "expected result differs": F.col("expected_result").isNotNull() & ~F.col("expected_result").eqNullSafe(F.col("_result")),
        "loading target must wait and succeed": (F.col("category") == "loading_completion") & ((F.col("_type") != "wait_for") | (F.col("_outcome") != "success")),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), text) for text, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.select("case_id", "action_id", F.explode(broken).alias("problem"))


# The three files that a supplement rests on, with the field of their identity and the time that it leaves out.
BASE_EVIDENCE = {"preregistration": ("preregistration_id", "created_at_utc"), "collection_summary": ("collection_id", "generated_at_utc"), "event_inventory": ("inventory_id", None)}


def supplement_base(root: Path, evidence: dict) -> dict[str, int]:
    """The deficits that a supplement may fill, from three files that must be as declared, be what their identity says, belong to each other, and whose inventory
    was taken before any model output was seen."""
    _require(isinstance(evidence, dict) and set(evidence) == set(BASE_EVIDENCE), f"base evidence must name {sorted(BASE_EVIDENCE)}")
    files = {}
    for name, (identity, time) in BASE_EVIDENCE.items():
        declared = evidence[name]
        _require(file_contract(root, declared["path"]) == {k: declared[k] for k in ("path", "bytes", "sha256")}, f"base {name} integrity check failed")
        files[name] = read_object(inside(root, declared["path"]), f"base {name}")
        actual = fingerprint(files[name], tuple(c for c in (identity, time) if c))
        _require(files[name].get(identity) == actual == declared["identity"], f"base {name} fingerprint is invalid")
    chain = (("collection_summary", "preregistration", "preregistration_id"), ("event_inventory", "collection_summary", "collection_id"))
    for later, earlier, key in chain:
        _require(files[later].get(key) == files[earlier].get(key), f"base {later} does not belong to the base {earlier}")
    _require(files["event_inventory"].get("model_outputs_seen") is False, "model outputs have been seen")
    return files["event_inventory"]["supplement_deficits"]


def freeze(spark: SparkSession, manifest: Path | str, audit: dict, role: str, out: Path | str, preregistration: Path | str | None = None) -> dict:
    """Lock a manifest, the videos it names (hashed by the executors) and its audit. Held-out sets need a preregistration that is older and holds."""
    _require(role in ROLES, f"role must be one of {ROLES}")
    manifest = Path(manifest).resolve()
    content = read_object(manifest, "manifest")
    profile = CLAIM180 if role == "held_out" else PILOT60
    _require(audit.get("profile") == profile.name, f"a {role} set is audited with {profile.name}")
    if role == "held_out":
        _require(preregistration is not None and verify_preregistration(preregistration, spark), "a held-out set needs a valid preregistration")
        _require(os.path.getmtime(preregistration) <= os.path.getmtime(manifest), "the preregistration must be older than the manifest")
    videos = sorted({c["video"] for c in content.get("cases", [])})
    paths = [inside(manifest.parent, v) for v in videos]
    facts = {r["path"].removeprefix("file:"): r for r in file_facts(spark, [str(p) for p in paths]).toLocalIterator()} if paths else {}
    missing = [v for v, p in zip(videos, paths) if str(p) not in facts]
    _require(not missing, f"videos are missing: {missing}")
    files = [{"path": v, "bytes": facts[str(p)]["bytes"], "sha256": facts[str(p)]["sha256"]} for v, p in zip(videos, paths)]
    lock = {"schema_version": 1, "kind": "frozen_manifest", "role": role, "manifest": file_contract(manifest.parent, manifest.name), "content": content, "videos": files, "audit": audit, "created_at_utc": datetime.now(UTC).isoformat()}
    if preregistration is not None:
        lock["preregistration"] = read_object(preregistration, "preregistration")
    lock["freeze_id"] = fingerprint(lock, ("created_at_utc", "freeze_id"))
    write_object(out, lock)
    return lock


def verify_freeze(spark: SparkSession, path: Path | str, root: Path | str) -> dict:
    """Whether a lock and all files it names are as they were. The id is computed anew, not believed."""
    lock = read_object(path, "freeze")
    root = Path(root).resolve()
    wanted = [lock["manifest"], *lock["videos"]]
    there = [f for f in wanted if inside(root, f["path"]).is_file()]
    expected = spark.createDataFrame([(f"file:{inside(root, f['path'])}", f["bytes"], f["sha256"]) for f in wanted], "path string, bytes long, sha256 string")
    actual = file_facts(spark, [str(inside(root, f["path"])) for f in there]) if there else expected.limit(0)
    checks = verify(expected, actual, ["path"]).collect()  # one row per file of the lock
    same = lock.get("freeze_id") == fingerprint(lock, ("created_at_utc", "freeze_id"))
    return {"valid": same and all(c["valid"] for c in checks), "role": lock["role"], "freeze_id": lock["freeze_id"], "identity": same, "files": [c.asDict() for c in checks]}


# --- what a collection delivered ------------------------------------------------------------------------------------


def collection_problems(cases: DataFrame, artifacts: DataFrame, plan: DataFrame) -> DataFrame:
    """What is wrong with a collection, a row per problem: case_id, problem.

    cases: case_id, status. artifacts: case_id, kind ('capture', 'verification', 'failure'), valid (its file is as declared). plan: case_id, position.
    Every planned case must be there once and no other; a valid case needs a capture and a verification, any other but a missing one a
    failure; every file must be valid, and a missing case has none.
    """
    named = lambda df, text: df.select("case_id", F.lit(text).alias("problem"))
    have = artifacts.groupBy("case_id").agg(F.collect_set("kind").alias("kinds"), F.bool_and("valid").alias("intact"))
    rows = cases.join(have, "case_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    full = F.array_contains("kinds", "capture") & F.array_contains("kinds", "verification")
    status = F.col("status")
    found = (
        (cases.groupBy("case_id").count().where("count > 1"), "case is listed more than once"),
        (plan.join(cases, "case_id", "left_anti"), "planned case is not listed"),
        (cases.join(plan, "case_id", "left_anti"), "case is not in the plan"),
        (rows.where(~F.coalesce(status.isin(*STATUSES), F.lit(False))), "unknown status"),
        (rows.where((status == "valid") & ~full), "valid case lacks an artifact"),
        (rows.where(status.isin("invalid", "startup_failed") & ~F.array_contains("kinds", "failure")), "failed case lacks its failure artifact"),
        (rows.where((status == "missing") & (F.size("kinds") > 0)), "missing case has artifacts"),
        (rows.where(~F.col("intact")), "artifact integrity failed"),
    )
    out = None
    for df, text in found:
        out = named(df, text) if out is None else out.unionByName(named(df, text))
    return out


def selected_cases(cases: DataFrame, plan: DataFrame, mode: str, wanted: int) -> DataFrame:
    """The cases that count, in plan order: the first valid ones, or the first valid one of each slot. plan: case_id, position, slot."""
    rows = plan.join(cases.where("status = 'valid'").select("case_id").distinct(), "case_id", "left_semi")
    if mode == "first_valid_in_plan_order":
        return rows.orderBy("position").limit(wanted).select("case_id", "position")
    best = rows.groupBy("slot").agg(F.min(F.struct("position", "case_id")).alias("_b"))
    return best.select(F.col("_b.case_id").alias("case_id"), F.col("_b.position").alias("position"))
