"""Comparisons of systems, collections and locks. Orders stand for events of a workflow (the customer), run costs come from line items.

All comparisons take the default number of samples; claim_seeded draws with Python's generator, the others by hash."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.catalog.selection import CASES, LABELS
from framegate.config import Requirements
from framegate.operators import claims, locks, select
from framegate.sources.streams import case_videos, labels
from framegate.sources.tables import table

SAMPLES, SEED = Requirements().bootstrap_samples, 7


def _system(spark: SparkSession, folder: str, success, false_confirmation, workflow) -> DataFrame:
    o = table(spark, folder, "orders")
    category = F.when(F.col("o_orderpriority").startswith("1"), "action_failure").otherwise("other")
    return o.select(F.col("o_orderkey").alias("event_id"), workflow.alias("workflow_id"), category.alias("category"), success.alias("success"), false_confirmation.alias("false_confirmation"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    workflow = F.col("o_custkey")
    candidate = _system(spark, folder, F.col("o_orderstatus") != "P", F.col("o_orderkey") % 50 == 0, workflow)
    baseline = _system(spark, folder, F.col("o_totalprice") < 200000, F.col("o_orderkey") % 20 == 0, workflow)
    return claims.paired(candidate, baseline)


def paired_systems(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder)
    return p.groupBy("category").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("success").alias("candidate"), F.count_if("base_success").alias("baseline"), F.count_distinct("workflow_id").alias("workflows")
    )


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"))
    items = table(spark, folder, "lineitem").where("l_linenumber >= 2").select(F.col("l_orderkey").alias("event_id")).distinct()
    out = claims.coverage_gaps(items, o.where("event_id % 3 <> 0"))
    return out.groupBy("side").agg(F.count(F.lit(1)).alias("events"), F.array_join(select.head_of_set(F.col("event_id")), ",").alias("first"))


def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    sums = claims.cluster_sums(_pairs(spark, folder), F.col("success").cast("int") - F.col("base_success").cast("int"))
    out = claims.interval95(claims.hashed_draws(sums, SAMPLES, SEED))
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def claim_comparison(spark: SparkSession, folder: str) -> DataFrame:
    out = claims.compare_systems(_pairs(spark, folder), Requirements(bootstrap_samples=SAMPLES, bootstrap_seed=SEED), claims.hashed_draws)
    numbers = ["candidate_accuracy", "baseline_accuracy", "accuracy_difference", "accuracy_low", "accuracy_high", "candidate_false_confirmation_rate", "baseline_false_confirmation_rate", "false_confirmation_low", "false_confirmation_high"]
    flags = ["accuracy_superiority", "accuracy_noninferiority", "false_confirmation_noninferiority", "enough_samples", "superiority_claim_supported"]
    return out.select("events", "workflows", "action_failures", *[F.round(n, 6).alias(n) for n in numbers], *flags, F.array_join("reasons", "; ").alias("reasons"))


def claim_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison whole: a customer is a workflow, the default number of samples, Python's generator for the draws; rows only."""
    out = claims.compare_systems(_pairs(spark, folder), Requirements())
    return out.select("events", "accuracy_low", "accuracy_high", "superiority_claim_supported")


def cost_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer segment, costs by line number: shipped in rail mode against the rest stands for two systems."""
    i = table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    runs = i.groupBy((F.col("l_suppkey") % 25).alias("pair"), F.when(F.col("l_returnflag") == "R", "candidate").otherwise("baseline").alias("system"), F.col("l_linenumber").alias("position")).agg((F.sum(cents) / 100).alias("cost"))
    runs = runs.withColumn("basis", F.when(F.col("pair") % 5 == 0, "estimate").otherwise("provider_invoice"))
    out = claims.cost_ratio(runs)
    return out.select("pair", "candidate_runs", "baseline_runs", "ratios", F.round("max_ratio", 6).alias("max_ratio"), F.round("median_ratio", 6).alias("median_ratio"), "accepted_basis", "enough_runs", "material_reduction")


def frozen_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder).join(case_videos(spark, folder), "case_id", "left")
    return claims.frozen_evidence(rows.select(F.col("video_path").alias("video"), "transition", F.col("real_world_eligible").alias("eligible")))


def first_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Parts stand for collected cases in plan order, those over size 25 for valid ones."""
    return select.first_valid(table(spark, folder, "part"), F.col("p_size") > 25, ["p_partkey"], 30).select("p_partkey", "p_brand")


def first_valid_per_slot(spark: SparkSession, folder: str) -> DataFrame:
    return select.first_valid_per_slot(table(spark, folder, "part"), "p_brand", "p_partkey", F.col("p_size") > 25, "p_partkey")


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(F.when(size > 25, "valid").when(size > 10, "invalid").otherwise("startup_failed").alias("status"))
    return locks.status_counts(rows, "status")


def count_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Labels per category against the labels of high risk and up, as a count that differs from its declaration."""
    rows = labels(spark, folder)
    count = lambda d: d.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return locks.count_mismatches(count(rows), count(rows.where("risk <> 'low'")), "category", "n")


def slot_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Nations stand for slots, suppliers for candidates, account-balance bands for target events."""
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("slot"), F.col("s_suppkey").alias("candidate"), F.explode(F.array(F.floor(F.col("s_acctbal") / 4000), F.lit(77).cast("long"))).alias("target"))
    return locks.slot_templates(s, "slot", "candidate", ["target"], 2)


def _collection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as collected cases: some without artifacts, some with a broken one, a few beyond the plan or left out."""
    p = table(spark, folder, "part").withColumn("case_id", F.col("p_partkey").cast("string"))
    status = F.when(F.col("p_size") > 25, "valid").when(F.col("p_size") > 10, "invalid").when(F.col("p_size") > 5, "startup_failed").otherwise("missing")
    cases = p.where("p_partkey % 89 <> 0").select("case_id", status.alias("status"))
    kinds = F.when(F.col("p_size") > 25, F.array(F.lit("capture"), F.lit("verification"))).when(F.col("p_size") > 5, F.array(F.lit("failure"))).otherwise(F.array().cast("array<string>"))
    kinds = F.when(F.col("p_partkey") % 31 == 0, F.slice(kinds, 1, 1)).otherwise(kinds)
    artifacts = p.select("case_id", F.explode(kinds).alias("kind"), (F.col("p_partkey") % 43 != 0).alias("valid"))
    plan = p.where("p_partkey % 97 <> 0").select("case_id", F.col("p_partkey").alias("position"), F.col("p_brand").alias("slot"))
    return cases, artifacts, plan


def collection_problems(spark: SparkSession, folder: str) -> DataFrame:
    return locks.collection_problems(*_collection(spark, folder))


def selected_by_slot(spark: SparkSession, folder: str) -> DataFrame:
    cases, _, plan = _collection(spark, folder)
    return locks.selected_cases(cases, plan, "first_valid_per_slot_in_plan_order", 0)


def selected_in_order(spark: SparkSession, folder: str) -> DataFrame:
    cases, _, plan = _collection(spark, folder)
    return locks.selected_cases(cases, plan, "first_valid_in_plan_order", 30)


def exactly_one(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    actions = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag")
    out = locks.exactly_one(targets, actions, ["key"], F.col("l_returnflag") == "R")
    return out.groupBy("matches", "valid").agg(F.count(F.lit(1)).alias("targets"))


def hash_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Texts stand for files; every 97th was changed, every 101st is gone."""
    d = table(spark, folder, "documents").where("text is not null")
    facts = lambda text: [F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256")]
    expected = d.select("doc_id", *facts(F.col("text")))
    changed = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = d.where("doc_id % 101 <> 0").select("doc_id", *facts(changed))
    return locks.verify(expected, actual, ["doc_id"])


def hash_verify_sources(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "source")
    return locks.all_valid(hash_verify(spark, folder).join(d, "doc_id"), ["source"])


QUERIES = {f.__name__: f for f in (
    paired_systems, coverage_gaps, bootstrap_interval, claim_comparison, claim_seeded, cost_ratios, frozen_evidence, first_valid, first_valid_per_slot, status_counts, count_mismatches,
    slot_templates, collection_problems, selected_by_slot, selected_in_order, exactly_one, hash_verify, hash_verify_sources,
)}

_PAIRS = """SELECT o_orderkey AS event_id, o_custkey AS workflow_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'action_failure' ELSE 'other' END AS category, o_orderstatus <> 'P' AS success, o_orderkey % 50 = 0 AS fc, o_totalprice < 200000 AS base_success, o_orderkey % 20 = 0 AS base_fc FROM orders"""


def _interval_sql(where: str, value: str, seed: int) -> str:
    return f"""(WITH u AS (SELECT workflow_id, sum({value}) AS total, count(*) AS members, row_number() OVER (ORDER BY workflow_id) AS no FROM ({_PAIRS}) WHERE {where} GROUP BY workflow_id), n AS (SELECT count(*) AS n FROM u),
 s AS (SELECT unnest(range(1, (SELECT n FROM n) + 1)) AS slot), d AS (SELECT unnest(range(1, {SAMPLES} + 1)) AS b), x0 AS (SELECT b, (b * 8191 + slot * 131071 + {seed * 1000003})::BIGINT % {claims.PRIME} AS v FROM d, s),
 {" ".join(f"x{i + 1} AS (SELECT b, (v * v + v * {k} + {c}) % {claims.PRIME} AS v FROM x{i})," for i, (k, c) in enumerate(claims.ROUNDS))} x AS (SELECT b, v % (SELECT n FROM n) + 1 AS no FROM x{len(claims.ROUNDS)}),
 m AS (SELECT b, sum(total) / sum(members) AS mean FROM x JOIN u USING (no) GROUP BY b) SELECT {{'low': coalesce(round(quantile_cont(mean, 0.025), 6), 0), 'high': coalesce(round(quantile_cont(mean, 0.975), 6), 0)}} FROM m)"""


_HASHED = """SELECT doc_id, source, doc_id % 101 <> 0 AS "exists", doc_id % 101 <> 0 AND doc_id % 97 <> 0 AS bytes_match, doc_id % 101 <> 0 AND sha256(text) = sha256(CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END) AS hash_match FROM documents WHERE text IS NOT NULL"""
_COLLECTION = """WITH p AS (SELECT *, p_partkey::VARCHAR AS case_id, CASE WHEN p_size > 25 THEN 'valid' WHEN p_size > 10 THEN 'invalid' WHEN p_size > 5 THEN 'startup_failed' ELSE 'missing' END AS status FROM part),
c AS (SELECT case_id, status FROM p WHERE p_partkey % 89 <> 0), l AS (SELECT case_id, p_partkey AS position, p_brand AS slot FROM p WHERE p_partkey % 97 <> 0),
k AS (SELECT case_id, CASE WHEN p_partkey % 31 = 0 THEN ['capture'] ELSE ['capture', 'verification'] END AS kinds, p_partkey % 43 <> 0 AS intact FROM p WHERE p_size > 25 UNION ALL SELECT case_id, ['failure'], p_partkey % 43 <> 0 FROM p WHERE p_size BETWEEN 6 AND 25),
r AS (SELECT c.*, coalesce(kinds, []) AS kinds, intact FROM c LEFT JOIN k USING (case_id))
"""
_DIFF, _FC = "success::INT - base_success::INT", "fc::INT - base_fc::INT"
SQL = {
    "paired_systems": f"SELECT category, count(*) AS events, count(*) FILTER (success) AS candidate, count(*) FILTER (base_success) AS baseline, count(DISTINCT workflow_id) AS workflows FROM ({_PAIRS}) GROUP BY category",
    "coverage_gaps": """WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber >= 2), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0),
g AS (SELECT 'missing' AS side, k FROM f ANTI JOIN e USING (k) UNION ALL SELECT 'extra', k FROM e ANTI JOIN f USING (k)) SELECT side, count(*) AS events, array_to_string(list_slice(list_sort(list(DISTINCT k)), 1, 10), ',') AS first FROM g GROUP BY side""",
    "bootstrap_interval": f"SELECT i.low AS low, i.high AS high FROM (SELECT {_interval_sql('true', _DIFF, SEED)} AS i)",
    "claim_comparison": f"""WITH p AS ({_PAIRS}), a AS (SELECT count(*) AS events, count(DISTINCT workflow_id) AS workflows, count(*) FILTER (category = 'action_failure') AS action_failures, avg(success::INT) AS ca, avg(base_success::INT) AS ba,
 avg(fc::INT) FILTER (category = 'action_failure') AS cf, avg(base_fc::INT) FILTER (category = 'action_failure') AS bf FROM p), i AS (SELECT {_interval_sql("true", _DIFF, SEED)} AS a, {_interval_sql("category = 'action_failure'", _FC, SEED + 1)} AS f),
z AS (SELECT events, workflows, action_failures, round(ca, 6) AS candidate_accuracy, round(ba, 6) AS baseline_accuracy, round(ca - ba, 6) AS accuracy_difference, i.a.low AS accuracy_low, i.a.high AS accuracy_high, round(cf, 6) AS candidate_false_confirmation_rate,
 round(bf, 6) AS baseline_false_confirmation_rate, i.f.low AS false_confirmation_low, i.f.high AS false_confirmation_high FROM a, i),
y AS (SELECT *, accuracy_low > 0 AS accuracy_superiority, accuracy_low >= -0.03 AS accuracy_noninferiority, false_confirmation_high <= 0.01 AS false_confirmation_noninferiority, events >= 180 AND workflows >= 30 AND action_failures >= 20 AS enough_samples FROM z)
SELECT *, accuracy_superiority AND false_confirmation_noninferiority AND enough_samples AS superiority_claim_supported, concat_ws('; ', CASE WHEN events < 180 THEN 'too few paired events' END, CASE WHEN workflows < 30 THEN 'too few independent workflows' END,
 CASE WHEN action_failures < 20 THEN 'too few failed-action events' END, CASE WHEN NOT (accuracy_superiority AND false_confirmation_noninferiority) THEN 'accuracy superiority was not established' END) AS reasons FROM y""",
    "cost_ratios": """WITH r AS (SELECT l_suppkey % 25 AS pair, l_linenumber, sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_returnflag = 'R') / 100 AS c, sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_returnflag <> 'R') / 100 AS b FROM lineitem GROUP BY 1, 2),
g AS (SELECT pair, count(c) AS candidate_runs, count(b) AS baseline_runs, count(c / b) FILTER (b > 0) AS ratios, max(c / b) FILTER (b > 0) AS mx, median(c / b) FILTER (b > 0) AS md, pair % 5 <> 0 AS accepted_basis FROM r GROUP BY pair)
SELECT pair, candidate_runs, baseline_runs, ratios, round(mx, 6) AS max_ratio, round(md, 6) AS median_ratio, accepted_basis, candidate_runs >= 3 AND baseline_runs >= 3 AS enough_runs, coalesce(accepted_basis AND candidate_runs >= 3 AND baseline_runs >= 3 AND ratios >= 3 AND mx <= 0.7, false) AS material_reduction FROM g""",
    "frozen_evidence": f"""WITH e AS (SELECT k.video_path AS video, transition FROM ({LABELS}) l LEFT JOIN ({CASES}) k USING (case_id) WHERE real_world_eligible)
SELECT count(*) AS events, count(DISTINCT video) AS unique_video_count, count(DISTINCT transition) AS unique_transition_count, (SELECT count(*) FROM (SELECT transition FROM e WHERE transition IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_transition_count FROM e""",
    "first_valid": "SELECT p_partkey, p_brand FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 30",
    "first_valid_per_slot": "SELECT p_brand, min(p_partkey) FILTER (p_size > 25) AS p_partkey, count(*) FILTER (p_size > 25) AS valid_rows FROM part GROUP BY p_brand",
    "status_counts": """SELECT status, count(p_partkey) AS rows FROM (VALUES ('valid'), ('invalid'), ('startup_failed'), ('missing')) v(status) LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'valid' WHEN p_size > 10 THEN 'invalid' ELSE 'startup_failed' END AS status FROM part) USING (status) GROUP BY status""",
    "count_mismatches": f"SELECT category, count(*) AS counted, count(*) FILTER (risk <> 'low') AS declared FROM ({LABELS}) GROUP BY category HAVING count(*) <> count(*) FILTER (risk <> 'low')",
    "slot_templates": """WITH c AS (SELECT s_nationkey AS slot, s_suppkey, count(*) AS n, count(DISTINCT t) AS u, array_to_string(list_sort(list(t)), ',') AS shape FROM (SELECT s_nationkey, s_suppkey, unnest([floor(s_acctbal / 4000)::BIGINT, 77]) AS t FROM supplier) GROUP BY 1, 2)
SELECT slot, count(*) AS candidates, bool_and(n = 2 AND u = n) AS complete, count(DISTINCT shape) AS templates, bool_and(n = 2 AND u = n) AND count(DISTINCT shape) = 1 AS balanced FROM c GROUP BY slot""",
    "collection_problems": _COLLECTION + """SELECT case_id, 'planned case is not listed' AS problem FROM l ANTI JOIN c USING (case_id) UNION ALL SELECT case_id, 'case is not in the plan' FROM c ANTI JOIN l USING (case_id)
UNION ALL SELECT case_id, 'valid case lacks an artifact' FROM r WHERE status = 'valid' AND len(kinds) < 2 UNION ALL SELECT case_id, 'artifact integrity failed' FROM r WHERE NOT intact""",
    "selected_by_slot": _COLLECTION + "SELECT arg_min(case_id, position) AS case_id, min(position) AS position FROM l SEMI JOIN (SELECT * FROM c WHERE status = 'valid') USING (case_id) GROUP BY slot",
    "selected_in_order": _COLLECTION + "SELECT case_id, position FROM l SEMI JOIN (SELECT * FROM c WHERE status = 'valid') USING (case_id) ORDER BY position LIMIT 30",
    "exactly_one": "SELECT matches, matches = 1 AS valid, count(*) AS targets FROM (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') AS matches FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY matches",
    "hash_verify": f'SELECT doc_id, "exists", bytes_match, hash_match, "exists" AND bytes_match AND hash_match AS valid FROM ({_HASHED})',
    "hash_verify_sources": f"SELECT source, count(*) AS files, count(*) FILTER (NOT hash_match) AS failed, bool_and(hash_match) AS valid FROM ({_HASHED}) GROUP BY source",
}
