"""Sample matching target category proportions."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegate.functions.text import vocabulary_key
from framegate.plans.durable import durable
from framegate.plans.order import with_place

_REPORT = (
    "profile_id string, target_id long, category string, risk string, needed long, existing long, own long, from_siblings long, from_cousins long, "
    "short long, kind string, cell_category string, cell_risk string, first long, last long"
)


def leaves(records: DataFrame, category: str, risk: str, category_default: str = "other", risk_default: str = "normal") -> DataFrame:
    """records with `leaf_category` and `leaf_risk`: spellings brought together, null as the default."""
    return records.withColumns({"leaf_category": F.coalesce(vocabulary_key(F.col(category)), F.lit(category_default)), "leaf_risk": F.coalesce(vocabulary_key(F.col(risk)), F.lit(risk_default))})


def _shares(amount: int, room: list[int]) -> list[int]:
    """amount in whole parts in proportion to the room, never above it; what is left over goes to the largest remainders."""
    total = sum(room)
    amount = min(amount, total)
    if not total:
        return [0] * len(room)
    parts = [amount * r // total for r in room]
    for i in sorted(range(len(room)), key=lambda i: (-(amount * room[i] % total), i)):
        if sum(parts) == amount:
            break
        parts[i] += parts[i] < room[i]
    return parts


def _allocate(profile: pd.DataFrame) -> pd.DataFrame:
    """Top-down over one profile's tree: category, then risk. A row per (target, cell) with the interval of draws it takes there."""
    profile = profile.sort_values(["target_id", "cell_category", "cell_risk"], na_position="last")
    targets = profile.drop_duplicates("target_id")
    cells = profile.dropna(subset=["cell_category"]).drop_duplicates(["cell_category", "cell_risk"])
    room = {(c.cell_category, c.cell_risk): int(c.cell_rows) for c in cells.itertuples()}
    drawn = dict.fromkeys(room, 0)
    taken: list[tuple] = []
    lacking: dict[int, int] = {}
    got: dict[tuple[int, str], int] = {}

    def take(t, keys: list[tuple[str, str]], amount: int, kind: str) -> int:
        parts = _shares(amount, [room[k] - drawn[k] for k in keys])
        for k, part in zip(keys, parts):
            if part:
                taken.append((t.target_id, kind, *k, drawn[k] + 1, drawn[k] + part))
                drawn[k] += part
        got[t.target_id, kind] = got.get((t.target_id, kind), 0) + sum(parts)
        return amount - sum(parts)

    within = lambda t: [k for k in room if k[0] == t.category and (pd.isna(t.risk) or k[1] == t.risk)]
    # A target for one leaf goes first: one for the whole category can still use its other leaves.
    for t in sorted(targets.itertuples(), key=lambda t: (pd.isna(t.risk), t.target_id)):
        lacking[t.target_id] = take(t, within(t), int(t.needed), "own")
    for t in targets.itertuples():
        if lacking[t.target_id]:
            lacking[t.target_id] = take(t, [k for k in room if k[0] == t.category], lacking[t.target_id], "sibling")
    for t in targets.itertuples():
        if lacking[t.target_id]:
            lacking[t.target_id] = take(t, [k for k in room if k[0] != t.category], lacking[t.target_id], "cousin")

    spans: dict[int, list[tuple]] = {}
    for target, *span in taken:
        spans.setdefault(target, []).append(span)
    rows = []
    for t in targets.itertuples():
        of = lambda kind, t=t: got.get((t.target_id, kind), 0)
        head = (t.profile_id, t.target_id, t.category, None if pd.isna(t.risk) else t.risk, int(t.needed), int(t.existing), of("own"), of("sibling"), of("cousin"), lacking[t.target_id])
        rows += [(*head, *span) for span in spans.get(t.target_id, [(None, None, None, None, None)])]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])
    return out.astype({"first": "Int64", "last": "Int64"})


def allocation(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each target's rows come from: a row per target and cell (one of nulls for a target that gets nothing).

    records: leaf_category, leaf_risk. targets: profile_id, target_id, category, risk (null: any), target_share, min_rows, sample_size.
    needed is the larger of min_rows and target_share x sample_size rounded half up; existing counts the records in the target's
    scope. A target takes from its own cells first; what they lack is asked of its siblings (other risks of the category), then of
    its cousins (the profile's other categories), each in proportion to the rows still free there. No cell gives a row twice within
    a profile. The tree of a profile has at most (categories x risks) of its own targets, so each profile is one small task.
    Null shares, sizes and minima are 0; a target without category or profile has no scope and is left out.
    """
    t = targets.where(F.col("category").isNotNull() & F.col("profile_id").isNotNull()).select(
        "profile_id", "target_id", vocabulary_key(F.col("category")).alias("category"), vocabulary_key(F.col("risk")).alias("risk"),
        F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce(F.col("target_share").cast("decimal(20,9)") * F.col("sample_size"), F.lit(0)))).cast("long").alias("needed"),
    )
    cells = records.groupBy("leaf_category", "leaf_risk").agg(F.count(F.lit(1)).alias("cell_rows"))
    wanted = t.select("profile_id", F.col("category").alias("leaf_category")).distinct()
    cells = cells.join(wanted, "leaf_category").withColumnsRenamed({"leaf_category": "cell_category", "leaf_risk": "cell_risk"})
    inside = (F.col("cell_category") == F.col("category")) & (F.col("risk").isNull() | (F.col("risk") == F.col("cell_risk")))
    grid = t.join(cells, "profile_id", "left")
    grid = grid.withColumn("_in", F.when(inside, F.col("cell_rows")).otherwise(0))
    existing = grid.groupBy("profile_id", "target_id").agg(F.sum("_in").alias("existing"))
    grid = grid.drop("_in").join(existing, ["profile_id", "target_id"])
    return grid.groupBy("profile_id").applyInPandas(_allocate, _REPORT)


def report(plan: DataFrame) -> DataFrame:
    """One row per target: needed, existing, what it got from where, and what stays unmet."""
    return plan.select("profile_id", "target_id", "category", "risk", "needed", "existing", "own", "from_siblings", "from_cousins", "short").distinct()


def draw(records: DataFrame, plan: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """The sampled records; columns key, profile_id, target_id, kind, cell_category, cell_risk.

    The rows of a cell are permuted by a hash of (seed, profile, key) with ties by key, and numbered over range partitions, so a
    cell may hold any share of all rows. Hashes are counted in 256 bands first, and only the bands that a cell's draw reaches are numbered: what is
    written is about the size of the sample, not of the records. Records with a null key are never drawn; a repeated key counts as often as it occurs.
    """
    spans = durable(plan.where(F.col("first").isNotNull()))
    cells = spans.groupBy("profile_id", "cell_category", "cell_risk").agg(F.max("last").alias("_most"))
    pool = records.where(F.col(key).isNotNull()).select(key, F.col("leaf_category").alias("cell_category"), F.col("leaf_risk").alias("cell_risk"))
    pool = pool.join(cells, ["cell_category", "cell_risk"]).withColumn("_draw", F.xxhash64(F.lit(seed), "profile_id", key))
    cell = ["profile_id", "cell_category", "cell_risk"]
    pool = pool.withColumn("_band", F.shiftright("_draw", 56))
    bands = pool.groupBy(*cell, "_band", "_most").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*cell).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows of a cell at most
    reached = bands.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_before < _most").groupBy(*cell).agg(F.max("_band").alias("_last"))
    pool = pool.join(reached, cell).where("_band <= _last").drop("_band", "_last")
    placed = with_place(pool, cell, [F.col("_draw"), F.col(key)]).where(F.col("place") <= F.col("_most"))
    hit = placed.join(spans.select(*cell, "target_id", "kind", "first", "last"), cell).where(F.col("place").between(F.col("first"), F.col("last")))
    return hit.select(key, "profile_id", "target_id", "kind", "cell_category", "cell_risk")
