"""Splits that keep related records together."""

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framegate.plans.durable import drop_table, durable


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's connected component; columns node, root. edges: a, b (long, not null).

    Large-star and small-star rounds over the distinct edges, until a round changes nothing; the bound is O(log^2 n) rounds whatever the
    diameter (5 rounds over 120000 labels and over a chain of 30). Minima are aggregated before the shuffle; the join back is by node and AQE splits it where a node is hot.
    Each round is written to shared storage, so a lost executor costs one round at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _written(pairs)
    while True:
        # large star: the larger neighbours of each node move to its smallest neighbour
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of each node, and the node, move to the smallest of them
        large = large.where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        before = mark
        new, mark = _written(small)
        drop_table(now)
        now = new
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """An edge set written, and its count and order-free digest, taken while it is written."""
    seen = Observation()
    table = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")))
    return table, (seen.get["n"], seen.get["digest"])


def bind(records: DataFrame, key: str, bonds: list[Column]) -> DataFrame:
    """The group of every record; columns key, group_id: the smallest key among the records bound to it, directly or through others.

    Two records are bound when they have the same value in one of the two bonds; null binds nothing. key is a long; records
    with a null key are left out, rows that repeat a key are one record with the bonds of all. Exactly two bonds: the records are the edges of a two-sided graph whose nodes are bond values.

    Records equal in both bonds are one edge before anything is joined. A value of the second bond leads to one of the first, the smallest that it meets, so
    only the first bond's values are nodes, and only where a second value meets several of them is there an edge; components() sees those alone.
    A value is known by 2 x (smallest key that has it), plus 1 for the second bond, so ids are exact.
    """
    if len(bonds) != 2:
        raise ValueError("bind takes two bonds")
    rows = durable(records.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[b.alias(f"_b{i}") for i, b in enumerate(bonds)]))
    pairs = durable(rows.where("_b0 is not null or _b1 is not null").groupBy("_b0", "_b1").agg(F.min("_key").alias("_low")))
    first = pairs.where("_b0 is not null").groupBy("_b0").agg((F.min("_low") * 2).alias("_n0"))
    pairs = pairs.join(first, "_b0", "left")
    second = pairs.where("_b1 is not null").groupBy("_b1").agg((F.min("_low") * 2 + 1).alias("_n1"), F.min("_n0").alias("_home"))
    known = durable(pairs.join(second, "_b1", "left").select("_b0", "_b1", "_low", "_n0", "_home", F.coalesce("_n0", "_home", "_n1").alias("node")))
    edges = known.where("_n0 <> _home").select(F.col("_n0").alias("a"), F.col("_home").alias("b"))

    same = lambda a, b: a["_b0"].eqNullSafe(b["_b0"]) & a["_b1"].eqNullSafe(b["_b1"])
    repeated = rows.groupBy("_key").count().where("count > 1").select("_key")
    if not repeated.isEmpty():
        twice = rows.join(repeated, "_key")
        met = durable(twice.join(known, same(twice, known)).select("_key", "node"))
        edges = edges.union(met.join(met.groupBy("_key").agg(F.min("node").alias("b")), "_key").select("node", "b"))
    roots = components(edges)
    known = known.join(roots, "node", "left").select("_b0", "_b1", "_low", F.coalesce("root", "node").alias("root"))
    known = known.join(known.groupBy("root").agg(F.min("_low").alias("group_id")), "root").select("_b0", "_b1", "group_id")
    alone = rows.where("_b0 is null and _b1 is null").select(F.col("_key").alias(key), F.col("_key").alias("group_id"))
    bound = rows.where("_b0 is not null or _b1 is not null")
    bound = bound.join(known, same(bound, known)).select(F.col("_key").alias(key), "group_id")
    return bound.unionByName(alone).groupBy(key).agg(F.min("group_id").alias("group_id"))


def _difference(tuples: list[tuple[int, list[list[int]]]], sums: list[list[int]]) -> list[list[int]]:
    """Karmarkar-Karp over k-tuples: the two with the largest spread are combined, heaviest bin of one with lightest of the other."""
    heap = []
    for i, s in enumerate(sums):
        heap.append((min(s) - max(s), i, s, tuples[i]))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        up = sorted(range(len(s1)), key=s1.__getitem__)
        down = sorted(range(len(s2)), key=s2.__getitem__, reverse=True)
        s = [s1[i] + s2[j] for i, j in zip(up, down)]
        m = [m1[i] + m2[j] for i, j in zip(up, down)]
        count += 1
        heapq.heappush(heap, (min(s) - max(s), count, s, m))
    return heap[0][3] if heap else []


def _combine(bins: int):
    """Items of one lot into `bins` bins. An item (weight w) is a tuple of one full and bins - 1 empty bins; a tuple from a lot below keeps its bins apart."""

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["tuple_id", "slot", "item"])
        sums, members = [], []
        for _, rows in lot.groupby("tuple_id", sort=True):
            s, m = [0] * bins, [[] for _ in range(bins)]
            for slot, item, weight in zip(rows["slot"], rows["item"], rows["weight"]):
                s[slot] += int(weight)
                m[slot].append(int(item))
            sums.append(s)
            members.append(m)
        filled = _difference(members, sums)
        weights = dict(zip(lot["item"], lot["weight"]))
        out = [(item, slot, int(weights[item])) for slot, items in enumerate(filled) for item in items]
        frame = pd.DataFrame(out, columns=["item", "bin", "weight"])
        frame["lot"] = lot["lot"].iloc[0]
        return frame

    return run


def balanced_bins(weights: DataFrame, bins: int = 50, lot_rows: int = 5000) -> DataFrame:
    """Every item in one of `bins` bins of nearly equal weight; columns item, bin. weights: item (unique long), weight (long).

    Largest differencing: extreme weights are combined again and again. Items are dealt into lots of about lot_rows by a hash; each
    lot is combined into one tuple of bins by itself, and tuples are combined by the same rule, `fan` lots at a time, until
    one is left. So no task holds more than lot_rows items or fan x bins sums, however many items there are.
    """
    fan = max(2, lot_rows // bins)
    total = weights.count()
    lots = max(1, -(-total // lot_rows))
    items = weights.select("item", "weight", F.pmod(F.xxhash64("item"), F.lit(lots)).alias("lot"), F.col("item").alias("tuple_id"), F.lit(0).alias("slot"))
    placed = durable(items.groupBy("lot").applyInPandas(_combine(bins), "item long, bin int, weight long, lot long"))
    current = placed.select("item", F.col("bin").alias("top"), "lot")
    sums = placed.groupBy("lot", "bin").agg(F.sum("weight").alias("weight"))
    while lots > 1:
        # a lot's bins are now the items: (lot, bin) is one number, and the lot is the tuple
        unit = sums.select((F.col("lot") * bins + F.col("bin")).alias("item"), "weight", F.floor(F.col("lot") / fan).alias("lot"), F.col("lot").alias("tuple_id"), F.col("bin").alias("slot"))
        merged = durable(unit.groupBy("lot").applyInPandas(_combine(bins), "item long, bin int, weight long, lot long"))
        step = merged.select((F.floor(F.col("item") / bins)).alias("lot"), F.pmod("item", F.lit(bins)).cast("int").alias("top"), F.col("bin").alias("_top"), F.col("lot").alias("_lot"))
        current = current.join(step, ["lot", "top"]).select("item", F.col("_top").alias("top"), F.col("_lot").alias("lot"))
        sums = merged.groupBy("lot", "bin").agg(F.sum("weight").alias("weight"))
        lots = -(-lots // fan)
    return current.select("item", F.col("top").alias("bin"))


def _deal(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole bins to splits, heaviest first, each to the split that lacks most of its share."""
    first = rows.iloc[0]
    names, shares = list(first["names"]), list(first["shares"])
    whole, asked = float(rows["weight"].sum()), sum(shares)
    lack = [whole * s / asked if asked else 0.0 for s in shares]
    out = []
    for r in rows.sort_values(["weight", "bin"], ascending=[False, True]).itertuples():
        i = max(range(len(names)), key=lambda i: (lack[i], -i))
        lack[i] -= r.weight
        out.append((r.bin, names[i]))
    return pd.DataFrame(out, columns=["bin", "split_name"])


def splits(grouped: DataFrame, key: str, targets: DataFrame, bins: int = 50) -> DataFrame:
    """The split of every record; columns key, group_id, split_name. grouped: key, group_id. targets: split_name, target_share.

    Whole groups go to bins, whole bins to splits, so a group never parts. A group larger than a bin makes its bin larger; the
    shares are then met as far as whole groups allow. Null names or shares in targets are left out; without any target
    the result is empty.
    """
    weights = grouped.groupBy(F.col("group_id").alias("item")).agg(F.count(F.lit(1)).alias("weight"))
    weights = durable(weights)
    where = durable(balanced_bins(weights, bins))
    heavy = where.join(weights, "item").groupBy("bin").agg(F.sum("weight").alias("weight"))
    goal = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("target_share"))
    goal = goal.agg(F.sort_array(F.collect_list(F.struct("split_name", "target_share"))).alias("t")).where(F.size("t") > 0)
    goal = goal.select(F.lit(0).alias("one"), F.col("t.split_name").alias("names"), F.col("t.target_share").alias("shares"))
    dealt = heavy.withColumn("one", F.lit(0)).join(goal, "one").groupBy("one").applyInPandas(_deal, "bin int, split_name string")
    chosen = where.join(dealt, "bin").select(F.col("item").alias("group_id"), "split_name")
    return grouped.select(key, "group_id").join(chosen, "group_id").select(key, "group_id", "split_name")


def shares(split: DataFrame, targets: DataFrame, bins: int = 50) -> DataFrame:
    """What a split came to; columns split_name, target_share, near, parted, labels. split: as from splits(), targets as there.

    near: the split's share lies off its target (as a part of all targets) by no more than a bin or the largest group. parted: groups that more than one split has, of
    all; labels: records of all splits.
    """
    split = durable(split)
    whole = split.groupBy("group_id").agg(F.count(F.lit(1)).alias("_w"), F.count_distinct("split_name").alias("_s"))
    whole = whole.agg(F.count_if(F.col("_s") > 1).alias("parted"), F.coalesce(F.sum("_w"), F.lit(0)).alias("labels"), F.max("_w").alias("_most"))
    goal = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("target_share"))
    asked = goal.agg(F.sum("target_share").alias("_asked"))
    counts = split.groupBy("split_name").agg(F.count(F.lit(1)).alias("_n"))
    one = lambda df: df.withColumn("_k", F.lit(0))
    rows = one(goal.join(counts, "split_name", "left")).join(one(whole), "_k").join(one(asked), "_k")
    off = F.abs(F.coalesce("_n", F.lit(0)) / F.col("labels") - F.col("target_share") / F.col("_asked"))
    near = F.coalesce(off <= F.greatest(F.lit(1 / bins), F.col("_most") / F.col("labels")), F.lit(True))
    return rows.select("split_name", "target_share", near.alias("near"), "parted", "labels")
