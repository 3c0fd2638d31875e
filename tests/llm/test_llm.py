"""The training-data operators against brute force on small fixtures, with the unpleasant rows of each."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from framegate.llm import bpe, group_split, leaks, lookalike, nearest, one_rank, quota_sample, runs, top_n

NAN = float("nan")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- 1: top N ---------------------------------------------------------------------------------------------------------


def test_top_n_is_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab") if rng.random() < 0.9 else None, i, rng.choice([None, NAN, 0.0, -0.0, 0.5, 0.5, rng.random()]), "x") for i in range(400)]
    df = spark.createDataFrame(data, "g string, id long, s double, rank string").repartition(5)
    want = []
    for g in {r[0] for r in data}:
        own = sorted([r for r in data if r[0] == g and r[2] is not None and not math.isnan(r[2])], key=lambda r: (-r[2], r[1]))[:5]
        want += [(g, r[1], i + 1) for i, r in enumerate(own)]
    assert rows(top_n.top_n(df, ["g"], "s", ["id"], 5), "g", "id", "rank") == sorted(want, key=repr)


def test_top_n_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1.0)] * 3 + [("b", None, 2.0)], "g string, id long, s double")
    assert rows(top_n.top_n(df, ["g"], "s", ["id"], 2), "g", "id") == [("a", 1), ("a", 1), ("b", None)]
    assert rows(top_n.top_n(df.limit(0), ["g"], "s", ["id"], 2)) == []
    with pytest.raises(ValueError):
        top_n.top_n(df, ["g"], "s", ["id"], 0)


# --- 2: sample by quota -----------------------------------------------------------------------------------------------

TARGETS = "profile_id string, target_id long, category string, risk string, target_share double, min_rows int, sample_size long"


def labels(spark, counts):
    data = [(i, *c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    return quota_sample.leaves(spark.createDataFrame(data, "id long, category string, risk string"), "category", "risk")


def test_quota_passes_to_siblings_then_cousins(spark):
    records = labels(spark, {("A a", "high"): 3, ("a-a", None): 4, ("b", "low"): 50, (None, "low"): 5})
    targets = spark.createDataFrame([("p", 1, "a_a", "HIGH ", 0.5, 1, 20), ("p", 2, "b", None, 0.5, 1, 20)], TARGETS)
    plan = quota_sample.allocation(records, targets)
    report = {r["target_id"]: r for r in quota_sample.report(plan).collect()}
    assert (report[1]["needed"], report[1]["existing"], report[1]["own"], report[1]["from_siblings"], report[1]["from_cousins"], report[1]["short"]) == (10, 3, 3, 4, 3, 0)
    drawn = quota_sample.draw(records, plan, "id").collect()
    assert len(drawn) == len({r["id"] for r in drawn}) == 20
    assert collections.Counter(r["kind"] for r in drawn) == {"own": 13, "sibling": 4, "cousin": 3}


def test_quota_short_empty_and_min(spark):
    records = labels(spark, {("a", "low"): 2})
    targets = spark.createDataFrame([("p", 1, "a", None, 0.0, 5, 10), ("p", 2, "z", "low", None, None, None), ("q", 3, None, None, 1.0, 1, 1)], TARGETS)
    report = {r["target_id"]: r["short"] for r in quota_sample.report(quota_sample.allocation(records, targets)).collect()}
    assert report == {1: 3, 2: 0}
    none = quota_sample.report(quota_sample.allocation(records.limit(0), targets)).collect()
    assert sorted((r["target_id"], r["existing"], r["short"]) for r in none) == [(1, 0, 5), (2, 0, 0)]
    assert rows(quota_sample.draw(records.limit(0), quota_sample.allocation(records.limit(0), targets), "id")) == []


# --- 3: splits --------------------------------------------------------------------------------------------------------


def test_bind_is_union_find(spark):
    rng = random.Random(3)
    data = [(i * 3 + 5, rng.choice([None, "h", *map(str, range(60))]), rng.choice([None, *map(str, range(70))])) for i in range(150)] + [(2, "chain0", "c0")]
    data += [(1000 + i, f"chain{(i + 1) // 2}", f"c{i // 2}") for i in range(30)] + [(5, "h", "extra")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in data:
        for bond in (("a", a), ("b", b)):
            if bond[1] is not None:
                parent[find(("k", k))] = find(bond)
        find(("k", k))
    group = collections.defaultdict(set)
    for k, *_ in data:
        group[find(("k", k))].add(k)
    want = sorted((k, min(g)) for g in group.values() for k in g)
    df = spark.createDataFrame(data + [(None, "h", None)], "id long, a string, b string").withColumn("_key", F.lit(1))
    bound = group_split.bind(df, "id", [F.col("a"), F.col("b")])
    assert rows(bound, "id", "group_id") == sorted(want, key=repr)
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2), (None, 0.5)], "split_name string, target_share double")
    split = group_split.splits(bound, "id", targets, 10).collect()
    assert len(split) == len(want) and len({(r["group_id"], r["split_name"]) for r in split}) == len(group)


def test_splits_meet_shares_over_many_lots(spark):
    grouped = spark.range(6000).select(F.col("id"), (F.col("id") - F.col("id") % F.lit(3)).alias("group_id"))
    weights = grouped.groupBy(F.col("group_id").alias("item")).agg(F.count("id").alias("weight"))
    bins = group_split.balanced_bins(weights, 8, 100).join(weights, "item").groupBy("bin").agg(F.sum("weight").alias("w")).collect()
    assert len(bins) == 8 and max(r["w"] for r in bins) - min(r["w"] for r in bins) <= 12
    targets = spark.createDataFrame([("train", 0.75), ("test", 0.25)], "split_name string, target_share double")
    share = dict(rows(group_split.splits(grouped, "id", targets, 8).groupBy("split_name").count()))
    assert abs(share["train"] - 4500) < 60
    assert rows(group_split.splits(grouped.limit(0), "id", targets)) == [] == rows(group_split.splits(grouped, "id", targets.limit(0)))


# --- 4: runs ----------------------------------------------------------------------------------------------------------


def test_runs_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    data, t = [], 0.0
    for v in ("a", "b", None):
        for i in range(300):
            t += rng.choice([0.5, 1.0, 2.0, 2.5])
            data.append((v, i * 2, rng.choice(["x", "x", "x", "y", None] if i % 40 == 0 else ["x"]), rng.choice([0.04, 0.05, 0.05, 0.07]), rng.choice([t] * 12 + [None, NAN]), 1))
    df = spark.createDataFrame(data, "v string, seq long, kind string, change double, t double, _block long").repartition(3)
    want, last = [], None
    fine = lambda x: x is not None and x == x
    for v, s, k, c, t, _ in sorted(data, key=lambda r: (repr(r[0]), r[1])):
        ok = last and last[0] == v and k is not None and last[2] == k and fine(t) and fine(last[4]) and round(abs(c - last[3]), 9) <= 0.01 and round(abs(t - last[4]), 9) <= 2.0
        if ok:
            want[-1][2:] = [s, want[-1][3] + 1]
        else:
            want.append([v, s, s, 1])
        last = (v, s, k, c, t)
    args = (df, ["v"], "seq", "kind", "t", "change", 0.01, 2.0)
    for levels in ((12, 24, None), (3, 6, None), (None,)):
        monkeypatch.setattr(runs, "LEVELS", levels)
        assert rows(runs.collapse_runs(*args), "v", "first_sequence", "last_sequence", "events") == sorted(map(tuple, want), key=repr)
    assert rows(runs.collapse_runs(df.limit(0), *args[1:])) == []
    assert rows(runs.collapse_runs(df.where("v = 'a' and seq = 0").withColumn("seq", F.lit(None).cast("long")), *args[1:])) == []


# --- 5: nearest in time -----------------------------------------------------------------------------------------------


def brute_nearest(left, right):
    out = []
    for i, v, t, tol in left:
        if i is None or v is None or t is None or t != t:
            continue
        tol = 0.0 if tol is None or tol != tol else tol
        best = min(((round(abs(x - t), 9), s) for w, s, x in right if w == v and s is not None and x is not None and x == x and round(abs(x - t), 9) <= tol), default=None)
        if best:
            out.append((i, best[1]))
    return sorted(out, key=repr)


def test_nearest_is_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, NAN, *[round(rng.uniform(0, 300), 1)] * 9]), rng.choice([None, NAN, 0.0, 0.1, 2.0, 40.0, 1e6, math.inf, -1.0])) for i in range(300)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(50)]), rng.choice([None, NAN, *[round(rng.uniform(0, 300), 1)] * 9])) for _ in range(60)]
    ldf = spark.createDataFrame(left, "id long, v string, t double, tol double").withColumn("slice", F.lit("x"))
    rdf = spark.createDataFrame(right, "v string, seq long, t double").withColumn("level", F.lit("x"))
    args = ("v", "id", "t", "tol", "v", "seq", "t")
    for width in (64.0, 0.5):
        assert rows(nearest.nearest_in_time(ldf, rdf, *args, slice_seconds=width), "left_id", "right_id") == brute_nearest(left, right)
    assert rows(nearest.nearest_in_time(ldf.limit(0), rdf, *args)) == [] == rows(nearest.nearest_in_time(ldf, rdf.limit(0), *args))


def test_nearest_buffer_in_small_batches(spark):
    import pandas as pd

    rng = random.Random(6)
    left = [(i, "a", float(rng.randrange(100)), float(rng.randrange(6))) for i in range(80)]
    right = [("a", 100 + i, float(t)) for i, t in enumerate(rng.sample(range(100), 15))]
    table = pd.DataFrame([(0, t, s, 0.0) for _, s, t in right] + [(1, t, i, tol) for i, _, t, tol in left], columns=["side", "at", "id", "tolerance"]).sort_values(["at", "side"])
    table["entity"] = "a"
    for size in (1, 3, 17):
        buffer = nearest.NearestBuffer(["entity"])
        parts = [buffer.push(table.iloc[i : i + size]) for i in range(0, len(table), size)]
        assert buffer.held is None or len(buffer.held) < 20
        found = pd.concat([*parts, buffer.finish()])
        assert sorted(((int(a), int(b)) for a, b in zip(found["left_id"], found["right_id"])), key=repr) == brute_nearest(left, right)


def test_nearest_stream_waits_for_the_horizon(spark, tmp_path):
    rng = random.Random(7)
    left = [(i, rng.choice("ab"), float(rng.randrange(200)), float(rng.randrange(5))) for i in range(60)]
    right = [(rng.choice("ab"), 100 + i, float(t)) for i, t in enumerate(rng.sample(range(200), 40))]
    events = [(v, 1, t, i, tol) for i, v, t, tol in left] + [(v, 0, t, s, 0.0) for v, s, t in right] + [(v, 0, 9000.0, 10**6, 0.0) for v in "ab"]
    events.sort(key=lambda e: e[2] + rng.uniform(0, 15))  # out of order by less than the delay
    for n in range(0, len(events), 25):
        batch = spark.createDataFrame(events[n : n + 25], "entity string, side int, t double, id long, tolerance double")
        batch.select("entity", "side", F.timestamp_seconds("t").alias("at"), "id", "tolerance").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("entity string, side int, at timestamp, id long, tolerance double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = nearest.nearest_stream(source, 5.0, "20 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "left_id", "right_id") == brute_nearest(left, right)


def test_nearest_stream_takes_the_nearest_of_a_repeated_id_and_no_wide_tolerance(spark, tmp_path):
    def run(name, *batches):
        for n, batch in enumerate(batches):
            df = spark.createDataFrame(batch, "entity string, side int, t double, id long, tolerance double")
            df.select("entity", "side", F.timestamp_seconds("t").alias("at"), "id", "tolerance").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        source = spark.readStream.schema("entity string, side int, at timestamp, id long, tolerance double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
        stream = nearest.nearest_stream(source, 5.0, "1 seconds").writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "log"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / name / "out")), "left_id", "right_id", "distance")

    end = [("a", 0, 900.0, 9, 0.0)]
    once = [("a", 1, 10.0, 1, 5.0), ("a", 1, 20.0, 1, 5.0), ("a", 1, 20.0, 1, 0.1), ("a", 0, 13.0, 100, 0.0), ("a", 0, 20.5, 101, 0.0)]
    assert run("once", once, end) == [(1, 101, 0.5)]
    held = [("a", 1, 100.0, 2, 1.0), ("a", 0, 100.25, 200, 0.0), ("a", 1, 120.0, 2, 5.0), ("a", 0, 121.0, 201, 0.0)]  # the second row keeps the first and its right row
    assert run("held", held, [("a", 0, 122.0, 202, 0.0)], [("a", 0, 123.0, 203, 0.0)], end) == [(2, 200, 0.25)]
    with pytest.raises(Exception, match="above max_tolerance"):
        run("wide", [("a", 1, 10.0, 3, 50.0), ("a", 0, 40.0, 300, 0.0)], end)


# --- 6: one ranking ---------------------------------------------------------------------------------------------------

PANEL = "v string, i long, build string, a double, b double, c double, d double"


def test_ranking_orders(spark):
    data = [("x", 0, "1", 9.0, 9.0, 9.0, 0.5), ("x", 1, "1", 5.0, 5.0, 5.0, 5.0), ("x", 2, "1", 4.0, 4.0, 4.0, 4.0), ("x", 3, "1", 1.0, NAN, None, 6.0), ("x", 4, "1", None, None, None, None), ("y", 7, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([*data, (None, 1, "1", 1.0, 1.0, 1.0, 1.0)], PANEL).withColumn("_value", F.lit("x"))
    args = (df, ["v"], "build", ["i"], list("abcd"))
    assert [i for _, i, *_ in sorted(one_rank.one_ranking(*args).where("v = 'x'").collect(), key=lambda r: r["place"])] == [0, 1, 2, 3, 4]
    assert [i for _, i, *_ in sorted(one_rank.one_ranking(*args, order="leximin").where("v = 'x'").collect(), key=lambda r: r["place"])][:3] == [1, 0, 2]
    assert rows(one_rank.first_of_ranking(*args), "v", "i") == [("x", 0), ("y", 7)]
    assert rows(one_rank.one_ranking(df.limit(0), *args[1:])) == []
    with pytest.raises(ValueError):
        one_rank.rank_key(F.col("vector"), "mean")


def test_percentiles_by_scale_and_ties(spark):
    data = [("x", i, "m" if i < 5 else "n", float(i % 5) * (1 if i < 5 else 1000), 1.0, None, float(i)) for i in range(10)]
    got = {r["i"]: r["vector"] for r in one_rank.percentiles(spark.createDataFrame(data, PANEL), ["v"], "build", ["i"], list("abcd")).collect()}
    assert got[4][:3] == [1.0, 0.5, None] and got[9][:3] == [1.0, 0.5, None] and got[0][0] == got[5][0] == 0.0


# --- 7: tokens --------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "hello world's  end", "naïve café ☕", "日本語のテキスト" * 30, "a" * 3000, "x" * 47 + "é", "<|endoftext|> ok", "\t\n \n", "🙂" * 40, "1234567 890", "don't WON'T", " 　x", "word " * 4000]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "id long, text string, word string")
    out = {r["id"]: r["ids"] for r in bpe.encode_corpus(df.union(df), "id", "text").collect()}
    assert out == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(df.union(df), "id", "text").count() == len(TEXTS)
    assert rows(bpe.encode_corpus(df.limit(0), "id", "text")) == []
    back = {r["id"]: r["text"] for r in bpe.decode_corpus(bpe.encode_corpus(df, "id", "text"), "id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_heap_and_fold_agree(spark):
    vocabulary = bpe.Vocabulary()
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abethinors é") for _ in range(rng.randrange(1, 20))) for _ in range(200)})
    got = {r["word"]: r["ids"] for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), bpe.VOCABULARY).collect()}
    assert got == {w: vocabulary.encode_bytes(w.encode()) for w in words}


# --- 8: leaks ---------------------------------------------------------------------------------------------------------


def test_leaks_are_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 10, 14, 30])))) for i in range(25)] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "—!"), (3, "filler " * 5000)]
    for d in range(4, 80):
        body = [rng.choice(words) for _ in range(30)]
        src = items[rng.randrange(25)][1].split()
        cut = rng.randrange(len(src))
        body[10:10] = src[cut : cut + rng.choice([8, 9, 10, 11, 40])]
        docs.append((d, rng.choice([" ", ", ", "​  "]).join(w.upper() if rng.random() < 0.1 else w for w in body)))
    grams = lambda t: {tuple(t[i : i + 10]) for i in range(len(t) - 9)}
    plain = lambda t: lookalike.look(t).lower().replace(",", " ").split() if t else []
    want = sorted(((d, i) for d, t in docs for i, s in items if grams(plain(t)) & grams(plain(s))), key=repr)
    ddf = spark.createDataFrame(docs, "id long, text string").withColumn("words", F.lit(1))
    idf = spark.createDataFrame(items, "item long, item_text string")
    got = leaks.leaked_items(ddf, "id", "text", idf, "item", "item_text")
    assert rows(got.where("run_words >= 10"), "id", "item_id") == want
    assert rows(leaks.leaked_items(ddf.limit(0), "id", "text", idf, "item", "item_text")) == []
    assert rows(leaks.leaked_items(ddf, "id", "text", idf.limit(0), "item", "item_text")) == []


def test_leaks_run_length_paraphrase_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 1)
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "xx " + text + " yy"), (2, text.replace("five", "fünf").replace("eleven", "elf")), (3, "nothing here at all but other words than those of the item " * 3)], "id long, text string")
    items = spark.createDataFrame([(7, text), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item long, t string")
    got = {(r["id"], r["item_id"]): (r["run_words"], r["common_words"]) for r in leaks.leaked_items(docs, "id", "text", items, "item", "t").collect()}
    assert got[1, 7] == (12, 10) and got[2, 7][0] == 0 and got[2, 7][1] >= 8 and (3, 7) not in got and all(i == 7 for _, i in got)


def test_leaks_try_every_window_of_a_text(spark):
    item = "the striped ribbon gets a number before golden postcard leaves"
    other = "number golden ribbon before the leaves postcard a striped gets"  # the same words, a cosine of 1, few in order
    docs = [(1, f"{other} filler words between the two {item.replace('golden', 'silver')} end"), (2, other), *[(i, f"silver filler words number {i}") for i in range(3, 40)]]
    docs, items = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(7, item)], "item long, t string")
    assert rows(leaks.leaked_items(docs, "id", "text", items, "item", "t"), "id", "item_id", "run_words", "common_words") == [(1, 7, 0, 9)]


def test_leaks_find_paraphrases_of_eight_words(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 1501)
    draw = lambda n: rng.choice(1500, n, p=share / share.sum())
    items, docs = [draw(14) for _ in range(40)], []
    for i in range(240):
        window = items[i % 40][i // 40 % 5 :][:10].copy()
        window[rng.choice(10, 2, replace=False)] = rng.integers(0, 8, 2)  # common words weigh most in the main directions
        docs.append(np.r_[draw(15), window, draw(15)])
    cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, 10)
    probes, of = np.vstack([cut(a) for a in items]), np.repeat(np.arange(40), 5)
    want = set()
    for d, a in enumerate(docs):
        at = leaks._commons(np.repeat(cut(a), len(probes), axis=0), np.tile(probes, (len(a) - 9, 1))).reshape(-1, len(probes))
        want |= {(d, int(of[j])) for j in np.flatnonzero((at >= 8).any(axis=0))}
    frame = lambda data, kind: spark.createDataFrame([(i, " ".join(f"w{x}" for x in a)) for i, a in enumerate(data)], kind)
    got = set(rows(leaks.leaked_items(frame(docs, "id long, text string"), "id", "text", frame(items, "item long, t string"), "item", "t"), "id", "item_id"))
    assert got <= want and len(want) >= 240 and len(got) >= 0.99 * len(want), (len(got), len(want))


def test_common_words_of_many_windows():
    import numpy as np

    a, b = np.random.default_rng(4).integers(0, 6, (2, 500, 10))
    b[:100] = np.roll(a[:100], 1, axis=1)
    assert leaks._commons(a, b).tolist() == [leaks._common(list(x), list(y)) for x, y in zip(a, b)]


# --- 9: look-alikes ---------------------------------------------------------------------------------------------------

ALIKE = [("é", "é"), ("ﾊﾞ", "バ"), ("Ａｂ１", "Ab1"), ("аudіo", "audio"), ("a­b​", "ab"), ("a　b", "a b"), ("Ό", "Ó"), ("한", "한"), ("ё", "ë"), ("e‍́", "é"), ("Ω", "Ω")]
UNLIKE = [("a", "A"), ("e", "é"), ("1", "2"), ("a b", "ab"), ("a  b", "a b"), ("и", "й"), ("б", "b")]


def test_form():
    assert all(lookalike.look(a) == lookalike.look(b) for a, b in ALIKE)
    assert all(lookalike.look(a) != lookalike.look(b) for a, b in UNLIKE)
    rng = random.Random(10)
    letters = "ae ó̈​ ＡﾊﾞﾊバаеёйΌό한한️🙂̧̣\n"
    for _ in range(3000):  # splicing unstable stretches is the same as normalizing the whole
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        assert lookalike.look(t) == lookalike.shape().canonical(t), ascii(t)
        assert lookalike.look(lookalike.look(t)) == lookalike.look(t), ascii(t)


#: By Unicode name, not from the operator's table.
SHAPES = [
    ("LATIN CAPITAL LETTER Y", "GREEK CAPITAL LETTER UPSILON", "CYRILLIC CAPITAL LETTER STRAIGHT U"), ("LATIN SMALL LETTER Y", "CYRILLIC SMALL LETTER U", "CYRILLIC SMALL LETTER STRAIGHT U"),
    ("LATIN CAPITAL LETTER I", "GREEK CAPITAL LETTER IOTA", "CYRILLIC LETTER PALOCHKA"), ("LATIN SMALL LETTER L", "CYRILLIC SMALL LETTER PALOCHKA"),
    ("LATIN CAPITAL LETTER J", "GREEK CAPITAL LETTER YOT", "CYRILLIC CAPITAL LETTER JE"), ("GREEK CAPITAL LETTER PSI", "CYRILLIC CAPITAL LETTER PSI"), ("GREEK SMALL LETTER PSI", "CYRILLIC SMALL LETTER PSI"),
    ("LATIN CAPITAL LETTER V", "CYRILLIC CAPITAL LETTER IZHITSA"), ("LATIN CAPITAL LETTER G", "CYRILLIC CAPITAL LETTER KOMI SJE"), ("LATIN CAPITAL LETTER SCHWA", "CYRILLIC CAPITAL LETTER SCHWA"),
    ("LATIN SMALL LETTER SCHWA", "CYRILLIC SMALL LETTER SCHWA", "LATIN SMALL LETTER TURNED E"), ("LATIN CAPITAL LETTER EZH", "CYRILLIC CAPITAL LETTER ABKHASIAN DZE"), ("LATIN SMALL LETTER EZH", "CYRILLIC SMALL LETTER ABKHASIAN DZE"),
    ("LATIN CAPITAL LETTER M", "GREEK CAPITAL LETTER SAN", "CYRILLIC CAPITAL LETTER EM"), ("LATIN CAPITAL LETTER F", "GREEK LETTER DIGAMMA"), ("LATIN CAPITAL LETTER THORN", "GREEK CAPITAL LETTER SHO"),
    ("LATIN SMALL LETTER THORN", "GREEK SMALL LETTER SHO"), ("LATIN CAPITAL LETTER ESH", "GREEK CAPITAL LETTER SIGMA"), ("LATIN SMALL LETTER OPEN E", "GREEK SMALL LETTER EPSILON"),
    ("GREEK CAPITAL LETTER THETA", "CYRILLIC CAPITAL LETTER FITA", "CYRILLIC CAPITAL LETTER BARRED O", "LATIN CAPITAL LETTER O WITH MIDDLE TILDE"), ("LATIN SMALL LETTER BARRED O", "CYRILLIC SMALL LETTER BARRED O", "CYRILLIC SMALL LETTER FITA"),
    ("GREEK CAPITAL LETTER PAMPHYLIAN DIGAMMA", "CYRILLIC CAPITAL LETTER I"), ("GREEK SMALL LETTER PAMPHYLIAN DIGAMMA", "CYRILLIC SMALL LETTER I"),
    ("LATIN CAPITAL LETTER D WITH STROKE", "LATIN CAPITAL LETTER ETH", "LATIN CAPITAL LETTER AFRICAN D"), ("MICRO SIGN", "GREEK SMALL LETTER MU"),
]


def test_same_shape_is_whole(spark):
    import unicodedata

    groups = [[unicodedata.lookup(n) for n in names] for names in SHAPES]
    forms = [{lookalike.look(c) for c in g} for g in groups]
    assert all(len(f) == 1 for f in forms) and len(set().union(*forms)) == len(groups)
    assert all(lookalike.look(f) == f for own in forms for f in own)
    df = spark.createDataFrame([(i * 10 + k, f"x{c}z") for i, g in enumerate(groups) for k, c in enumerate(g)], "id long, text string")
    assert rows(lookalike.lookalike_pairs(df, "id", "text")) == sorted(((i * 10 + a, i * 10 + b) for i, g in enumerate(groups) for b in range(len(g)) for a in range(b)), key=repr)


def test_pairs(spark):
    texts = ["abc", "abc", "аbс", "ABC", None, "", "​", " ", "　\t", "x​y", "xy", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"form": F.lit(1), "_text": F.lit(2), "_unstable": F.lit(3)})
    assert rows(lookalike.lookalike_pairs(df.union(df), "id", "text")) == [(0, 2), (1, 2), (9, 10)]
    assert rows(lookalike.lookalike_pairs(df.limit(0), "id", "text")) == []
    forms = lookalike.with_form(df, "text")
    assert forms.where("text is null and form is null").count() == 1 and set(forms.columns) == set(df.columns)


def test_queries_and_sql_fit():
    from framegate.llm.queries import QUERIES
    from framegate.llm.sql import SQL

    assert set(SQL) <= set(QUERIES) and {f"p{n}" for n in range(1, 10)} == {q.split("_")[0] for q in QUERIES}
