"""What were limits of the operators once, each exceeded, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framegate.llm import bpe, group_split, leaks, lookalike, nearest, quota_sample, runs


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_runs_of_sparse_numbers_close_in_their_partitions(spark, monkeypatch):
    """Numbers far apart, as time stamps are: what is handed on is two runs per block, not every event."""
    monkeypatch.setattr(runs, "LEVELS", (4, 8, None))
    written = []
    monkeypatch.setattr(runs, "durable", lambda df: written.append(durable(df)) or written[-1])
    from framegate.plans.durable import durable

    rng = random.Random(5)
    data = [("v", i * 20_000_000 + 7, rng.choice("ab"), 0.5, i * 1.0) for i in range(500)]
    df = spark.createDataFrame(data, "v string, seq long, kind string, change double, t double").repartition(3)
    got = rows(runs.collapse_runs(df, ["v"], "seq", "kind", "t", "change", 0.01, 2.0), "first_sequence", "events")
    want, last = [], None
    for _, s, k, *_ in data:
        if k == last:
            want[-1][1] += 1
        else:
            want.append([s, 1])
        last = k
    assert got == sorted(map(tuple, want), key=repr)
    assert written[0].where("open").count() < 100 < written[0].count()


def test_one_entity_over_many_slices_of_a_stream(spark, tmp_path):
    rng = random.Random(8)
    left = [(i, float(rng.randrange(3000)), float(rng.randrange(9))) for i in range(200)]
    right = [(1000 + i, t) for i, t in enumerate(rng.sample(range(3000), 300))]
    events = [(1, t, i, tol) for i, t, tol in left] + [(0, float(t), i, 0.0) for i, t in right] + [(0, 99000.0, 10**6, 0.0)]
    events.sort(key=lambda e: e[1] + rng.uniform(0, 20))
    for n in range(0, len(events), 130):
        batch = spark.createDataFrame(events[n : n + 130], "side int, t double, id long, tolerance double")
        batch.select(F.lit("a").alias("entity"), "side", F.timestamp_seconds("t").alias("at"), "id", "tolerance").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("entity string, side int, at timestamp, id long, tolerance double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = nearest.nearest_stream(source, 8.0, "30 seconds", slice_seconds=20.0)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    want = []
    for i, t, tol in left:
        best = min(((abs(x - t), s) for s, x in right if abs(x - t) <= tol), default=None)
        if best:
            want.append((i, best[1]))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "left_id", "right_id") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        nearest.nearest_stream(source, float("inf"), "1 second")


def test_large_ids_are_an_error(tmp_path):
    letters = bpe.Vocabulary()._letter
    vocab = {c: i for i, c in enumerate(letters.values())} | {"ab": 1 << 20}
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b"]}}))
    with pytest.raises(ValueError, match="ids"):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_words_beyond_the_common_ones(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "HEAD", 3)
    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(9)
    words = ["the", "gate", "Überprüfung", "καμερα", "日本語", "x" * 200, "a1b2", "\n\n", "  "]
    texts = [None, "", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r["id"]: r["ids"] for r in bpe.encode_corpus(df, "id", "text").collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_cells_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)], "item long, t string")
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(50)]
    source = {r["item"]: r["t"].split() for r in items.collect()}
    docs = []
    for i, text in enumerate(texts):
        body, own = text.split(), list(source[i % 40])
        own[rng.randrange(5, 9)] = "other"
        docs.append((i, " ".join([*body[:20], *own[: rng.choice([12, 25])], *body[20:]])))
    docs = spark.createDataFrame([*docs, (0, texts[1]), (None, texts[2])], "id long, text string")
    args = (docs, "id", "text", items, "item", "t")
    held = rows(leaks.leaked_items(*args))
    for name, value in (("BLOCK", 1), ("HELD", 50), ("SPLIT", 300), ("CELL", 20)):
        monkeypatch.setattr(leaks, name, value)
    monkeypatch.setattr(leaks, "NEAR", 10**6)  # all cells: nothing can be lost
    whole = rows(leaks.leaked_items(*args))
    assert len(held) >= 40 and [r[:2] for r in whole if r[3]] == [r[:2] for r in held if r[3]] and set(r[:2] for r in held) <= set(r[:2] for r in whole)
    assert len(held) >= 0.95 * len(whole)


def test_tree_sum_is_a_tree(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(leaks, "FAN", 3)
    parts = spark.createDataFrame([(b, p, np.full(4, float(p + b)).tobytes()) for b in (0, 256) for p in range(20)], "block int, part int, data binary")
    got = {r["block"]: np.frombuffer(r["data"]).tolist() for r in leaks._tree_sum(parts, 20).collect()}
    assert got == {0: [190.0] * 4, 256: [5310.0] * 4}


def test_repeated_key_binds_all_its_bonds(spark):
    df = spark.createDataFrame([(9, "a", "x"), (9, "b", "y"), (3, "b", None), (4, None, "x"), (5, "c", "z"), (6, None, None)], "id long, a string, b string")
    assert rows(group_split.bind(df, "id", [F.col("a"), F.col("b")]), "id", "group_id") == [(3, 3), (4, 3), (5, 5), (6, 6), (9, 3)]


def test_shares(spark):
    grouped = spark.range(2000).select(F.col("id"), (F.col("id") - F.col("id") % F.lit(4)).alias("group_id"))
    targets = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "split_name string, target_share double")
    split = group_split.splits(grouped, "id", targets)
    assert rows(group_split.shares(split, targets), "split_name", "near", "parted", "labels") == [("a", True, 0, 2000), ("b", True, 0, 2000)]
    parted = split.withColumn("split_name", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    assert {(r["near"], r["parted"]) for r in group_split.shares(parted, targets).collect()} == {(False, 500)}


def test_draw_numbers_only_what_it_reaches(spark, monkeypatch):
    numbered = []
    place = quota_sample.with_place
    monkeypatch.setattr(quota_sample, "with_place", lambda df, *args: numbered.append(df.count()) or place(df, *args))
    records = quota_sample.leaves(spark.range(20000).select("id", F.lit("a").alias("category"), F.lit("low").alias("risk")), "category", "risk")
    targets = spark.createDataFrame([("p", 1, "a", None, 0.5, 1, 200)], "profile_id string, target_id long, category string, risk string, target_share double, min_rows int, sample_size long")
    drawn = quota_sample.draw(records, quota_sample.allocation(records, targets), "id").collect()
    assert len(drawn) == len({r["id"] for r in drawn}) == 100 and numbered[0] < 400


def test_classes_without_pairs(spark):
    texts = ["abc", "аbc", "abc", "abc​", "xyz", None, "​"]
    df = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "id long, text string")
    assert rows(lookalike.lookalike_classes(df.union(df), "id", "text")) == [(10, 10, 2), (10, 11, 1), (10, 13, 1)]
    assert rows(lookalike.lookalike_classes(df.limit(0), "id", "text")) == []
