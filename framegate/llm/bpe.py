"""Encoding of a corpus with a byte-level BPE vocabulary file."""

import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegate.plans.durable import durable

#: Where the vocabulary lies unless told otherwise; the file is read on the driver and never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How byte-level BPE of this family cuts text into words before any merge (fixed; (?U) makes \s cover all white space).
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots of the rank map; a slot holds the few pairs that hash to it.
_SLOTS = 1 << 14
_NONE = 2**31 - 1
#: Bits of an id in a pair's key and beside a pair's rank; a larger vocabulary is an error.
_ID_BITS = 20
#: Words of more bytes are merged with a heap in Python: a fold is quadratic in a word's length.
FOLD_BYTES = 48
#: The commonest words whose ids go to every task, if they have at most FOLD_BYTES bytes: 20 MB at most. All other words meet their ids by a join.
HEAD = 1 << 17


class Vocabulary:
    """Ids of bytes and of merged pairs. Its size is that of the vocabulary file, whatever the corpus."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # Visible Latin-1 bytes stand for themselves in the file, the others for the code points from 256 on.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(visible)]
        self._letter = {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.byte_ids = [vocab[self._letter[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        if max(vocab.values()) >= 1 << _ID_BITS:
            raise ValueError(f"ids must be under {1 << _ID_BITS}")
        byte_of = {letter: b for b, letter in self._letter.items()}
        self.pieces = {i: bytes(byte_of[c] for c in word) for word, i in vocab.items() if all(c in byte_of for c in word)}

    @cached_property
    def rank_map(self) -> list[dict[int, int]]:
        """Slots of maps: left << _ID_BITS | right -> rank << _ID_BITS | merged id."""
        slots: list[dict[int, int]] = [{} for _ in range(_SLOTS)]
        for (a, b), (rank, merged) in self.merges.items():
            slots[(a * 31 + b) % _SLOTS][a << _ID_BITS | b] = rank << _ID_BITS | merged
        return slots

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one word by a heap of ranked neighbours over a linked list."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = following[i]
            if j < n and (hit := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]


@lru_cache(4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _literal(spark: SparkSession, value, kind: str) -> Column:
    """A value as a scalar subquery: evaluated once, then a literal in every task."""
    schema = T.StructType([T.StructField("v", T._parse_datatype_string(kind))])
    return spark.createDataFrame([(value,)], schema).scalar()


def _merge_fold(word: Column, byte_ids: Column, ranks: Column) -> Column:
    """The ids of a word's bytes after all ranked merges. State: ids, and for each neighbouring pair its rank << _ID_BITS | merged id."""
    none = F.lit(_NONE).cast("long") * (1 << _ID_BITS)

    def look(a: Column, b: Column) -> Column:
        slot = F.element_at(ranks, (F.pmod(a * 31 + b, F.lit(_SLOTS)) + 1).cast("int"))
        return F.coalesce(F.element_at(slot, F.shiftleft(a.cast("long"), _ID_BITS).bitwiseOR(b.cast("long"))), none)

    n = F.octet_length(word)
    ids = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.element_at(byte_ids, F.ascii(c) + 1))  # a character per byte
    start = F.transform(F.array(ids), lambda x: F.struct(x.alias("ids"), F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x)), look).alias("pairs")))[0]

    def step(s: Column, _: Column) -> Column:
        low = F.array_min(s["pairs"])

        def merged(x: Column) -> Column:
            at, new = x["at"], x["low"].bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")
            old = s["ids"]
            left = F.when(at > 1, F.array(look(F.get(old, at - 2), new))).otherwise(F.array().cast("array<bigint>"))
            right = F.when(at + 1 < F.size(old), F.array(look(new, F.get(old, at + 1)))).otherwise(F.array().cast("array<bigint>"))
            return F.struct(
                F.concat(F.slice(old, F.lit(1), at - 1), F.array(new), F.slice(old, at + 2, F.size(old))).alias("ids"),
                F.concat(F.slice(s["pairs"], F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(s["pairs"], at + 2, F.size(old))).alias("pairs"),
            )

        done = F.coalesce(low, none) == none
        found = F.array(F.struct(low.alias("low"), F.array_position(s["pairs"], low).cast("int").alias("at")))
        return F.when(done, s).otherwise(F.transform(found, merged)[0])

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["ids"])


def encode_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Ids of distinct words; the columns of words and ids. words: word string, not empty, and any others but ids.

    A fold of the ranked merges over each word's byte array, with the rank map as a literal of fixed size. Words of more than FOLD_BYTES
    bytes are merged exactly in Arrow batches instead.
    """
    spark = words.sparkSession
    vocabulary = _vocabulary(path)
    tables = _literal(spark, (vocabulary.byte_ids, vocabulary.rank_map), "struct<byte_ids: array<int>, ranks: array<map<bigint,bigint>>>")
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields]
    data = words.withColumn("_bytes", F.encode("word", "UTF-8"))
    # Read once, so that the optimizer puts the subquery where the column is: the literal is never copied into a row.
    fold = F.transform(F.array("_tables"), lambda t: _merge_fold(F.col("_bytes"), t["byte_ids"], t["ranks"]))[0]
    short = data.where(F.octet_length("_bytes") <= FOLD_BYTES).select("*", tables.alias("_tables")).select(*words.columns, fold.alias("ids"))
    shared = spark.sparkContext.broadcast((vocabulary.byte_ids, vocabulary.merges))

    def by_heap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Vocabulary.__new__(Vocabulary)
        own.byte_ids, own.merges = shared.value
        for f in frames:
            yield f.assign(ids=[own.encode_bytes(w.encode()) for w in f["word"]])

    long = data.where(F.octet_length("_bytes") > FOLD_BYTES).select(*words.columns).mapInPandas(by_heap, ", ".join([*others, "ids array<int>"]))
    return short.unionByName(long)


def _head(coded: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The HEAD commonest words, where the ids of each begin, and all their ids. coded: word, n, ids."""
    common = coded.where(F.octet_length("word") <= FOLD_BYTES).orderBy(F.col("n").desc(), "word").limit(HEAD).select("word", "ids").toArrow()
    ids = common["ids"].combine_chunks() if len(common) else pa.array([], pa.list_(pa.int32()))
    return pa.array(common["word"].to_pylist(), pa.string()), ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy()


def _assemble(frames: Iterator[pa.RecordBatch], head: tuple[pa.Array, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per text (key, mark, words) the ids of its common words, and its rare words in order. The k-th rare word stands as -k among the ids."""
    known, begins, ids = head
    ids = np.r_[ids, np.int32(-1)]
    begins, sizes = np.r_[begins[:-1], len(ids) - 1], np.r_[np.diff(begins), 1]  # the last is for words that are not known
    for batch in frames:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten()
        at = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy().astype(np.int64)
        size = sizes[at]
        ends = np.r_[0, np.cumsum(size)]
        spot = np.arange(ends[-1]) + np.repeat(begins[at] - ends[:-1], size)
        flat = ids[spot].astype(np.int32)
        rare = at == len(known)
        seen = np.r_[0, np.cumsum(rare)]
        first = np.repeat(seen[offsets[:-1]], np.diff(offsets))
        flat[ends[:-1][rare]] = -(seen[1:] - first)[rare]
        lists = [pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(seen[offsets], pa.int32()), words.filter(pa.array(rare)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["_key", "_mark", "_flat", "_rare"])


def _fill(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids with negative places, the ids of the rare words in order) with the places filled; columns _key, ids."""
    for batch in frames:
        flat, found = batch.column(1), batch.column(2)
        ids, offsets = flat.flatten().to_numpy(), flat.offsets.to_numpy() - flat.offsets[0].as_py()
        lists = found.flatten()
        words, begins = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
        gap = np.flatnonzero(ids < 0)
        size = np.ones(len(ids), np.int64)
        size[gap] = np.diff(begins)
        source = np.arange(len(ids))
        source[gap] = len(ids) + begins[:-1]
        ends = np.r_[0, np.cumsum(size)]
        spot = np.arange(ends[-1]) + np.repeat(source - ends[:-1], size)
        out = pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(np.r_[ids, words].astype(np.int32)[spot]))
        yield pa.RecordBatch.from_arrays([batch.column(0), out], ["_key", "ids"])


def encode_corpus(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """The token ids of every text, without special tokens; columns key, ids (array of int).

    Null and empty texts give an empty array. Strings of special tokens in a text are ordinary text. Texts of any length are encoded whole.
    Repeated rows are one; a key with several texts has a row for each. No other column is read.

    Words are counted over all texts and each distinct word is encoded once. The ids of the HEAD commonest words go to every task, so a text is put
    together where it is read and is never shuffled; the rare words that it lacks then are joined with their ids by word and come back by document.
    """
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    counts = durable(source.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    coded = durable(encode_words(counts, path))
    sent = docs.sparkSession.sparkContext.broadcast(_head(coded))
    kind = docs.schema[key].dataType.simpleString()
    read = source.select("_key", F.xxhash64("_text").alias("_mark"), words.alias("_words"))
    texts = durable(read.mapInArrow(lambda frames: _assemble(frames, sent.value), f"_key {kind}, _mark long, _flat array<int>, _rare array<string>"))
    repeated = texts.groupBy("_key", "_mark").count().where("count > 1").select("_key", "_mark")
    if not repeated.isEmpty():
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_key", "_mark")]
        once = texts.alias("a").join(repeated.alias("b"), same, "left_semi").dropDuplicates(["_key", "_mark"])
        texts = durable(texts.alias("a").join(repeated.alias("b"), same, "left_anti").unionByName(once))

    whole = texts.where(F.size("_rare") == 0).select("_key", F.col("_flat").alias("ids"))
    gaps = texts.where(F.size("_rare") > 0).withColumn("_id", F.struct("_key", "_mark"))
    asked = gaps.select("_id", F.posexplode("_rare").alias("_pos", "word"))
    met = asked.join(coded.select("word", "ids"), "word").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "ids"))).alias("_found"))
    filled = gaps.join(met, "_id").select("_key", "_flat", F.transform("_found", lambda x: x["ids"]).alias("_ids")).mapInArrow(_fill, f"_key {kind}, ids array<int>")
    return whole.unionByName(filled).select(F.col("_key").alias(key), "ids")


def decode_corpus(encoded: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """The text of each list of ids; columns key, text. Binary pieces are concatenated, then read as UTF-8. A null list gives null, an empty one ''."""
    vocabulary = _vocabulary(path)
    most = max(vocabulary.pieces) + 1
    table = _literal(encoded.sparkSession, [bytearray(vocabulary.pieces.get(i, b"")) for i in range(most)], "array<binary>")
    pieces = F.transform(F.array("_table"), lambda t: F.transform("_ids", lambda i: F.hex(F.element_at(t, i + 1))))[0]
    joined = encoded.select(key, F.col(ids).alias("_ids"), table.alias("_table")).select(key, F.array_join(pieces, "").alias("_hex"))
    return joined.select(key, F.decode(F.unhex("_hex"), "UTF-8").alias("text"))
