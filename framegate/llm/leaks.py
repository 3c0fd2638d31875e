"""Evaluation texts leaking into training text."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.llm.lookalike import with_form
from framegate.plans.durable import durable

#: A word is a run of letters and digits.
WORDS = r"[\p{L}\p{Nd}]+"
#: Words of a probe window: what must stand together counts as a verbatim leak.
WINDOW = 10
#: Hashed terms and latent dimensions; both fix the size of what is sent to the driver and to the executors.
TERMS, RANK, EXTRA, KEPT_APART = 4096, 32, 8, 8
#: Words of a passage when the latent space is fitted, and passages taken at a time.
PASSAGE, PASSAGES = 32, 2048
#: Partial sums that one task of the tree adds up.
FAN = 32
#: Bits of each of the two filters (words of items, neighbouring words of items): 512 kB whatever the items.
FILTER_BITS = 1 << 22
#: Latent cells: item windows per cell, cells at most, item windows that the centres are fitted on, and cells that a text's window looks into.
CELL, CELLS, FITTED, NEAR = 64, 2048, 20_000, 12
#: Distinct item windows that are broadcast at most (100 bytes each); more are met by a shuffle on their cells.
BLOCK = 200_000
#: Of the shuffled form: item windows that a task holds, and text windows after which a cell is split.
HELD, SPLIT = 8_000, 200_000
#: Text windows taken at a time.
LOT = 20_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WINDOWS = "m1 long, m2 long, hashes binary"
_PAIRS = "m1 long, m2 long, p1 long, p2 long, cosine double, common int"


@dataclass(frozen=True)
class LatentSpace:
    """For each hashed term its weighted place in the latent space, in whole numbers, and beside it KEPT_APART small random coordinates, so
    that terms that the main directions leave out still tell windows apart and no window is null.

    Sums and products of whole numbers are exact in any order, so equal windows have equal vectors, cells and similarities in any batch."""

    terms: np.ndarray

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors of windows (one row of terms each), times 2^15 and rounded."""
        total = np.zeros((len(terms), self.terms.shape[1]), np.int64)
        for k in range(terms.shape[1]):
            total += self.terms[terms[:, k]]
        length = np.sqrt((total * total).sum(axis=1).astype(np.float64))
        return np.rint(total / np.maximum(length, 1)[:, None] * 2**15)


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """The words of each text after it is brought to its look-alike form; columns key, words. Null texts are left out."""
    forms = with_form(df.select(key, F.col(text).alias("_text")).where("_text is not null"), "_text", "_form")
    return forms.select(key, F.regexp_extract_all(F.lower("_form"), F.lit(WORDS), F.lit(0)).alias("words"))


def _hashes(words: Column) -> Column:
    """62 bits of each word above the one that is always set. The lowest bits are its hashed term, which is all that a word keeps that no item has."""
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(1 << 62)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row begins and the last ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), (offsets - offsets[0]).astype(np.int64)


# --- the latent space -------------------------------------------------------------------------------------------------


def _sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's share of C'C times a random matrix, C being term counts by passage, beside the passages of each term and of all."""
    probe = _random()
    wide = RANK + EXTRA
    total = np.zeros((TERMS, wide + 2))
    for batch in frames:
        hashes, offsets = _flat(batch.column(0))
        terms = (hashes & (TERMS - 1)).astype(np.int16)
        per = -(-np.diff(offsets) // PASSAGE)
        first = np.repeat(offsets[:-1], per) + PASSAGE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        first = np.r_[first, len(terms)]
        total[0, wide + 1] += len(first) - 1
        for i in range(0, len(first) - 1, PASSAGES):
            cut = first[i : i + PASSAGES + 1]
            own = terms[cut[0] : cut[-1]]
            latent = np.add.reduceat(probe[own], cut[:-1] - cut[0], axis=0)
            passage = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            order = np.argsort(own, kind="stable")
            own, passage = own[order], passage[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[at], :wide] += np.add.reduceat(latent[passage], at, axis=0)
            other = np.r_[True, (own[1:] != own[:-1]) | (passage[1:] != passage[:-1])]
            total[:, wide] += np.bincount(own[other], minlength=TERMS)
    part, rows = TaskContext.get().partitionId(), 256
    blocks = range(0, TERMS, rows)
    yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "part": pa.array([part] * len(blocks), pa.int32()), "data": [total[b : b + rows].tobytes() for b in blocks]})


def _random() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32)


def _tree_sum(parts: DataFrame, count: int) -> DataFrame:
    """Parts (block, part, data) added up by a tree: no task holds more than FAN of them."""
    import pandas as pd

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in group["data"])
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1] // FAN, "data": [total.tobytes()]})

    while count > 1:
        parts = parts.groupBy("block", F.floor(F.col("part") / FAN)).applyInPandas(add, "block int, part int, data binary")
        count = -(-count // FAN)
    return parts


def fit_space(corpus: DataFrame) -> LatentSpace:
    """A randomised SVD of the TF-IDF matrix of all passages, from one reading of the corpus. corpus: hashes.

    With C the counts by passage and term and W the diagonal of inverse frequencies, the matrix is A = CW. One pass gives C'C times a random
    matrix R and the frequencies; W C'C R = A'A (R / W) is a sketch of A'A, and Nystroem's formula takes its main directions
    from the sketch alone. All texts count. Each task sends one TERMS x (RANK + EXTRA + 2) matrix to a tree of sums, of which the
    driver sees the root.
    """
    words = corpus.select("hashes")
    parts = words.mapInArrow(_sketch, "block int, part int, data binary")
    wide = RANK + EXTRA
    total = np.zeros((TERMS, wide + 2))
    for block, _, data in _tree_sum(parts, words.rdd.getNumPartitions()).collect():
        own = np.frombuffer(data).reshape(-1, wide + 2)
        total[block : block + len(own)] += own
    sketch, frequency, passages = total[:, :wide], total[:, wide], total[0, wide + 1]
    weights = np.log((1 + passages) / (1 + frequency)) + 1
    random = _random().astype(np.float64)
    core = random.T @ sketch
    values, inner = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    root = (weights[:, None] * sketch) @ (inner[:, good] / np.sqrt(values[good]))
    directions = np.linalg.svd(root, full_matrices=False)[0][:, :RANK]
    latent = np.zeros((TERMS, RANK))
    latent[:, : directions.shape[1]] = directions
    apart = np.random.default_rng(12).choice([-1.0, 1.0], (TERMS, KEPT_APART)) * 0.05
    table = np.hstack([latent, apart]) * weights[:, None]
    return LatentSpace(np.rint(table / np.abs(table).max() * 2**20).astype(np.int64))


# --- windows ----------------------------------------------------------------------------------------------------------


def _neighbours(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The filter bit of two neighbouring words."""
    return ((a.view(np.uint64) * np.uint64(_MIX[0]) ^ b.view(np.uint64)) * np.uint64(_MIX[1]) >> np.uint64(24)).astype(np.int64) & (FILTER_BITS - 1)


def _marks(hashes: np.ndarray, mix: int) -> np.ndarray:
    """A 64-bit mark of each window (one row of hashes each)."""
    total = np.zeros(len(hashes), np.uint64)
    for k in range(hashes.shape[1]):
        total = (total ^ hashes[:, k].astype(np.uint64)) * np.uint64(mix)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _window_batch(lead: dict, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(lead | {"m1": _marks(hashes, _MIX[0]), "m2": _marks(hashes, _MIX[1]), "hashes": _bytes(hashes)})


def _windows(keep: Callable[[np.ndarray], np.ndarray] | None = None):
    """Rows (row, key, at, window) of lists of words; keep(hashes) gives the starts of the windows that count. In: row, key, hashes."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            hashes, offsets = _flat(batch.column(2))
            starts = np.arange(max(0, len(hashes) - WINDOW + 1)) if keep is None else keep(hashes)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            inside = starts + WINDOW <= offsets[owner + 1]
            starts, owner = starts[inside], owner[inside]
            row, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, len(starts), LOT):
                s, own = starts[i : i + LOT], owner[i : i + LOT]
                yield _window_batch({"row": row[own], "key": key[own], "at": s - offsets[own]}, hashes[s[:, None] + np.arange(WINDOW)])

    return run


def _bits(slots: list, dtype=np.int64) -> np.ndarray:
    out = np.zeros(FILTER_BITS // 64, dtype)
    for slot, bits in slots:
        out[slot] = bits
    return out


def _filters(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all words of items, and of all neighbours: at most FILTER_BITS / 64 numbers each, whatever the items."""
    slots = lambda at: (F.shiftright(at, 6).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    single = asked.select(F.explode("hashes").alias("h")).select(*slots(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))))

    def pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            hashes, offsets = _flat(batch.column(0))
            inner = np.ones(max(0, len(hashes) - 1), bool)
            inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(hashes))] - 1] = False
            yield pa.RecordBatch.from_pydict({"at": np.unique(_neighbours(hashes[:-1], hashes[1:])[inner])})

    double = asked.select("hashes").mapInArrow(pairs, "at long").select(*slots(F.col("at")))
    return tuple(_bits(d.groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()) for d in (single, double))


def _known(spark, words: np.ndarray):
    """Rows (key, hashes) with the hash of each word that no item has cut down to its term: it can match nothing, and the table stays small."""
    shared = spark.sparkContext.broadcast(words)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for batch in frames:
            hashes, offsets = _flat(batch.column(1))
            at = hashes & (FILTER_BITS - 1)
            there = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            kept = np.where(there == 1, hashes, hashes & (TERMS - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(kept))], ["key", "hashes"])

    return run


def _possible(spark, neighbours: np.ndarray, least_common: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which windows of texts can have least_common words in the order of some item's window: so many words of theirs are words of items, and
    among as many in order, with WINDOW - least_common left out on either side, some follow each other on both sides."""
    follow = 3 * least_common - 2 * WINDOW - 1
    shared = spark.sparkContext.broadcast(neighbours)

    def keep(hashes: np.ndarray) -> np.ndarray:
        if len(hashes) < WINDOW:
            return np.zeros(0, np.int64)
        known = hashes >= TERMS
        both = np.flatnonzero(known[:-1] & known[1:])
        bits = shared.value.view(np.uint64)
        at = _neighbours(hashes[both], hashes[both + 1])
        pair = np.zeros(len(hashes), bool)
        pair[both] = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        words = np.r_[0, np.cumsum(known, dtype=np.int32)]
        starts = np.flatnonzero(words[WINDOW:] - words[:-WINDOW] >= least_common)
        pairs = np.r_[0, np.cumsum(pair, dtype=np.int32)]
        return starts[pairs[starts + WINDOW - 1] - pairs[starts] >= follow]

    return keep


# --- pairs of windows -------------------------------------------------------------------------------------------------


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(keep, row[j])
            last = keep
    return row[-1]


def _commons(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for many pairs of windows, row by row of hashes: a bit for each word of b, cleared as the subsequence grows."""
    open_ = np.full(len(a), (1 << WINDOW) - 1, np.uint32)
    for i in range(WINDOW):
        match = np.zeros(len(a), np.uint32)
        for j in range(WINDOW):
            match |= (a[:, i] == b[:, j]).astype(np.uint32) << np.uint32(j)
        used = open_ & match
        open_ = (open_ + used) | (open_ - used)
    return WINDOW - np.bitwise_count(open_ & np.uint32((1 << WINDOW) - 1)).astype(np.int64)


def _bags(windows: np.ndarray) -> np.ndarray:
    """A bit for each word of a window, of 64 that the words share: a word whose bit another window lacks is not in it."""
    return np.bitwise_or.reduce(np.uint64(1) << (windows & 63).astype(np.uint64), axis=1)


@dataclass
class _Side:
    """Windows read from Arrow: marks, hashes, bags and places."""

    m1: np.ndarray
    m2: np.ndarray
    hashes: np.ndarray
    bags: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, space: LatentSpace) -> "_Side":
        hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.int64).reshape(-1, WINDOW)
        return cls(table["m1"].to_numpy(), table["m2"].to_numpy(), hashes, _bags(hashes), space.places(hashes & (TERMS - 1)))

    def take(self, rows: np.ndarray) -> "_Side":
        return _Side(self.m1[rows], self.m2[rows], self.hashes[rows], self.bags[rows], self.places[rows])


def _nearest_cells(places: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each place, the nearest first among them (of equal ones the smallest number)."""
    near = places @ centres.T
    best = near.argmax(axis=1)
    if n == 1 or len(centres) <= 1:
        return best[:, None]
    near[np.arange(len(near)), best] = np.inf
    n = min(n, len(centres))
    return np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centres) else np.argsort(-near, axis=1, kind="stable")


def _compare(windows: _Side, probes: _Side, least_cosine: float, least_common: int) -> tuple[np.ndarray, ...]:
    """(window, probe, cosine, common words) of the pairs that are similar enough and have enough words in the same order."""
    rows, columns, values, commons = [], [], [], []
    step = max(1, 4_000_000 // max(1, len(probes.m1)))
    apart = WINDOW - least_common  # words of either window that the other may lack
    for i in range(0, len(windows.m1), step):
        part = slice(i, i + step)
        cosine = windows.places[part] @ probes.places.T
        r, c = np.nonzero(cosine >= least_cosine * 2**30)
        a, b = windows.bags[part][r], probes.bags[c]
        near = (np.bitwise_count(a & ~b) <= apart) & (np.bitwise_count(b & ~a) <= apart)
        r, c = r[near], c[near]
        n = _commons(windows.hashes[part][r], probes.hashes[c])
        good = n >= least_common
        r, c = r[good], c[good]
        rows.append(r + i)
        columns.append(c)
        values.append(np.minimum(1.0, cosine[r, c] / 2**30))
        commons.append(n[good])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, columns, values, commons))


def _pair_batch(windows: _Side, probes: _Side, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    w, p, cosine, common = found
    return pa.RecordBatch.from_pydict({"m1": windows.m1[w], "m2": windows.m2[w], "p1": probes.m1[p], "p2": probes.m2[p], "cosine": cosine.astype(float), "common": common.astype(np.int32)})


def _centres(probes: DataFrame, count: int, space: LatentSpace) -> np.ndarray:
    """Centres of the latent cells: a few rounds of k-means over at most FITTED item windows, those of the smallest marks."""
    some = _Side.of(probes.orderBy("m1", "m2").limit(FITTED).toArrow(), space).places
    k = int(min(CELLS, max(1, count // CELL), max(1, len(some))))
    centres = some[np.linspace(0, len(some) - 1, k).astype(int)] if len(some) else np.zeros((1, space.terms.shape[1]))
    for _ in range(4):
        cell = (some @ centres.T).argmax(axis=1) if len(some) else np.zeros(0, int)
        total = np.zeros_like(centres)
        np.add.at(total, cell, some)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, np.rint(total / np.maximum(length, 1) * 2**15), centres)
    return np.unique(centres, axis=0)


def _pairs_held(windows: DataFrame, probes: DataFrame, space: LatentSpace, centres: np.ndarray, least_cosine: float, least_common: int) -> DataFrame:
    """Pairs of windows with all item windows in each task; for BLOCK of them at most."""
    sent = windows.sparkSession.sparkContext.broadcast((space, centres, probes.toArrow()))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, centres, table = sent.value
        asked = _Side.of(table, space)
        home = _nearest_cells(asked.places, centres, 1)[:, 0]
        cells = [asked.take(np.flatnonzero(home == c)) for c in range(len(centres))]
        for batch in frames:
            own = _Side.of(batch, space)
            near = _nearest_cells(own.places, centres, NEAR)
            for c in np.unique(near):
                part = own.take(np.flatnonzero((near == c).any(axis=1)))
                yield _pair_batch(part, cells[c], _compare(part, cells[c], least_cosine, least_common))

    return windows.select("m1", "m2", "hashes").mapInArrow(run, _PAIRS)


def _pairs_shuffled(windows: DataFrame, probes: DataFrame, space: LatentSpace, centres: np.ndarray, least_cosine: float, least_common: int) -> DataFrame:
    """Pairs of windows for item windows of any number: both sides meet by latent cell. A cell of many item windows is cut into parts of about
    HELD, one of many text windows into as many copies as it takes; within a task text windows pass by the item windows of their part."""
    sent = windows.sparkSession.sparkContext.broadcast((space, centres))

    def placed(n: int):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, centres = sent.value
            for batch in frames:
                near = _nearest_cells(_Side.of(batch, space).places, centres, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        return run

    def load(df: DataFrame, size: int) -> Column:
        """Parts that each cell is cut into; a number per cell."""
        parts = [0] * len(centres)
        for cell, n in df.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
            parts[cell] = -(-n // size)
        return F.get(F.lit(parts), F.col("cell"))

    kinds = f"{_WINDOWS}, cells array<int>"
    columns = ("m1", "m2", "hashes")
    asked = durable(probes.select(*columns).mapInArrow(placed(1), kinds))
    given = durable(windows.select(*columns).mapInArrow(placed(NEAR), kinds))
    chunks, copies = load(asked, HELD), load(given, SPLIT)
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    a = asked.withColumn("cell", F.explode("cells")).withColumn("chunk", F.pmod("m2", F.greatest(chunks, F.lit(1))).cast("int")).withColumn("copy", upto(copies))
    g = given.withColumn("cell", F.explode("cells")).withColumn("copy", F.pmod("m1", F.greatest(copies, F.lit(1))).cast("int")).withColumn("chunk", upto(chunks))
    group = ["cell", "chunk", "copy"]
    both = a.select(*group, F.lit(0).alias("side"), *columns).unionByName(g.select(*group, F.lit(1).alias("side"), *columns))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _ = sent.value
        held: list[pa.Table] = []
        asked, at = None, None
        for batch in frames:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[c].to_numpy() for c in (*group, "side")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for i, j in zip(cuts[:-1], cuts[1:]):
                *own, side = keys[i].tolist()
                if own != at:
                    held, asked, at = [], None, own
                if side == 0:
                    held.append(table.slice(i, j - i))
                    continue
                if asked is None and held:
                    asked, held = _Side.of(pa.concat_tables(held), space), []
                if asked is not None:
                    part = _Side.of(table.slice(i, j - i), space)
                    yield _pair_batch(part, asked, _compare(part, asked, least_cosine, least_common))

    return both.repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(run, _PAIRS)


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least_cosine: float = 0.5, least_common: int = 8) -> DataFrame:
    """Which items' passages stand in which texts; columns key, item_id, cosine, run_words, common_words.

    run_words is the longest passage of at least ten consecutive words that item and text share (0: none), common_words the longest common
    subsequence of any two of their ten-word windows that are similar enough, cosine the highest similarity of windows with so many. A pair
    with run_words 0 is a paraphrase: at least least_common of ten words in the same order. Words are runs of letters and digits in lower case
    after both texts are brought to their look-alike form; they are compared by 62-bit hashes. Null and empty texts, and items of under ten words, never
    match; nor do rows with a null key. Rows that repeat a key give the best of their texts.

    Latent semantic retrieval: the TF-IDF passages of all texts are reduced by a randomised SVD. The ten-word windows of items are indexed by latent
    cells, those of texts look into the NEAR cells nearest to them, where windows of at least least_cosine are candidates; all candidates
    are compared by their longest common subsequence. An equal window has an equal vector and the same nearest cell, so each verbatim leak is
    among the candidates, however the cells lie. Before that, windows that cannot have least_common words in common with any item
    window are left out by filters of fixed size, which never lose one that can.

    Every text is read once to fit the space and once for its windows, whatever the number of items. Windows of equal words are compared once. Up to BLOCK
    distinct item windows go to every task, more are met by a shuffle on their cells. key and item_key are longs.
    """
    spark = docs.sparkSession
    asked = words_of(items.select(F.col(item_key).cast("long").alias("key"), F.col(item_text).alias("text")).where("key is not null"), "key", "text").where(F.size("words") >= WINDOW)
    asked = durable(asked.select("key", _hashes(F.col("words")).alias("hashes"), F.monotonically_increasing_id().alias("row")))
    words, neighbours = _filters(asked)
    corpus = words_of(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null"), "key", "text").where(F.size("words") > 0)
    corpus = corpus.select("key", _hashes(F.col("words")).alias("hashes")).mapInArrow(_known(spark, words), "key long, hashes array<long>")
    corpus = durable(corpus.withColumn("row", F.monotonically_increasing_id()))
    space = fit_space(corpus)

    kinds = f"row long, key long, at long, {_WINDOWS}"
    columns = ("row", "key", "hashes")
    places = durable(asked.select(*columns).mapInArrow(_windows(), kinds))
    seen = durable(corpus.select(*columns).mapInArrow(_windows(_possible(spark, neighbours, least_common)), kinds))
    one = lambda df: df.groupBy("m1", "m2").agg(F.first("hashes").alias("hashes"))
    probes = durable(one(places))
    count = probes.count()
    centres = _centres(probes, count, space)
    pairs = (_pairs_held if count <= BLOCK else _pairs_shuffled)(one(seen), probes, space, centres, least_cosine, least_common)

    mark = ["m1", "m2"]
    owners = places.select(F.col("key").alias("item_id"), F.col("m1").alias("p1"), F.col("m2").alias("p2")).distinct()
    near = durable(pairs.join(owners, ["p1", "p2"]).groupBy(*mark, "item_id").agg(F.max(F.struct("common", "cosine")).alias("best")))
    where = seen.select("key", *mark).distinct()
    close = where.join(near, mark).groupBy("key", "item_id").agg(F.max("best").alias("best"))

    same = near.where(F.col("best.common") == WINDOW).select(*mark, "item_id")
    spots = seen.select("row", "key", "at", *mark).join(places.select(F.col("key").alias("item_id"), F.col("at").alias("_in_item"), *mark).join(same, [*mark, "item_id"], "left_semi"), mark)
    runs = _longest(spots.withColumn("_off", F.col("at") - F.col("_in_item")), ["row", "key", "item_id", "_off"], "at")
    runs = runs.groupBy("key", "item_id").agg((F.max("_length") + WINDOW - 1).cast("int").alias("run_words"))
    out = close.join(runs, ["key", "item_id"], "left")
    return out.select(F.col("key").alias(key), "item_id", F.col("best.cosine").alias("cosine"), F.coalesce("run_words", F.lit(0)).alias("run_words"), F.col("best.common").alias("common_words"))


def _longest(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """The longest stretch of consecutive numbers per group; columns group, _length. A group is the places of one text on one line through an item."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*group).orderBy(at))
    stretches = df.select(*group, at).distinct().withColumn("_island", F.col(at) - place)
    return stretches.groupBy(*group, "_island").agg(F.count(F.lit(1)).alias("_length"))
