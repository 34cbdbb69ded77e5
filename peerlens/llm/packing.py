"""Best-fit packing of documents into sequences of bounded length by a grouping genetic algorithm.

Documents become token ids with a closing id 0; only those longer than a sequence are cut. Full pieces are sequences of
their own. The others are dealt by a hash to shards of about ``SHARD`` pieces, so that no task grows with the corpus and no
document can crowd one. A shard is worked on by ``ISLANDS`` populations over ``EPOCHS`` epochs; between epochs each island's
best packing migrates to the next one, as rows that Spark shuffles.

An individual is a packing. Islands start apart: from best-fit decreasing, from bins closed one by one with the fullest
filling of up to three pieces, and from perturbed orders of either. Crossover puts whole well-filled bins of one parent
into the other, drops the other's bins that share a piece with them, and puts the pieces that lost their bin into the
fullest bin with room, longest first. Mutation empties the least filled bins and some others, and fills them anew in
either way. A shard ends early once its packing meets a lower bound, below which no packing can be. Bins that are still
far from full are then taken apart and their pieces packed again, across shards.

Defined results: a null or empty text is the single id 0; every row is packed, so rows that repeat are packed each; a
doc_id may be null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, materialise, runs, small_batches
from .tokens import encoder_for

LENGTH = 2048
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: The most generations of an epoch, and how many in a row may bring nothing.
GENERATIONS = 40
STALL = 8
#: Bins of at least this share of the length are well filled.
WELL = 0.999
#: Bins under this share of the length are taken apart to be packed across shards.
LOOSE = 0.97


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32) for each piece; ``item`` is a number that tells rows apart."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_for(vocabulary), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, size, crc = [], [], [], [], []
            for a, b in runs(texts, 1 << 21):
                ids, n = encoder.encode(texts[a:b])
                stop = 0
                for i, m in enumerate(n.tolist(), a):
                    own = np.append(ids[stop : stop + m], np.uint32(0)).astype("<u4")
                    stop += m
                    for k, at in enumerate(range(0, m + 1, length)):
                        part = own[at : at + length]
                        row.append(i), piece.append(k), start.append(at), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            item = (task << 33) + seen + np.arange(len(row), dtype=np.int64)
            seen += len(row)
            columns = [pa.array(item, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, "item long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """A bin for each piece, -1 for those that have none yet, and the room left in each bin."""

    def __init__(self, sizes: np.ndarray, length: int, bins: np.ndarray | None = None) -> None:
        self.sizes, self.length = sizes, length
        self.bins = np.full(len(sizes), -1) if bins is None else bins
        self.tidy()

    def tidy(self) -> None:
        """Numbers the bins that hold a piece from 0 on."""
        held = self.bins >= 0
        _, self.bins[held] = np.unique(self.bins[held], return_inverse=True)
        self.loads = np.bincount(self.bins[held], self.sizes[held]).astype(np.int64) if held.any() else np.zeros(0, np.int64)

    def fit(self, order: np.ndarray | None = None) -> Packing:
        """Puts each piece without a bin into the fullest bin with room, by default the longest first. ``rooms`` has
        bit r set if a bin with room r exists, so that the least sufficient room is its lowest bit from a size on."""
        free = np.flatnonzero(self.bins < 0)
        free = free[np.argsort(-self.sizes[free], kind="stable")] if order is None else order[self.bins[order] < 0]
        by_room: dict[int, list[int]] = {}
        for k, load in enumerate(self.loads.tolist()):
            by_room.setdefault(self.length - load, []).append(k)
        rooms, loads = 0, self.loads.tolist()
        for r in by_room:
            rooms |= 1 << r
        for i, size in zip(free.tolist(), self.sizes[free].tolist(), strict=True):
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, k = self.length, len(loads)
                loads.append(0)
            loads[k] += size
            self.bins[i] = k
            by_room.setdefault(room - size, []).append(k)
            rooms |= 1 << (room - size)
        self.loads = np.array(loads, np.int64)
        return self

    def close(self, rng: np.random.Generator | None = None) -> Packing:
        """Puts pieces without a bin into new bins, each begun with the longest piece left (sometimes another one, if ``rng``
        is given) and filled with the one or two pieces that leave the least room, until none fits."""
        free = np.flatnonzero(self.bins < 0)
        free = free[np.argsort(self.sizes[free], kind="stable")]
        size, k, loads = self.sizes[free], len(self.loads), self.loads.tolist()
        while len(free):
            first = len(free) - 1 if rng is None or rng.random() < 0.8 else int(rng.integers(len(free)))
            room = self.length - int(size[first])
            self.bins[free[first]] = k
            free, size = np.delete(free, first), np.delete(size, first)
            while m := int(np.searchsorted(size, room, "right")):
                i = np.arange(m)
                j = np.minimum(np.searchsorted(size, room - size[:m], "right"), i) - 1
                both = np.where(j >= 0, size[:m] + size[np.maximum(j, 0)], 0)
                pair = int(both.argmax())
                taken = [m - 1] if size[m - 1] >= both[pair] else [pair, int(j[pair])]
                room -= int(size[taken].sum())
                self.bins[free[taken]] = k
                free, size = np.delete(free, taken), np.delete(size, taken)
            loads.append(self.length - room)
            k += 1
        self.loads = np.array(loads, np.int64)
        return self

    def copy(self) -> Packing:
        return Packing(self.sizes, self.length, self.bins.copy())

    def without(self, bins: np.ndarray) -> Packing:
        out = self.copy()
        out.bins[np.isin(out.bins, bins)] = -1
        out.tidy()
        return out

    def worth(self) -> tuple[int, float]:
        """Fewer bins are better, then fuller full ones."""
        return -len(self.loads), float(((self.loads / self.length) ** 2).sum())


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """``mother`` with whole well-filled bins of ``father``."""
    good = np.flatnonzero(father.loads >= WELL * father.length)
    good = good[rng.random(len(good)) < 0.5]
    brought = np.isin(father.bins, good)
    child = mother.without(np.unique(mother.bins[brought]))
    child.bins[brought] = father.bins[brought] + len(mother.loads) + 1
    child.tidy()
    return child.fit()


def mutate(packing: Packing, rng: np.random.Generator) -> Packing:
    """The least filled bins and a few others emptied and filled again, in one of two ways."""
    n = len(packing.loads)
    worst = np.argsort(packing.loads)[: max(2, n // 20)]
    child = packing.without(np.union1d(worst, rng.choice(n, max(1, n // (50 if rng.random() < 0.5 else 10)), replace=False)))
    return child.fit() if rng.random() < 0.4 else child.close(rng)


def least_bins(sizes: np.ndarray, length: int) -> int:
    """A number of bins that no packing can go below: of pieces longer than length - k each needs a bin of its own, and so
    does each of those over half; what pieces of at least k have too much for the room beside the latter needs further ones.
    The largest such number over all k (Martello and Toth's bound)."""
    if not len(sizes):
        return 0
    s = np.sort(sizes.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(s)])
    k = np.concatenate([[0], np.unique(s[2 * s <= length])])
    half, near = np.searchsorted(s, length // 2, "right"), np.searchsorted(s, length - k, "right")
    near = np.maximum(near, half)
    alone, beside = len(s) - near, near - half
    low = np.searchsorted(s, k, "left")
    small = sums[half] - sums[np.minimum(low, half)]
    more = small - (beside * length - (sums[near] - sums[half]))
    return int((alone + beside + np.maximum(0, -(-more // length))).max())


def evolve(sizes: np.ndarray, length: int, seed: int, migrants: list[np.ndarray], island: int = 0) -> np.ndarray:
    """The bins of the best packing after GENERATIONS, from migrants and the island's own start."""
    rng, bound = np.random.default_rng(seed), least_bins(sizes, length)
    made = lambda k: Packing(sizes, length).fit() if k % ISLANDS == 0 else Packing(sizes, length).close(rng if k >= ISLANDS else None)
    people = [Packing(sizes, length, m.copy()) for m in migrants] or [made(island)]
    best = max(people, key=Packing.worth)
    if len(best.loads) <= bound:
        return best.bins
    while len(people) < POPULATION:
        perturbed = np.argsort(-sizes * rng.uniform(0.9, 1.1, len(sizes)))
        people.append(Packing(sizes, length).fit(perturbed) if rng.random() < 0.5 else made(island + ISLANDS))
    stalled = 0
    for _ in range(GENERATIONS):
        a, b = rng.choice(len(people), 2, replace=False)
        children = [crossover(people[a], people[b], rng), crossover(people[b], people[a], rng), mutate(best, rng), mutate(people[b], rng)]
        people = sorted([*people, *children], key=Packing.worth, reverse=True)[:POPULATION]
        stalled = 0 if people[0].worth() > best.worth() else stalled + 1
        best = people[0]
        if len(best.loads) <= bound or stalled >= STALL:
            break
    return best.bins


def _grow(length: int):
    def grow(table: pa.Table) -> pa.Table:
        """One island: its pieces, each with its bins in the packings that have come here."""
        shard, island = (table[c][0].as_py() for c in ("shard", "island"))
        item, origin, size, bins = (table[c].to_numpy() for c in ("item", "origin", "length", "bin"))
        kept, at = np.unique(item, return_index=True)
        migrants = [bins[origin == o][np.argsort(item[origin == o])] for o in np.unique(origin) if o >= 0]
        found = evolve(size[at], length, (int(shard) * 31 + int(island)) & 0x7FFFFFFF, migrants, int(island))
        n = len(kept)
        return pa.table({"shard": pa.array(np.full(n, shard), pa.int64()), "island": pa.array(np.full(n, island), pa.int32()), "origin": pa.array(np.full(n, island), pa.int32()), "item": kept, "length": size[at], "bin": found.astype(np.int64)})

    return grow


STATE = "shard long, island int, origin int, item long, length long, bin long"


def pack_shards(items: DataFrame, length: int, many: int) -> DataFrame:
    """(shard, item, length, bin) of each shard's best packing. ``items``: item, length."""
    shards = max(1, -(-many // SHARD))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    isles = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    state = dealt.select("shard", isles.alias("island"), F.lit(-1).alias("origin"), "item", "length", F.lit(-1).cast("long").alias("bin"))
    for epoch in range(EPOCHS):
        if epoch:
            to = F.explode(F.array(F.col("origin"), ((F.col("origin") + 1) % ISLANDS).cast("int")))
            state = state.select("shard", to.alias("island"), "origin", "item", "length", "bin")
        state = state.groupBy("shard", "island").applyInArrow(_grow(length), STATE)
    state = materialise(state, "packings")
    best = state.groupBy("shard", "island").agg(F.max("bin").alias("bins")).groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b"))
    return state.join(best.select("shard", F.col("b.island").alias("island")), ["shard", "island"]).select("shard", "item", "length", "bin")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of every row."""
    cut = materialise(pieces(docs, length, vocabulary), "pieces")
    short = cut.where(F.col("length") < length).select("item", "length")
    first = pack_shards(short, length, short.count())
    loads = first.groupBy("shard", "bin").agg(F.sum("length").alias("load"))
    first = materialise(first.join(loads, ["shard", "bin"]), "packed")
    loose = first.where(F.col("load") < LOOSE * length).select("item", "length")
    again = pack_shards(loose, length, loose.count())
    place = lambda df, level: df.select("item", "length", (F.col("shard") * (4 * SHARD) + F.col("bin")).alias("at"), F.lit(level).alias("level"))
    placed = place(first.where(F.col("load") >= LOOSE * length), 0).unionByName(place(again, 1))
    before = Window.partitionBy("level", "at").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.select("item", (F.col("at") * 4 + F.col("level")).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    whole = cut.where(F.col("length") >= length).select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(packed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").unionByName(whole)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
