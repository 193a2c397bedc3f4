"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Documents are cut into pieces only where they are longer than a sequence. Pieces are dealt by hash to
shards of a bounded number of pieces. Each shard is evolved on several islands: an individual is a set of
bins; crossover injects whole well-filled bins of one parent into another, removes the bins that repeat
an injected piece, and puts the displaced pieces back; mutation empties the least filled bin and a few others.
Displaced pieces first take the place of smaller ones where they fill a bin better, and what is left is
best-fitted, largest first. Between rounds each island's elite moves to the next island of its ring. A shard stops
once it meets its lower bound. Shards cost at most about one bin each, which their size makes small.

Defined cases: null text is empty and has only the end id; rows that repeat a doc_id are packed each;
a null doc_id is packed and returned as null; a text is encoded whole however long it is, by one task; pieces of
equal length tie by their number in the table of pieces. Extra columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import bisect
import itertools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, settled, tidy
from .tokens import encoder, vocabulary_path, with_end

LENGTH = 2048
#: Pieces of a shard on average; islands of a shard; rounds between migrations; children a round.
SHARD, ISLANDS, ROUNDS, CHILDREN, POPULATION = 4096, 2, 3, 8, 4
#: Share of children by mutation; most bins that one empties; bins of at most so many pieces give two for one.
MUTATED, EMPTIED, PAIRED = 0.6, 8, 12


def cut_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids = with_end(*encoder(vocabulary, False).encode(batch.column("text")))
            sizes = np.diff(offsets)
            pieces = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * length
            size = np.minimum(length, sizes[row] - start)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((offsets[row] + start).tolist(), (offsets[row] + start + size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(of, 700), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of piece numbers with their free room; best fit by a bit set of free rooms."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, items: list[int]) -> Packing:
        """Puts each item where least room is left over, in the order given."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for b, room in enumerate(self.free):
            if room:
                by_room.setdefault(room, []).append(b)
                mask |= 1 << room
        for i in items:
            size = self.sizes[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                same = by_room[room]
                b = same.pop()
                if not same:
                    mask &= ~(1 << room)
                self.bins[b].append(i)
                room -= size
            else:
                b, room = len(self.bins), self.capacity - size
                self.bins.append([i])
                self.free.append(room)
            self.free[b] = room
            if room:
                by_room.setdefault(room, []).append(b)
                mask |= 1 << room
        return self

    def score(self) -> tuple[int, float]:
        """Fewer bins first, then bins of uneven fill (their room is easier to use)."""
        return len(self.bins), -sum((self.capacity - r) ** 2 for r in self.free)

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, sizes: list[int], capacity: int, assignment: np.ndarray) -> Packing:
        self = cls(sizes, capacity)
        n = int(assignment.max()) + 1 if len(assignment) else 0
        self.bins, self.free = [[] for _ in range(n)], [capacity] * n
        for i, b in enumerate(assignment.tolist()):
            self.bins[b].append(i)
            self.free[b] -= sizes[i]
        return self


def exchange(packing: Packing, loose: list[int]) -> list[int]:
    """Loose pieces go where a bin has room, or in place of one or two smaller pieces of a bin that they fill
    better; returns the pieces that are loose then. Every step fills a bin further, so it ends."""
    sizes = packing.sizes
    loose = sorted(loose, key=lambda i: sizes[i])
    key = [sizes[i] for i in loose]
    moved = True
    while moved and loose:
        moved = False
        for b, room in enumerate(packing.free):
            while room and loose:
                items = packing.bins[b]
                gain, out, at = 0, (), -1
                pairs = itertools.combinations(items, 2) if len(items) <= PAIRED else ()
                for given in itertools.chain(((),), ((i,) for i in items), pairs):
                    size = sum(sizes[i] for i in given)
                    k = bisect.bisect_right(key, size + room) - 1
                    if k >= 0 and key[k] - size > gain:
                        gain, out, at = key[k] - size, given, k
                if not gain:
                    break
                packing.bins[b] = [i for i in items if i not in out] + [loose.pop(at)]
                key.pop(at)
                for i in out:
                    k = bisect.bisect_left(key, sizes[i])
                    key.insert(k, sizes[i])
                    loose.insert(k, i)
                room -= gain
                packing.free[b] = room
                moved = True
    return loose


def refill(packing: Packing, loose: list[int], rng: random.Random) -> Packing:
    left = exchange(packing, loose)
    return packing.best_fit(sorted(left, key=lambda i: (-packing.sizes[i], rng.random())))


def without(packing: Packing, gone: set[int], taken: bytearray | None = None) -> tuple[Packing, list[int]]:
    """A copy without the bins gone, and their pieces but for those that are taken."""
    left, loose = Packing(packing.sizes, packing.capacity), []
    for b, items in enumerate(packing.bins):
        if b in gone:
            loose += [i for i in items if not (taken and taken[i])]
        else:
            left.bins.append(list(items))
            left.free.append(packing.free[b])
    return left, loose


def crossover(giver: Packing, taker: Packing, rng: random.Random) -> Packing:
    """Injects bins of the giver, the fuller the likelier; the taker's bins that repeat a piece and its worst go,
    and their other pieces are put back."""
    capacity = giver.capacity
    chosen = [b for b, room in enumerate(giver.free) if rng.random() < 0.5 * (1 - room / capacity) ** 16]
    taken = bytearray(len(giver.sizes))
    for b in chosen:
        for i in giver.bins[b]:
            taken[i] = 1
    worst = max(range(len(taker.bins)), key=lambda b: taker.free[b])
    child, loose = without(taker, {b for b, items in enumerate(taker.bins) if b == worst or any(taken[i] for i in items)}, taken)
    child.bins += [list(giver.bins[b]) for b in chosen]
    child.free += [giver.free[b] for b in chosen]
    return refill(child, loose, rng)


def mutation(parent: Packing, rng: random.Random) -> Packing:
    """Empties the least filled bin and a few others and puts their pieces back."""
    n = len(parent.bins)
    worst = max(range(n), key=lambda b: parent.free[b])
    child, loose = without(parent, {worst, *rng.sample(range(n), min(n, rng.randint(1, EMPTIED)))})
    return refill(child, loose, rng)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """At least so many bins: by total, and by counts of large pieces with the room beside them."""
    s = np.sort(np.asarray(sizes, np.int64))[::-1]
    if not len(s):
        return 0
    total, best = np.concatenate([[0], np.cumsum(s)]), -(-int(s.sum()) // capacity)
    for k in np.unique(s[s <= capacity // 2]).tolist() + [0]:
        big = int((s > capacity - k).sum())
        mid = int((s > capacity // 2).sum()) - big
        low = int((s >= max(k, 1)).sum())
        room = mid * capacity - int(total[big + mid] - total[big])
        small = int(total[low] - total[big + mid])
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def evolve(sizes: list[int], capacity: int, population: list[Packing], bound: int, rng: random.Random, children: int) -> list[Packing]:
    population.sort(key=Packing.score)
    for _ in range(children):
        if len(population[0].bins) <= bound or len(population) < 2:
            break
        a, b = sorted(rng.sample(range(len(population)), 2))
        if rng.random() < MUTATED:
            child, rival = mutation(population[a], rng), a  # as good as its parent: takes its place
        else:
            child, rival = crossover(population[a], population[b], rng), len(population) - 1
        if child.score() <= population[rival].score():
            population[rival] = child
            population.sort(key=Packing.score)
    return population


def _seeded(sizes: list[int], capacity: int, rng: random.Random, n: int, bound: int) -> list[Packing]:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [Packing(sizes, capacity).best_fit(order)]
    while len(out) < n and len(out[0].bins) > bound:
        noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.85, 1.0))
        out.append(Packing(sizes, capacity).best_fit(noisy))
    return out


def _canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable", ignore_index=True)


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _canonical(pdf)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [pdf["length"].to_numpy("int32").tobytes()]})


def _island(capacity: int, step: int):
    """A round of every island: seeds or resumes its population, takes the guest in, evolves."""

    def of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                raw = np.frombuffer(r.sizes, np.int32)
                sizes = raw.tolist()
                rng = random.Random(f"{r.shard}/{r.island}/{step}")
                bound = lower_bound(sizes, capacity)
                if step:
                    own = np.frombuffer(r.population, np.int32).reshape(-1, len(raw))
                    population = [Packing.of(sizes, capacity, a) for a in own]
                    if len(population[0].bins) > bound:
                        population.append(Packing.of(sizes, capacity, np.frombuffer(r.guest, np.int32)))
                else:
                    population = _seeded(sizes, capacity, rng, POPULATION, bound)
                population = evolve(sizes, capacity, population, bound, rng, CHILDREN)[:POPULATION]
                if len(population[0].bins) <= bound:
                    population = population[:1]
                made = [p.assignment() for p in population]
                rows.append((r.shard, r.island, r.sizes, b"".join(a.tobytes() for a in made), made[0].tobytes(), len(population[0].bins), bound))
            yield pd.DataFrame(rows, columns=["shard", "island", "sizes", "population", "elite", "bins", "bound"])

    return of


def _placed(items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    items = _canonical(items)
    bins = np.frombuffer(best["elite"].iloc[0], np.int32)
    order = np.argsort(bins, kind="stable")
    size = items["length"].to_numpy()[order]
    ends = np.cumsum(size)
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = ends - size - np.repeat((ends - size)[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    out = items.iloc[order].copy()
    out["sequence_id"] = (best["shard"].iloc[0] << 24) + bins[order].astype(np.int64)
    out["offset"] = offset
    return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


@settled("packed")
def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = cut_pieces(docs, vocabulary or vocabulary_path("word_bpe_49k.json"), length)
    # dealt by a number that is written with the piece, so that equal rows are spread like any others
    items = materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-items.count() // SHARD))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    whole = "shard long, island int, sizes binary, population binary, elite binary, bins int, bound int"
    now = dealt.groupBy("shard").applyInPandas(_shard, "shard long, sizes binary").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    now = materialize(now.repartition(max(1, min(shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism)), "shard", "island").mapInPandas(_island(length, 0), whole), "islands")
    for step in range(1, ROUNDS):
        open_ = now.groupBy("shard").agg(F.min("bins").alias("least"), F.max("bound").alias("bound")).where("least > bound").select("shard")
        moving = now.join(open_, "shard")
        if moving.isEmpty():
            break
        guests = moving.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        after = moving.join(guests, ["shard", "island"]).mapInPandas(_island(length, step), whole)
        nxt = materialize(after.unionByName(now.join(open_, "shard", "left_anti")), "islands")
        discard(now)
        now = nxt
    best = now.groupBy("shard").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))
    placed = dealt.groupBy("shard").cogroup(best.groupBy("shard"))
    return placed.applyInPandas(_placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
