"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Texts are encoded once, map-side; only lengths and checksums of the pieces
travel. Pieces of full length fill a sequence each. The others are dealt to
islands of about ``island_items`` pieces by a hash of their own row number, so
no key, source or group of copies gathers on one island. An island keeps a
small population of groupings (bins of pieces). Crossover injects whole
well-filled bins of another grouping, removes the bins that hold duplicates of
their pieces, and best-fits the displaced pieces, larger first; a mutation empties the worst
bins the same way. The fitness is the number of bins, then the sum of squared
fillings. After an epoch the best bins of each island migrate, as patterns of
lengths, to the next island on the ring, which builds bins of those patterns
from its own pieces and injects them. Afterwards the pieces of badly filled bins
are dealt to fewer islands of the same size and packed there, level after level,
until one island holds them all or a level saves too little; no island ever
holds more pieces than the first ones did, whatever cannot be filled.

Edge cases: null and empty texts are one piece that holds only the end id; repeated rows
and null ids are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialize, prepare, table
from folioforge.llm.encoding import default_path, encoder

LENGTH, END_ID, ISLAND_ITEMS, POPULATION, GENERATIONS, MIGRANTS, SEED = 2048, 0, 2000, 4, 6, 24, 11
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, uid = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, bounds = enc.encode(b.column(1))
            docs, piece, start, size, crc = [], [], [], [], []
            for d, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    docs.append(d)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            uids = np.arange(uid, uid + len(docs))
            uid += len(docs)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array(uids, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
            )

    return run


class Bins:
    """A grouping: bins of item numbers, with best-fit by remaining space."""

    def __init__(self, sizes: list[int], room: int, groups: list[list[int]] = ()):
        self.sizes, self.room = sizes, room
        self.groups = [list(g) for g in groups]

    def fill(self) -> list[int]:
        return [sum(self.sizes[i] for i in g) for g in self.groups]

    def best_fit(self, items: list[int]) -> None:
        """Put items, larger first, each into the fullest bin that takes it."""
        space = [self.room - f for f in self.fill()]
        order = sorted((s, g) for g, s in enumerate(space) if s)
        for i in sorted(items, key=lambda x: (-self.sizes[x], x)):
            need = self.sizes[i]
            at = bisect_left(order, (need, -1))
            if at < len(order):
                s, g = order.pop(at)
                self.groups[g].append(i)
                if s > need:
                    insort(order, (s - need, g))
            else:
                self.groups.append([i])
                if need < self.room:
                    insort(order, (self.room - need, len(self.groups) - 1))

    def cost(self) -> tuple[int, float]:
        return len(self.groups), -sum((f / self.room) ** 2 for f in self.fill())

    def with_injected(self, bins: list[list[int]]) -> Bins:
        """Crossover: whole bins come in, bins with duplicates of their items go, displaced items are best-fitted."""
        taken = {i for g in bins for i in g}
        kept, displaced = [], []
        for g in self.groups:
            if taken.isdisjoint(g):
                kept.append(g)
            else:
                displaced += [i for i in g if i not in taken]
        child = Bins(self.sizes, self.room, [*bins, *kept])
        child.best_fit(displaced)
        return child

    def best_bins(self, n: int) -> list[list[int]]:
        fill = self.fill()
        return [self.groups[g] for g in sorted(range(len(fill)), key=lambda g: (-fill[g], -len(self.groups[g]), g))[:n]]

    def shaken(self, n: int) -> Bins:
        """Mutation: the n worst-filled bins are emptied and their items best-fitted."""
        fill = self.fill()
        worst = set(sorted(range(len(fill)), key=lambda g: (fill[g], g))[:n])
        child = Bins(self.sizes, self.room, [g for k, g in enumerate(self.groups) if k not in worst])
        child.best_fit([i for k in worst for i in self.groups[k]])
        return child


def from_patterns(sizes: list[int], patterns: list[list[int]]) -> list[list[int]]:
    """Bins of migrant length patterns, built from own items where these suffice."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by.setdefault(s, []).append(i)
    made = []
    for p in patterns:
        need: dict[int, int] = {}
        for s in p:
            need[s] = need.get(s, 0) + 1
        if all(len(by.get(s, ())) >= n for s, n in need.items()):
            made.append([by[s].pop() for s in p])
    return made


def evolve(sizes: list[int], room: int, start: list[list[int]] | None, patterns: list[list[int]], generations: int, seed: int) -> Bins:
    """The best grouping of one island after an epoch; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    first = Bins(sizes, room, start or [])
    if not start:
        first.best_fit(list(range(len(sizes))))
    least = -(-sum(sizes) // room)
    people = [first]
    if patterns:
        people.append(first.with_injected(from_patterns(sizes, patterns)))
    while len(people) < POPULATION and first.cost()[0] > least:
        some = rng.permutation(len(sizes))[: max(1, len(sizes) // 3)].tolist()
        other = Bins(sizes, room)
        other.best_fit(some)
        left = set(range(len(sizes))).difference(some)
        other.best_fit(sorted(left))
        people.append(other)
    people.sort(key=Bins.cost)
    for _ in range(generations):
        if people[0].cost()[0] <= least or len(people) < 2:
            break
        a, b = people[0], people[int(rng.integers(1, len(people)))]
        n = int(rng.integers(1, max(2, len(b.groups) // 4)))
        children = [a.with_injected(b.best_bins(n)), b.with_injected(a.best_bins(n)), people[0].shaken(max(2, len(people[0].groups) // 20))]
        people = sorted([*people, *children], key=Bins.cost)[:POPULATION]
    return people[0]


def _epoch(room: int, generations: int, seed: int, migrants: int):
    """One epoch of one island; rows with a pattern are migrants, the others pieces."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        patterns = [list(map(int, p)) for p in rows["pattern"].dropna()]
        own = rows[rows["pattern"].isna()].sort_values("uid", kind="stable").reset_index(drop=True)
        if not len(own):
            return own.assign(bin=pd.Series(dtype="int64"))[["island", "uid", "length", "bin", "fill", "pattern"]]
        start = None
        if own["bin"].notna().all():
            start = [list(map(int, g)) for g in own.groupby("bin", sort=True).indices.values()]
        best = evolve(own["length"].astype(int).tolist(), room, start, sorted(patterns), generations, seed + int(key[0]))
        of, fill = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        shown = {tuple(g) for g in best.best_bins(migrants)}
        patterns_out: list[list[int] | None] = [None] * len(own)
        for k, (g, f) in enumerate(zip(best.groups, best.fill(), strict=True)):
            of[g], fill[g] = k, f
            if tuple(g) in shown:
                patterns_out[g[0]] = sorted((int(own["length"][i]) for i in g), reverse=True)
        return pd.DataFrame({"island": own["island"], "uid": own["uid"], "length": own["length"], "bin": of, "fill": fill, "pattern": patterns_out})

    return run


def next_islands(left: int, islands: int, island_items: int) -> int | None:
    """On how many islands the pieces left are packed again; None where that would save too little."""
    wanted = max(1, -(-left // island_items))
    return wanted if left and wanted <= 0.9 * islands else None


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, island_items: int = ISLAND_ITEMS, epochs: int = 3) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(path or default_path(), length, end_id), _PIECE), "pack-pieces")
    short = pieces.where(F.col("length") < length).select("uid", "length")
    n = short.count()
    islands = max(1, -(-n // island_items))
    schema = "island long, uid long, length long, bin long, fill long, pattern array<long>"
    state = short.select(F.pmod(F.xxhash64("uid"), F.lit(islands)).alias("island"), "uid", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("fill"), F.lit(None).cast("array<long>").alias("pattern"))
    done: DataFrame | None = None
    for epoch in range(epochs):
        state = materialize(state.groupBy("island").applyInPandas(_epoch(length, GENERATIONS, SEED + 1000 * epoch, MIGRANTS), schema), "pack-epoch")
        if epoch + 1 < epochs:
            moved = state.where("pattern is not null").select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("fill"), "pattern")
            state = state.withColumn("pattern", F.lit(None).cast("array<long>")).unionByName(moved)
    level = 1
    while islands > 1:
        rest = state.where(F.col("fill") < F.lit(int(length * 0.985)))
        fewer = next_islands(rest.count(), islands, island_items)
        if fewer is None:
            break
        islands = fewer
        good = state.where(F.col("fill") >= F.lit(int(length * 0.985))).withColumn("level", F.lit(level - 1))
        done = good if done is None else done.unionByName(good)
        regrouped = rest.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands)).alias("island"), "uid", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("fill"), F.lit(None).cast("array<long>").alias("pattern"))
        state = materialize(regrouped.groupBy("island").applyInPandas(_epoch(length, GENERATIONS, SEED + 1000 * (epochs + level), 0), schema), "pack-level")
        level += 1
    last = state.withColumn("level", F.lit(level - 1))
    done = last if done is None else done.unionByName(last)
    # Sequence numbers: full pieces are negative, bins are (level, island, bin).
    numbered = done.select("uid", (F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft("island", 20) + F.col("bin")).alias("sequence_id"))
    placed = pieces.join(numbered, "uid", "left").withColumn("sequence_id", F.coalesce("sequence_id", -F.col("uid") - 1))
    # A sequence holds at most ``length`` pieces.
    ends = F.sum("length").over(_by_sequence())
    return placed.withColumn("offset", (ends - F.col("length")).cast("long")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _by_sequence():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Contract of query 3."""
    return pack(table(spark, sf_dir, "documents"))
