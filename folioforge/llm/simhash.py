"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints are computed over whole texts in Arrow batches.  Equal fingerprints
are folded first (partial aggregation), so a group of exact copies, however
large, is one row afterwards.  Distinct fingerprints are dealt to the six
buckets named by two of their four 16-bit blocks: two fingerprints that differ
in at most two bits agree on at least two blocks, so no pair is missed.  Within
sorted buckets the 64 bit planes are stored vertically, 64 lanes to a machine
word; distances of all lanes grow by carry-save counters, plane by plane, and
words whose lanes all exceed the radius are abandoned.  A bucket that exceeds
``bucket_rows`` is cut into cells of which each pair is compared on its own, so
no task holds an unbounded bucket and no pair is lost.  From each bucket only a
spanning star of its links leaves; components come from alternating large-star
and small-star rounds.

Edge cases: a null or blank text has no words and fingerprint zero, which links
like any other; null ids stay in the result with their component (null only if
no member has an id); repeated rows each appear once; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialize, prepare

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words, repeats included; A-Z lower-cased, XXH64 with seed 42."""
    from xxhash import xxh64_intdigest as h64

    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - width + 1
    if n <= 1:
        hashes = np.array([h64(b" ".join(words), 42)], dtype=np.uint64)
        n = 1
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1]))
        stops = ends[width - 1 :] - 1
        hashes = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(2048, np.int64)
    by = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):
        counts += np.bincount((by[at : at + (1 << 16)] + _PLACE).ravel(), minlength=2048)
    ones = np.concatenate([c @ _BITS for c in counts.reshape(8, 256)])
    return int(np.bitwise_or.reduce(_POWERS[2 * ones > n], initial=np.uint64(0)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        made = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64-bit fingerprint as a signed long) of every row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class Planes:
    """Bit planes of a run of fingerprints: plane b holds bit b of all lanes, 64 lanes to a word."""

    def __init__(self, fps: np.ndarray):
        self.words = (len(fps) + 63) // 64
        padded = np.zeros(self.words * 64, np.uint64)
        padded[: len(fps)] = fps
        by = padded.view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(by, axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = np.zeros((64, self.words + 2), np.uint64)
        self.planes[:, : self.words] = np.ascontiguousarray(packed).view(np.uint64)

    def shifted(self, plane: int, words: np.ndarray, d: int) -> np.ndarray:
        """The plane's bits of lanes i + d for the lanes i of the given words."""
        q, r = divmod(d, 64)
        row = self.planes[plane]
        at = np.minimum(words + q, self.words)
        low = row[at] >> np.uint64(r)
        return low if r == 0 else low | (row[np.minimum(at + 1, self.words + 1)] << np.uint64(64 - r))


def _lanes(mask: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


def close_at(planes: Planes, d: int, mask: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i (where mask) whose distance to lane i + d is at most ``radius``."""
    alive = _lanes(mask, planes.words)
    words = np.flatnonzero(alive)
    alive = alive[words]
    digits = max(1, int(radius).bit_length())
    count = [np.zeros(len(words), np.uint64) for _ in range(digits)]
    over = np.zeros(len(words), np.uint64)
    for b in range(64):
        carry = planes.planes[b][words] ^ planes.shifted(b, words, d)
        for k in range(digits):  # carry-save: each digit keeps its sum and hands on its carry
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 4 == 3 or b == 63:
            beyond = over.copy()
            greater, equal = np.zeros_like(over), ~np.zeros_like(over)
            for k in reversed(range(digits)):
                bit = np.uint64(0xFFFFFFFFFFFFFFFF) if radius >> k & 1 else np.uint64(0)
                greater |= equal & count[k] & ~bit
                equal &= ~(count[k] ^ bit)
            live = alive & ~(beyond | greater)
            keep = live != 0
            if not keep.all():
                words, alive, over, live = words[keep], live[keep], over[keep], live[keep]
                count = [c[keep] for c in count]
            else:
                alive = live
            if not len(words):
                return np.zeros(0, np.int64)
    bits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    at, lane = np.nonzero(bits)
    return words[at] * 64 + lane


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, root) of the components that the links make among n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def compare_sorted(run: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal run number (ascending).

    ``side``: 0 compares within the row's run, 1 and 2 only one with the other.
    """
    n = len(fps)
    bounds = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(n) - 1  # rows of the run that follow
    planes = Planes(fps)
    found_a, found_b = [], []
    for d in range(1, int(sizes.max(initial=1))):
        mask = left >= d
        mask[: n - d] &= (side[: n - d] == 0) | (side[: n - d] != side[d:])
        if mask.any():
            hit = close_at(planes, d, mask, radius)
            found_a.append(hit)
            found_b.append(hit + d)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(found_a), np.concatenate(found_b), n)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, cell, side, fp = rows
            change = np.concatenate(([False], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            member, root = compare_sorted(np.cumsum(change), fp.view(np.uint64), side, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            held.append(rows)
            if sum(len(r[0]) for r in held) < 50_000:
                continue
            rows = tuple(map(np.concatenate, zip(*held, strict=True)))
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))
            if cut:
                yield flush(tuple(r[:cut] for r in rows))
            held = [tuple(r[cut:] for r in rows)]
        if held:
            yield flush(tuple(map(np.concatenate, zip(*held, strict=True))))

    return run



def links(distinct: DataFrame, radius: int = 2, bucket_rows: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``radius`` (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to a radius of 2")
    spark = distinct.sparkSession
    prepare(spark)
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    keys = F.array(*[F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(pairs)])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    rows = rows.join(large, "key", "left")
    chunks = F.ceil(F.col("n") / F.lit(bucket_rows // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
    # The cell (i, j), i <= j, holds the chunks i and j; a row of chunk c goes to every cell that names c.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(
            (F.least(o, F.col("mine")) * F.col("chunks") + F.greatest(o, F.col("mine"))).cast("long").alias("cell"),
            F.when(o == F.col("mine"), 0).when(o > F.col("mine"), 1).otherwise(2).cast("int").alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("int").alias("side")))
    dealt = (
        rows.withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .select("key", "fp", F.explode(F.when(F.col("n").isNull(), alone).otherwise(cells)).alias("c"))
        .select("key", F.col("c.cell").alias("cell"), F.col("c.side").alias("side"), "fp")
        .repartition("key", "cell")
        .sortWithinPartitions("key", "cell", "fp")
    )
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link, root the smallest node it reaches; large-star, small-star."""

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    e = materialize(tidy(edges), name)
    mark = None
    while True:
        # Star roots: all links of a node go to one smaller node that has no smaller neighbour itself.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = materialize(tidy(small), name)


def near_duplicates(docs: DataFrame, radius: int = 2, bucket_rows: int = 8192) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links) for every row of ``docs``."""
    marked = materialize(fingerprints(docs), "simhash-fp")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    found = components(links(classes.select("fp"), radius, bucket_rows))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, bucket_rows: int = 8192) -> DataFrame:
    """The rows of ``docs`` (all columns) with one row for each component: that of the smallest doc_id.

    Of rows equal in id and fingerprint, the one whose text, then whose other columns hash smallest stays.
    """
    from pyspark.sql.types import LongType, StructType

    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, "__fp"])

    marked = materialize(docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("__fp", LongType())), "simhash-docs")
    classes = materialize(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("first")), "simhash-classes")
    found = components(links(classes.select("fp"), radius, bucket_rows))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    order = F.struct(F.col("first").isNull().alias("missing"), "first", "fp")
    chosen = rooted.groupBy("root").agg(F.min_by(F.struct("fp", "first"), order).alias("x")).select(F.col("x.fp").alias("__keep_fp"), F.col("x.first").alias("__keep_id"))
    chosen = materialize(chosen, "simhash-kept")
    kept = marked.join(chosen, (F.col("__fp") == F.col("__keep_fp")) & F.col("doc_id").eqNullSafe(F.col("__keep_id")), "left_semi")
    again = kept.groupBy("doc_id", "__fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__keep_id"), F.col("__fp").alias("__keep_fp"))
    again = materialize(again, "simhash-repeats")
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = (F.col("__fp") == F.col("__keep_fp")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    names = list(docs.columns)
    plain = [c for c in names if not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    first = kept.join(again, same, "left_semi").groupBy("doc_id", "__fp").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64("text"), F.xxhash64(*plain))).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").select(*names).unionByName(first)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of query 10: doc_id, fingerprint (hex), component_id."""
    from folioforge.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
