"""Token-id shards with a minimal perfect hash index.

Documents are dealt by ranges of doc_id (equal ids further by row number, so a
repeated id never gathers in one task) and sorted; each task encodes its
documents and streams one shard:

    magic  "FFTOK2\\0\\0", then u32 id bytes (2 or 4), u64 documents, u64 ids
    payload  raw little-endian ids, documents in order
    table    u64 documents and ids; i64 doc_id, u8 null flag and u64 first id, per document
    index    u32 levels; per level u64 bits, u64 slots before each run of 8 words, and its bitmap;
             u64 keys; u32 fingerprint and u32 first document number per slot
    footer   u64 offsets of table and index, magic

The index is built per shard over its distinct ids: level after level, keys
alone in their hashed place set its bit, the others go on to the next level; a
key's slot is the rank of its bit, so n keys have exactly the slots 0..n-1. A
stored fingerprint tells absent keys. The manifest holds each shard's range of
keys, so a keyed read opens the shard of its key and reads a run of words for each
level tried (about two), one slot, one row of the table and the ids: a constant
number of bytes besides the ids, however large the shard.

Edge cases: null and empty texts hold only the end id; null ids sort first and
are read by position, as the index has no key for them; repeated ids are
adjacent, the index names the first; ids that do not fit ``id_bytes`` raise an
error before anything is written; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialize, new_folder, prepare, table
from folioforge.llm.encoding import default_path, encoder

MAGIC, END_ID, LEVELS, RUN = b"FFTOK2\0\0", 2, 64, 8


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys."""
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: bitmaps by level, slot by rank."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels
        self.ranks = []
        total = 0
        for _, bitmap in levels:
            counts = np.bitwise_count(bitmap).astype(np.int64)
            self.ranks.append(total + np.concatenate(([0], np.cumsum(counts)))[:-1])
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            bits = max(64, 2 * len(left))
            at = (mix(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits)[at] == 1
            bitmap = np.zeros(-(-bits // 64), np.uint64)
            np.bitwise_or.at(bitmap, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append((bits, bitmap))
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, bitmap) in enumerate(self.levels):
            at = (mix(keys[left], k) % np.uint64(bits)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bitmap[word] >> bit) & np.uint64(1) == 1
            below = bitmap[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot[left[hit]] = self.ranks[k][word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return slot


def open_fs(uri: str):
    """The file system and path of a URI, whichever store it names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


class ShardWriter:
    def __init__(self, sink, id_bytes: int):
        self.sink, self.dtype = sink, f"<u{id_bytes}"
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.ids = self.at = 0
        self._put(MAGIC + struct.pack("<I", id_bytes))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.keys.append(doc_ids.fill_null(0).to_numpy())
        self.firsts.append(self.ids + bounds[:-1])
        self._put(ids.astype(self.dtype).tobytes())
        self.ids += int(bounds[-1])

    def close(self) -> tuple[int, int, int | None, int | None]:
        keys, nulls, firsts = (np.concatenate(x) for x in (self.keys, self.nulls, self.firsts))
        table_at = self.at
        self._put(struct.pack("<QQ", len(keys), self.ids) + keys.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + firsts.astype("<u8").tobytes())
        index_at = self.at
        numbers = np.flatnonzero(~nulls)
        distinct, first = np.unique(keys[numbers], return_index=True)
        hashed = PerfectHash.build(distinct)
        slots = hashed.slots(distinct)
        prints, number = np.zeros(hashed.size, "<u4"), np.zeros(hashed.size, "<u4")
        prints[slots] = (mix(distinct, 10_007) >> np.uint64(32)).astype("<u4")
        number[slots] = numbers[first]
        self._put(struct.pack("<I", len(hashed.levels)))
        for (bits, bitmap), ranks in zip(hashed.levels, hashed.ranks, strict=True):
            self._put(struct.pack("<Q", bits) + ranks[::RUN].astype("<u8").tobytes() + bitmap.astype("<u8").tobytes())
        self._put(struct.pack("<Q", hashed.size) + prints.tobytes() + number.tobytes() + struct.pack("<QQ", table_at, index_at) + MAGIC)
        return len(keys), self.ids, *((int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None))


def read_key(source, key: int) -> np.ndarray | None:
    """Ids of the (first) document of a key, by a constant number of small reads; None if the shard lacks it."""

    def get(form: str, at: int) -> tuple:
        source.seek(at)
        return struct.unpack(form, source.read(struct.calcsize(form)))

    end = source.size()
    table_at, index_at, magic = get("<QQ8s", end - 24)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    keys = np.array([key], np.int64)
    (levels,), at, slot = get("<I", index_at), index_at + 4, None
    for k in range(levels):
        (bits,) = get("<Q", at)
        words = -(-bits // 64)
        runs = -(-words // RUN)
        if slot is None:
            bit = int((mix(keys, k) % np.uint64(bits))[0])
            run, word = divmod(bit >> 6, RUN)
            held = get(f"<{min(RUN, words - run * RUN)}Q", at + 8 + 8 * (runs + run * RUN))
            if held[word] >> (bit & 63) & 1:
                below = [*held[:word], held[word] & ((1 << (bit & 63)) - 1)]
                slot = get("<Q", at + 8 + 8 * run)[0] + sum(w.bit_count() for w in below)
        at += 8 + 8 * (runs + words)
    if slot is None:
        return None
    (slots,) = get("<Q", at)
    (held,) = get("<I", at + 8 + 4 * slot)
    if held != int((mix(keys, 10_007) >> np.uint64(32))[0]):
        return None
    (number,) = get("<I", at + 8 + 4 * (slots + slot))
    n, ids = get("<QQ", table_at)
    if get("<q", table_at + 16 + 8 * number)[0] != key:
        return None
    firsts = table_at + 16 + 9 * n
    first, stop = get("<QQ", firsts + 8 * number) if number + 1 < n else (get("<Q", firsts + 8 * number)[0], ids)
    (id_bytes,) = get("<I", 8)
    source.seek(12 + first * id_bytes)
    return np.frombuffer(source.read((stop - first) * id_bytes), f"<u{id_bytes}")


class ShardReader:
    """Keyed and positional access to one shard for many keys; table and index stay in memory."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        head, foot = self._get(0, 12), self._get(size - 24, 24)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError("not a token shard")
        self.id_bytes = struct.unpack("<I", head[8:])[0]
        table_at, index_at = struct.unpack("<QQ", foot[:16])
        raw = self._get(table_at, index_at - table_at)
        n, self.ids = struct.unpack("<QQ", raw[:16])
        self.keys = np.frombuffer(raw, "<i8", n, 16)
        self.nulls = np.frombuffer(raw, "u1", n, 16 + 8 * n).astype(bool)
        self.blank = int(self.nulls.sum())
        self.firsts = np.append(np.frombuffer(raw, "<u8", n, 16 + 9 * n).astype(np.int64), self.ids)
        raw = self._get(index_at, size - 24 - index_at)
        (count,), at, levels = struct.unpack("<I", raw[:4]), 4, []
        for _ in range(count):
            (bits,) = struct.unpack("<Q", raw[at : at + 8])
            words = -(-bits // 64)
            at += 8 + 8 * -(-words // RUN)
            levels.append((bits, np.frombuffer(raw, "<u8", words, at)))
            at += 8 * words
        (slots,) = struct.unpack("<Q", raw[at : at + 8])
        self.hash = PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", slots, at + 8)
        self.number = np.frombuffer(raw, "<u4", slots, at + 8 + 4 * slots)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document with each key, -1 where the shard has none."""
        slot = self.hash.slots(keys)
        found = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == (mix(keys[hit], 10_007) >> np.uint64(32)).astype("<u4")]
        number = self.number[slot[hit]].astype(np.int64)
        same = self.keys[number] == keys[hit]
        found[hit[same]] = number[same]
        return found

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids of the documents numbered first to end - 1."""
        a, z = int(self.firsts[first]), int(self.firsts[end])
        return np.frombuffer(self._get(12 + a * self.id_bytes, (z - a) * self.id_bytes), f"<u{self.id_bytes}")


def _write(folder: str, path: str, end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():08d}.tok"
        fs, at = open_fs(folder)
        fs.create_dir(at, recursive=True)
        part, writer, sink = f"{at}/.{name}-{uuid.uuid4().hex}", None, None
        enc, seen = encoder(path), False
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(part, compression=None)
                writer = ShardWriter(sink, id_bytes)
            seen = True
            ids, bounds = enc.encode(b.column(1))
            n = len(bounds) - 1
            joined = np.full(len(ids) + n, end_id, f"<u{id_bytes}")
            joined[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            writer.add(b.column(0), joined, bounds + np.arange(n + 1))
        if seen:
            docs, ids, low, high = writer.close()
            sink.close()
            fs.move(part, f"{at}/{name}")  # a retried task puts the same bytes in the same place
            yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId()]), pa.array([name]), pa.array([docs]), pa.array([ids]), pa.array([low], pa.int64()), pa.array([high], pa.int64())], ["shard", "name", "docs", "ids", "low", "high"])

    return run


def id_width(path: str, end_id: int, id_bytes: int | None = None) -> int:
    """Bytes of an id: as asked, if the vocabulary and the end id fit, else as they need."""
    largest = max(encoder(path).tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
    needed = 2 if max(largest, end_id) < 1 << 16 else 4
    if id_bytes is None:
        return needed
    if id_bytes < needed:
        raise ValueError(f"ids up to {max(largest, end_id)} need {needed} bytes")
    return id_bytes


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards; returns the manifest (shard, name, docs, ids, low, high: the range of keys), one row per shard."""
    spark = docs.sparkSession
    prepare(spark)
    id_bytes = id_width(path or default_path(), end_id, id_bytes)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    return materialize(ranged.select("doc_id", "text").mapInArrow(_write(folder, path or default_path(), end_id, id_bytes), "shard long, name string, docs long, ids long, low long, high long"), "tokens-manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{name}") as source:
                    shard = ShardReader(source)
                    # Every key is found through the index; repeats follow the first document of their id, null ids come first.
                    for a in range(0, len(shard.keys), 1000):
                        z = min(a + 1000, len(shard.keys))
                        keys, nulls = shard.keys[a:z], shard.nulls[a:z]
                        number = np.where(nulls, np.arange(a, z), shard.find(keys))
                        if (number < 0).any():
                            raise ValueError(f"{name}: the index lacks a key")
                        number += np.where(nulls, 0, np.arange(a, z) - np.searchsorted(shard.keys[shard.blank :], keys) - shard.blank)
                        low = int(number.min())
                        ids = shard.read(low, int(number.max()) + 1).astype("<u4")
                        first, stop = shard.firsts[number], shard.firsts[number + 1]
                        begin = shard.firsts[low]
                        crc = [zlib.crc32(ids[p:q].tobytes()) for p, q in zip((first - begin).tolist(), (stop - begin).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=nulls), pa.array(base + first), pa.array(stop - first), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    return run


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards."""
    spark = manifest.sparkSession
    # One row per shard of many megabytes comes to the driver.
    rows, base, placed = sorted(manifest.collect(), key=lambda r: r.shard), 0, []
    for r in rows:
        placed.append((r.name, base))
        base += r.ids
    files = spark.createDataFrame(placed, "name string, base long").repartition(max(1, len(placed)), "name")
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document by its key (the first, if the id repeats); None if there is none.

    Only shards whose range holds the key are opened: one, or the few that share a repeated id.
    """
    fs, at = open_fs(folder)
    for r in manifest.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("shard").collect():
        with fs.open_input_file(f"{at}/{os.path.basename(r.name)}") as source:
            found = read_key(source, doc_id)
            if found is not None:
                return found
    return None


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    """Contract of query 7."""
    folder = new_folder(spark, "tokens")
    manifest = write_store(table(spark, sf_dir, "documents"), folder)
    return read_store(manifest, folder)
