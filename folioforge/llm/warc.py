"""Dictionary-compressed WARC archives.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary trained on the first records it archives; every record follows as a
frame of its own, compressed with that dictionary, so any record can be read
alone. Of equal payloads of at least ``least`` bytes, the one with the smallest
page_id is a response record, the others are revisit records without payload
that name its record id, url and page_id.

Which payloads repeat is decided on digests alone; only these are joined back to
the pages, so a very common payload gathers in no task.

Files are written under a temporary name and renamed, so a retried task leaves
one whole file.

Edge cases: null html is an empty payload; a null page_id is smallest only
where no other row of its payload has an id; rows that share the smallest id of a payload are all
responses (equal rows share one record id); extra columns are ignored; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import BROADCAST_ROWS, materialize, new_folder, prepare, table
from folioforge.llm.token_store import open_fs

SKIPPABLE = 0x184D2A5D
#: Bytes of records held to train a file's dictionary, the dictionary's size, and the level.
TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 4 << 20, 64 << 10, 3
#: The pages have no time of their own; archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: Parts of a payload's pages where the repeated payloads are too many to broadcast.
SALTS = 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha1: str, revisit: bool) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{sha1}|{revisit}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC 1.1 record."""
    body, sha1 = b"" if revisit else payload, digest(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, sha1, revisit)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + _uri(url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines += [f"WARC-Refers-To: {record_id(refers_to, refers_url, sha1, False)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class Writer:
    """Holds the first records to train the dictionary, then streams."""

    def __init__(self, sink, train_bytes: int = TRAIN_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL):
        self.sink, self.train_bytes, self.dictionary_bytes, self.level = sink, train_bytes, dictionary_bytes, level
        self.held: list[bytes] = []
        self.size = self.count = 0
        self.compressor = None

    def _start(self) -> None:
        import zstandard

        try:
            made = zstandard.train_dictionary(self.dictionary_bytes, self.held)
        except zstandard.ZstdError:  # too few or too small records: their own bytes serve as a raw dictionary
            made = zstandard.ZstdCompressionDict(b"".join(self.held)[: self.dictionary_bytes].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = made.as_bytes()
        self.sink.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=made)
        for r in self.held:
            self.sink.write(self.compressor.compress(r))
        self.held = []

    def add(self, raw: bytes) -> None:
        self.count += 1
        if self.compressor is None:
            self.held.append(raw)
            self.size += len(raw)
            if self.size >= self.train_bytes:
                self._start()
        else:
            self.sink.write(self.compressor.compress(raw))

    def close(self) -> int:
        if self.compressor is None and self.held:
            self._start()
        return self.count


def read_records(source) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    import zstandard

    head = source.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = source.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    data = b""  # a short buffer, as what follows a frame in it is copied
    while True:
        data = data or source.read(1 << 16)
        if not data:
            return
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = source.read(1 << 16)
            if not data:
                raise ValueError("archive ends within a record")
        yield b"".join(parts)


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        name = f"part-{part_id:08d}.warc.zst"
        fs, at = open_fs(folder)
        sink = writer = part = None
        for b in batches:
            for page_id, url, html, refers, refers_url, revisit in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    part = f"{at}/.{name}-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(part, compression=None)
                    writer = Writer(sink)
                writer.add(record(page_id, url, (html or "").encode(), refers, refers_url, revisit, date))
        if writer is not None:
            n = writer.close()
            sink.close()
            fs.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["name", "records"])

    return run


def marked(pages: DataFrame, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, refers_to, refers_url, revisit: which rows repeat the payload of a smaller page_id."""
    rows = pages.select("page_id", "url", "html").withColumn("key", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"))
    firsts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.min_by("url", order).alias("refers_url")).where("n > 1 AND first IS NOT NULL")
    firsts = materialize(firsts.select("key", "first", "refers_url"), "warc-repeats")
    if firsts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = rows.join(F.broadcast(firsts), "key", "left")
    else:  # pages of one payload go to several tasks
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    found = found.withColumn("revisit", revisit)
    return found.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), F.when(F.col("revisit"), F.col("refers_url")).alias("refers_url"), "revisit")


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Write one archive per partition; returns the manifest (name, records)."""
    prepare(pages.sparkSession)
    return materialize(marked(pages, least).mapInArrow(_write(folder, date), "name string, records long"), "warc-manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{at}/{name}", compression=None) as source:
                    for raw in read_records(source):
                        fields, body = parse(raw)
                        revisit = fields["warc-type"] == "revisit"
                        noted = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (digest(body) != noted or len(body) != int(fields["x-payload-length"])):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page = fields.get("x-page-id")
                        refers = fields.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), int(fields["x-payload-length"]), noted, fields["warc-type"], None if refers is None else int(refers)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every archived record."""
    files = manifest.select("name").repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Contract of query 5."""
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


def oracle() -> str:
    """DuckDB SQL of query 5."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(format('{:b}', instr('0123456789abcdef', h[i::BIGINT]) - 1), 4, '0')), '') AS b FROM d),
b32 AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
  list_sum(list_transform(range(1, 6), lambda j: b[(5 * i + j)::BIGINT]::BIGINT * (1 << (5 - j)::BIGINT)))::BIGINT]), '') AS payload_digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM b32)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
