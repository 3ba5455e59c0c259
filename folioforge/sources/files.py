"""Documents from files: text, Word, images and PDF envelopes, read by Spark from any store it can open."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type and media type by extension.
KINDS = {"pdf": "pdf", "docx": "docx", "txt": "text", "md": "text", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image"}
MIMES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp",
}
ENCODINGS = ("utf-8", "utf-8-sig", "cp1258", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def decode(content: bytes) -> str:
    """The text of bytes in the first encoding that fits; a leading byte-order mark goes."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def docx_text(content: bytes) -> str:
    """Paragraphs and table rows (cells joined by a bar) of a Word file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            lines.append(said(e))
        elif e.tag == f"{_W}tbl":
            lines += [" | ".join(said(c) for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
    return "\n".join(lines)


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of PNG, BMP, WebP (lossy) or JPEG bytes."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:4] == b"RIFF" and content[8:16] == b"WEBPVP8 " and len(content) >= 30:
        w, h = struct.unpack("<HH", content[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            mark, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def _parse(kind: str, content: bytes) -> tuple:
    """text, page count, width, height, error."""
    try:
        if kind == "text":
            return decode(content), 1, None, None, None
        if kind == "docx":
            return docx_text(content), 1, None, None, None
        if kind == "image":
            w, h = image_size(content) or (None, None)
            return "", 1, w, h, None if w else "unknown image header"
        return "", len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content)), None, None, None if content[:5] == b"%PDF-" else "no PDF header"
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, struct.error) as e:
        return "", 0, None, None, f"{type(e).__name__}: {e}"[:200]


def load(spark: SparkSession, path: str, max_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """One row per supported file below ``path``.

    document_id (from the content), path, document_type, mime, size, sha256, text,
    page_count, width, height, error. Files of other types are left out; a file over
    ``max_bytes`` is not opened and keeps its row with an error. Broken files keep
    their row with an error; text of PDF and images is empty, as nothing reads glyphs.
    Files of no bytes give no row: Spark's file reader passes over them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.select("path", F.col("length").alias("size"), _lookup(KINDS, ext).alias("document_type"), _lookup(MIMES, ext).alias("mime"), "content").where("document_type IS NOT NULL")
    files = files.withColumn("sha256", F.when(F.col("size") <= max_bytes, F.sha2("content", 256)))
    files = files.withColumn("content", F.when(F.col("size") <= max_bytes, F.col("content")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_parse(k, bytes(c)) if c is not None else ("", 0, None, None, "over the size limit") for k, c in zip(b.document_type, b.content)]
            rest = pd.DataFrame(found, columns=["text", "page_count", "width", "height", "error"], index=b.index, dtype=object)
            yield pd.concat([b.drop(columns="content"), rest], axis=1)

    out = files.mapInPandas(parse, "path string, size long, document_type string, mime string, sha256 string, text string, page_count int, width int, height int, error string")
    return out.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.coalesce("sha256", F.sha2(F.col("path"), 256)), 1, 16)))


def select_pages(pages: DataFrame, first: int | None = None, last: int | None = None, most: int | None = None, key: str = "document_id") -> DataFrame:
    """Pages from first to last, of these the first ``most`` of each document."""
    if first is not None:
        pages = pages.where(F.col("page_number") >= first)
    if last is not None:
        pages = pages.where(F.col("page_number") <= last)
    if most is not None:
        if first is not None:
            return pages.where(F.col("page_number") < max(first, 1) + most)
        return pages.where(F.col("page_number") <= most)
    return pages


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_parquet(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by the columns named."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
