"""Converter from legacy ARC archives to WARC archives.

An ARC record is one header line, whose fields the archive's version block
names, and as many bytes as the line's last field declares.  The converter
parses both header versions and synthesises what a WARC record has besides:
record ids, ISO timestamps, record types, block and payload digests.  Records
are compressed one by one, as is usual for WARC files, and stream through tasks;
an archive is closed at a size.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

# Header fields of the two versions, in order, and the formats of lines.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL",
        "IP-address",
        "Archive-date",
        "Content-type",
        "Result-code",
        "Checksum",
        "Location",
        "Offset",
        "Filename",
        "Archive-length",
    ),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An archive is closed at so many bytes; a larger record makes a larger archive.
ARCHIVE_BYTES = 8 << 20
# Pages converted at a time; their ARC bytes are held in memory.
CONVERT_BYTES = 1 << 20

FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64())])
RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A record's URN: a custom (version 8) UUID that holds its number; null has one of its own."""
    n = (page_id or 0) % (1 << 64)
    value = (0xA2C0 if page_id is None else 0xA2C1) << 112 | (n >> 52) << 80 | 8 << 76
    value |= ((n >> 40) & 0xFFF) << 64 | 2 << 62 | (n & ((1 << 40) - 1))
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def record_number(urn: str) -> int | None:
    """The number that ``record_id`` was given."""
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 112 == 0xA2C0:
        return None
    n = (value >> 80 & 0xFFF) << 52 | (value >> 64 & 0xFFF) << 40 | value & ((1 << 40) - 1)
    return n - (1 << 64) if n >> 63 else n


def arc_field(text: str | None) -> str:
    """A value that can stand in a header line: blanks and control characters are percent-coded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text or "") or "-"


def arc_bytes(records: Iterable[tuple[str | None, str, bytes]], version: int) -> bytes:
    """An ARC archive of (url, 14-digit date, content block) records."""
    body = f"{version} 0 narrate\n{' '.join(FIELDS[version])}\n".encode()
    out = io.BytesIO()
    out.write(f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain {'200 - - 0 pages.arc ' * (version == 2)}{len(body)}\n".encode())
    out.write(body + b"\n")
    for url, date, block in records:
        more = f"200 {sha1_base32(block)} - {out.tell()} pages.arc " if version == 2 else ""
        line = f"{arc_field(url)} 0.0.0.0 {date} text/html {more}{len(block)}\n"
        out.write(line.encode("utf-8", "surrogatepass") + block + b"\n")
    return out.getvalue()


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content block of each record of an ARC archive.

    The version block says which fields header lines have.  A URL may hold blanks,
    so fields are counted from the right.  A declared length that reaches beyond
    the archive is a ValueError.
    """
    at, fields = 0, ()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without end")
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) != length:
            raise ValueError("a record shorter than declared")
        at = end + 1 + length
        if line.startswith("filedesc:"):
            fields = FIELDS[int(block.split(b" ", 1)[0])]
            continue
        if not fields:
            raise ValueError("no version block")
        yield dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a content block; without a header, all is payload."""
    if block.startswith(b"HTTP/") and b"\r\n\r\n" in block:
        head, _, payload = block.partition(b"\r\n\r\n")
        return head + b"\r\n\r\n", payload
    return b"", block


def warc_record(fields: dict[str, str], block: bytes, number: int | None, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC record of an ARC record; a revisit keeps the HTTP header only."""
    head, payload = split_http(block)
    d = fields["Archive-date"].ljust(14, "0")
    kept = head if revisit else block
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(number)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", fields["URL"]),
        ("WARC-IP-Address", fields["IP-address"]),
        ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"]),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(kept)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines.append(("Content-Length", str(len(kept))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + kept + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


# Compressed bytes that a record is read by; what is left of them behind its end is read again.
READ_BYTES = 8 << 10


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content block of each record of a compressed WARC archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, pieces = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("a damaged WARC record")
            pieces.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        record = b"".join(pieces)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        if not version.startswith("WARC/") or len(rest) != len(block) + 4:
            raise ValueError("a damaged WARC record")
        yield fields, block


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add ``is_revisit`` and ``refers_to``: of equal payloads of ``least`` bytes on, the largest page_id is kept."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest")
    )
    # only payloads that are there more than once; grouping sums up within each task first
    copies = (
        pages.groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "largest")
    )
    other = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length("html") >= least)
    return pages.join(copies, "digest", "left").select(
        "page_id", "url", "html", F.when(other, F.col("largest")).alias("refers_to")
    )


# What a record takes besides its url and html.
RECORD_BYTES = 500


def write_warc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) as ARC records, convert them and write WARC archives.

    Returns one row an archive.  Every other group of pages is written in the second
    ARC version.  A null url is ``-``, a null html an empty payload; repeated rows
    are repeated records.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    folder = common.shared_folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        archive: list[bytes] = []
        size = written = 0

        def convert() -> None:
            blocks = []
            for page_id, url, html, _ in held:
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                day = (page_id or 0) % 28 + 1
                blocks.append((url, f"202401{day:02d}000000", head.encode() + payload))
            # held rows and records are in one order
            for (page_id, _, _, refers_to), (fields, block) in zip(held, arc_records(arc_bytes(blocks, groups % 2 + 1)), strict=True):
                archive.append(member(warc_record(fields, block, page_id, refers_to, refers_to is not None)))

        def close() -> pa.RecordBatch:
            name = common.put_file(folder, f"pages-{part:06d}.warc.gz", archive)
            return common.batch({"part": [part], "file": [name], "records": [len(archive)]}, FILES)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(row)
                # also a page without html is a record
                size += len(row[2] or "") + len(row[1] or "") + RECORD_BYTES
                if size >= CONVERT_BYTES:
                    convert()
                    held.clear()
                    groups, written, size = groups + 1, written + size, 0
                    if written >= 4 * archive_bytes:  # pages shrink to about a quarter
                        yield close()
                        archive.clear()
                        written = 0
        if held:
            convert()
        if archive:
            yield close()

    return common.stored(
        pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "part int, file string, records bigint")
    )


def read_warc(files: DataFrame) -> DataFrame:
    """One row a record; payload digests of responses are computed anew and compared."""
    slices = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                out: dict[str, list] = {f.name: [] for f in RECORD}
                for fields, block in warc_records(common.get_file(name)):
                    head, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError("a payload that does not match its digest")
                    declared = [h for h in head.decode().split("\r\n") if h.startswith("Content-Length: ")]
                    values = (
                        record_number(fields["WARC-Record-ID"]),
                        int(declared[0].split(": ")[1]) if revisit else len(payload),
                        digest,
                        fields["WARC-Type"],
                        record_number(fields["WARC-Refers-To"]) if revisit else None,
                        fields["WARC-Target-URI"],
                        fields["WARC-Date"],
                    )
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                yield common.batch(out, RECORD)

    return (
        files.select("file")
        .repartition(slices, "file")
        .mapInArrow(
            read,
            "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint,"
            " target_uri string, date string",
        )
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` through ARC into WARC archives, and read back."""
    return read_warc(write_warc(mark_revisits(common.table(spark, sf_dir, "pages"))))
