"""Token files: one id array, document boundaries in Elias-Fano form.

A file holds the ids of a run of documents in ascending ``doc_id`` order:

    magic 4 bytes | counts: documents, ids, null doc_ids, smallest doc_id (8 bytes each)
    | id width (1 byte) | boundary list | doc_id list | ids

A monotone list is stored as low bits, packed, and high bits in unary, about two
bits a value plus the low bits.  ``select`` finds the i-th value from a sample
of the unary bits, without unpacking the list and without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrate_spark.llm import common, tokens

MAGIC = b"EFT1"
END_ID = 2
# A file is closed when it holds so many ids; a longer document has one of its own.
FILE_IDS = 1 << 21
# One sample for so many values.
SAMPLE = 256

MANIFEST = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
)
ENTRY = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


class EliasFano:
    """A monotone list of numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Encode ascending values."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(
            n,
            bits,
            np.packbits(low.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4"),
        )

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The list stored at a place of a file, and the place behind it."""
        n, bits, n_low, n_high, n_samples = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", n_samples, at)), at + 4 * n_samples

    def select(self, i: int) -> int:
        """The i-th value: jump to the sample before it, then count ones."""
        place = int(self.samples[i // SAMPLE])
        byte, left = place >> 3, i % SAMPLE
        word = self.high[byte] >> (place & 7) << (place & 7)
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little") >> (first & 7)
        return ((one - i) << self.low_bits) | (low & ((1 << self.low_bits) - 1))

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little")
            weights = np.int64(1) << np.arange(self.low_bits)
            out = out + bits.reshape(self.n, self.low_bits).astype(np.int64) @ weights
        return out


def file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> Iterator[bytes]:
    """A token file of documents in ascending order (nulls first); ids are 32-bit."""
    ends = np.cumsum([len(x) // 4 for x in ids])
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    yield MAGIC + struct.pack("<QQQqB", len(ids), len(flat), nulls, least, width)
    yield EliasFano.of(ends).to_bytes()
    yield EliasFano.of(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
    yield flat.astype("<u2" if width == 2 else "<u4").tobytes()


class TokenFile:
    """Random access to the documents of a token file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, self.nulls, self.least, width = struct.unpack_from("<QQQqB", data, 4)
        self.ends, at = EliasFano.read(data, 4 + struct.calcsize("<QQQqB"))
        self.known, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        known = self.known.values().astype(np.uint64) + np.uint64(self.least % (1 << 64))
        return [None] * self.nulls + known.astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        start = self.ends.select(i - 1) if i else 0
        return self.ids[start : self.ends.select(i)].astype("<u4")


def write_token_files(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode whole texts and write them as token files in ascending doc_id order.

    Returns the manifest, one row a file, in order of (part, seq).  A null text is
    empty, so every document has its end id; null doc_ids come first; rows of one
    doc_id stay separate documents, ordered by text.  An empty table gives no file.
    Other columns are not read.
    """
    spark = docs.sparkSession
    folder = common.shared_folder(spark)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        file = path or tokens.public_path("byte_bpe_50k.json")
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = common.put_file(folder, f"tokens-{part:06d}-{seq:06d}", file_bytes(names, ids))
            return common.batch(
                {"part": [part], "seq": [seq], "file": [name], "n_docs": [len(ids)], "n_ids": [size // 4]}, MANIFEST
            )

        for b in batches:
            texts = tokens.encode_all(file, True, b.column("text").to_pylist())
            for doc, raw in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                names.append(doc)
                ids.append(raw + end)
                size += len(ids[-1])
                if size >= 4 * file_ids:
                    yield close()
                    seq, size = seq + 1, 0
                    ids.clear()
                    names.clear()
        if ids:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # rows that share a doc_id are dealt by how their texts begin
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return common.stored(
        ordered.mapInArrow(write, "part int, seq int, file string, n_docs bigint, n_ids bigint")
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, read back from its file: place, number and CRC-32 of its ids."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row a partition of the writing job goes through this window
    before = parts.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before")
    )
    files = manifest.join(before, "part").withColumn(
        "first",
        F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"),
    )
    slices = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                file = TokenFile(common.get_file(name))
                docs = file.doc_ids()
                for at in range(0, len(docs), 4096):
                    some = docs[at : at + 4096]
                    arrays = [file.document(at + i) for i in range(len(some))]
                    sizes = np.array([len(a) for a in arrays])
                    start = file.ends.select(at - 1) if at else 0
                    yield common.batch(
                        {
                            "doc_id": some,
                            "start": first + start + np.cumsum(sizes) - sizes,
                            "n_tokens": sizes,
                            "ids_crc32": [zlib.crc32(a.tobytes()) for a in arrays],
                        },
                        ENTRY,
                    )

    return (
        files.select("file", "first")
        .repartition(slices, "file")
        .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, encoded, written and read back."""
    return read_token_files(write_token_files(common.table(spark, sf_dir, "documents")))
