"""Packing of documents into token windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of
each is placed, longest first, into the open window with the least room that
still takes it.  A tree over the possible amounts of room finds that window.
Pieces are dealt out evenly and each share is packed on its own, so padding is
lost only once a share; a share is bounded, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from narrate_spark.llm import common, tokens

WINDOW = 4096
END_ID = 2
# Pieces packed together at most; a task packs one such share after another.
SHARE = 200_000

_PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
]
PIECE = pa.schema(_PIECE)
PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class RoomTree:
    """Open windows by the room they have left, 0 to ``most``.

    A complete binary tree counts the windows below each node; the tightest fit
    is the first non-empty leaf at or right of the room needed.
    """

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, room: int, window: int) -> None:
        """Keep a window with so much room."""
        self.open[room].append(window)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest window with that room."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:  # a right child: what is right of it is right of its parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths are at most ``window``."""
    tree = RoomTree(window)
    place, offset = [0] * len(lengths), [0] * len(lengths)
    opened = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = tree.take(need)
        if found is None:
            found = (window, opened)
            opened += 1
        room, place[i] = found
        offset[i] = window - room
        if room > need:
            tree.add(room - need, place[i])
    return place, offset


def cut_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids: full windows, then the rest."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokens.public_path("word_bpe_49k.json")
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in PIECE}
            encoded = tokens.encode_all(file, False, b.column("text").to_pylist())
            for doc, raw in zip(b.column("doc_id").to_pylist(), encoded, strict=True):
                raw += end
                for at in range(0, len(raw), 4 * window):
                    part = raw[at : at + 4 * window]
                    for name, value in zip(
                        out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4), strict=True
                    ):
                        out[name].append(value)
            yield common.batch(out, PIECE)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECE_DDL)


def place_pieces(pieces: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Give each piece its sequence and its offset there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        rows = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending")])
            place, offset = best_fit(t.column("length").to_pylist(), window)
            columns = {f.name: t.column(f.name).to_pylist() for f in PIECE}
            used = max(place) + 1
            return used, common.batch(
                columns | {"sequence_id": first + np.array(place, np.int64), "offset": offset}, PLACED
            )

        for b in batches:
            for at in range(0, b.num_rows, share):
                held.append(b.slice(at, share))
                rows += held[-1].num_rows
                if rows >= share:
                    used, out = packed()
                    yield out
                    first, rows = first + used, 0
                    held.clear()
        if rows:
            yield packed()[1]

    return pieces.repartition("doc_id", "start", "ids_crc32").mapInArrow(
        pack, f"{_PIECE_DDL}, sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all documents; one row a piece.

    A null text is empty and still has its end id, so every row of ``docs``, also
    a repeated one or one without doc_id, has at least one piece.  An empty table
    gives no row.  Other columns are not read.
    """
    return place_pieces(cut_pieces(docs, path, window), window)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
