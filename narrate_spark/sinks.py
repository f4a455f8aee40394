"""Sinks: tables, side files, audio and cover files.

File sinks write from the tasks into a folder that all executors can reach.
Every file is written under a temporary name and then renamed, so a task that
runs twice leaves the same files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write chunks, plans or manifests as parquet.

    Rows are placed by chapter, not by book: a book may be most of the table.
    With ``partition_by`` only the partitions present in ``rows`` are replaced.
    """
    placed = rows.repartition("book_id", "chapter_idx")
    writer = placed.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_side_files(rows: DataFrame, path: str, text_col: str, order: list[str]) -> None:
    """Write ordered text per book.

    The rows are ranged over (book, order), so a long book becomes several
    files whose names keep the order.
    """
    ranged = rows.repartitionByRange("book_id", *order).sortWithinPartitions("book_id", *order)
    text = ranged.select("book_id", F.col(text_col).alias("value"))
    text.write.mode("overwrite").partitionBy("book_id").text(path)


def _write_rows(rows: Iterable[Row], root: str) -> None:
    for row in rows:
        target = os.path.join(root, row["file"])
        os.makedirs(os.path.dirname(target), exist_ok=True)
        partial = f"{target}.{uuid.uuid4().hex}.tmp"
        with open(partial, "wb") as f:
            f.write(row["content"])
        os.replace(partial, target)


def write_files(files: DataFrame, root: str) -> None:
    """Write (file, content) rows below a shared folder."""
    files.select("file", "content").foreachPartition(lambda rows: _write_rows(rows, root))


def write_wavs(merged: DataFrame, root: str) -> None:
    """Write merged chapters as ``<book>/ch_0000.wav``."""
    name = F.format_string("%s/ch_%04d.wav", F.col("book_id"), F.col("chapter_idx").cast("bigint"))
    good = merged.where(F.col("wav").isNotNull())
    write_files(good.select(name.alias("file"), F.col("wav").alias("content")), root)


def write_covers(covers: DataFrame, root: str) -> None:
    """Write covers as ``<stem>_cover<suffix>``; rows hold stem, suffix, content."""
    name = F.concat("stem", F.lit("_cover"), "suffix")
    write_files(covers.select(name.alias("file"), "content"), root)
