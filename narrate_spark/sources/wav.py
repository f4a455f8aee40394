"""WAV bytes as columns: header decoding, silence, merging, writing."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrate_spark.functions.units import ms_to_frames

CHAPTER_KEY = ["book_id", "chapter_idx"]


def _little_endian(content: Column, start: int, size: int) -> Column:
    """Unsigned little-endian integer at a one-based byte position."""
    digits = F.hex(F.substring(content, start, size))
    pairs = "".join(["(..)"] * size)
    swapped = F.regexp_replace(digits, pairs, "".join(f"${i}" for i in range(size, 0, -1)))
    return F.conv(swapped, 16, 10).cast("bigint")


def _bytes(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), size * 2, "0")
    pairs = "".join(["(..)"] * size)
    return F.unhex(
        F.regexp_replace(digits, pairs, "".join(f"${i}" for i in range(size, 0, -1)))
    )


def _ascii(text: str) -> Column:
    return F.lit(text).cast("binary")


def wav_bytes(pcm: Column, rate: Column, channels: Column, width: Column) -> Column:
    """A complete file: the canonical 44-byte header and the samples."""
    size = F.octet_length(pcm)
    return F.concat(
        _ascii("RIFF"),
        _bytes(size + 36, 4),
        _ascii("WAVEfmt "),
        _bytes(F.lit(16), 4),
        _bytes(F.lit(1), 2),
        _bytes(channels, 2),
        _bytes(rate, 4),
        _bytes(rate * channels * width, 4),
        _bytes(channels * width, 2),
        _bytes(width * 8, 2),
        _ascii("data"),
        _bytes(size, 4),
        pcm,
    )


_PARAMS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("rate", "channels", "width", "frames")]
)


@F.pandas_udf(_PARAMS)
def _walk_header(content: pd.Series) -> pd.DataFrame:
    """Files with further header blocks; unreadable files give nulls."""

    def read(data: bytes | None) -> tuple:
        try:
            with wave.open(io.BytesIO(data), "rb") as f:
                return f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
        except Exception:  # noqa: BLE001
            return None, None, None, None

    rows = [read(data) if data is not None else (None,) * 4 for data in content]
    return pd.DataFrame(rows, columns=["rate", "channels", "width", "frames"], dtype="Int64")


def scan_wav(files: DataFrame) -> DataFrame:
    """Add rate, channels, width and frames of each file's ``content``.

    The canonical header is decoded in the JVM; only files with another header
    go through Python.  Unreadable files have nulls and count as silent.
    """
    content = F.col("content")
    canonical = (
        (F.octet_length(content) >= 44)
        & (F.substring(content, 1, 4) == _ascii("RIFF"))
        & (F.substring(content, 9, 8) == _ascii("WAVEfmt "))
        & (_little_endian(content, 17, 4) == 16)
        & (F.substring(content, 37, 4) == _ascii("data"))
    )
    flagged = files.withColumn("_plain", F.coalesce(canonical, F.lit(False)))
    walked = flagged.withColumn("_other", _walk_header(F.when(~F.col("_plain"), content)))
    rate, channels = _little_endian(content, 25, 4), _little_endian(content, 23, 2)
    width = F.floor(_little_endian(content, 35, 2) / 8)
    # a streamed file may state more bytes than it holds
    size = F.least(_little_endian(content, 41, 4), (F.octet_length(content) - 44).cast("bigint"))
    frames = F.floor(size / F.nullif(channels * width, F.lit(0)))

    def pick(plain: Column, name: str) -> Column:
        return F.when(F.col("_plain"), plain).otherwise(F.col(f"_other.{name}")).cast("bigint")

    return walked.select(
        *files.columns,
        pick(rate, "rate").alias("rate"),
        pick(channels, "channels").alias("channels"),
        pick(width, "width").alias("width"),
        pick(frames, "frames").alias("frames"),
    )


def silence_bytes(ms: Column, rate: Column, channels: Column, width: Column) -> Column:
    """Zero samples of a duration; a negative duration is an error."""
    size = (ms_to_frames(ms, rate) * channels * width).cast("int")
    bad = F.raise_error(F.concat(F.lit("Silence duration cannot be negative: "), ms.cast("string")))
    zero = F.unhex(F.lit("00"))
    empty = F.unhex(F.lit(""))
    return F.when(ms < 0, bad.cast("binary")).when(size == 0, empty).otherwise(
        F.repeat(zero.cast("string"), size).cast("binary")
    )


def append_silence(pcm: Column, ms: Column, rate: Column, channels: Column, width: Column) -> Column:
    """Samples followed by silence; nothing is added for 0 ms or less."""
    tail = silence_bytes(F.greatest(ms, F.lit(0)), rate, channels, width)
    return F.when(ms > 0, F.concat(pcm, tail)).otherwise(pcm)


def merge_pcm(parts: DataFrame, silence_between_ms: int = 0) -> DataFrame:
    """One WAV per chapter from its ordered parts.

    ``parts`` holds the chapter key, ``part_idx``, pcm, rate, channels and
    width.  A part whose format differs from the first one turns the chapter
    into an error row.  The result of a group is one output file, so a group is
    as large as that file.
    """
    ordered = parts.groupBy(*CHAPTER_KEY).agg(
        F.array_sort(
            F.collect_list(F.struct("part_idx", "rate", "channels", "width", "pcm"))
        ).alias("ps")
    )
    first = F.get("ps", F.lit(0))
    head = ordered.select(
        *CHAPTER_KEY,
        "ps",
        first["rate"].alias("rate"),
        first["channels"].alias("channels"),
        first["width"].alias("width"),
    )
    rate, channels, width = F.col("rate"), F.col("channels"), F.col("width")
    gap = silence_bytes(F.lit(silence_between_ms), rate, channels, width)
    mixed = F.exists(
        "ps",
        lambda p: (p["rate"] != rate) | (p["channels"] != channels) | (p["width"] != width),
    )
    # one linear join of the parts' bytes, the gap between them; a fold would copy them again for each part
    joined = F.call_function(
        "array_join",
        F.transform("ps", lambda p: p["pcm"].cast("string")),
        F.col("_gap").cast("string"),
    ).cast("binary")
    merged = head.withColumn("_gap", gap).withColumn("_mixed", mixed).withColumn("_pcm", joined)
    return merged.select(
        *CHAPTER_KEY,
        F.when(~F.col("_mixed"), wav_bytes(F.col("_pcm"), rate, channels, width)).alias("wav"),
        F.when(F.col("_mixed"), F.lit("WAV format mismatch")).alias("error"),
    )
