"""Audio manifest to chapter timeline, metadata blocks and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.units import (
    chapter_dir,
    frames_to_ms,
    index_from_name,
    ms_to_frames,
    segment_file,
)
from narrate_spark.operators.ordered import sum_before

CHAPTER_KEY = ["book_id", "chapter_idx"]


def segment_audio(events: DataFrame) -> DataFrame:
    """Frames of each merged segment with its trailing silence.

    ``events`` holds the plan keys, ``seg_pause_ms``, ``rate`` and ``frames``
    per event.  The segment takes the format of its first event.
    """
    key = [*CHAPTER_KEY, "seg_idx"]
    merged = events.groupBy(*key).agg(
        F.sum("frames").alias("_frames"),
        F.min_by("rate", "event_idx").alias("rate"),
        F.max("seg_pause_ms").alias("_pause"),
    )
    silence = F.when(F.col("_pause") > 0, ms_to_frames(F.col("_pause"), F.col("rate")))
    frames = F.col("_frames") + F.coalesce(silence, F.lit(0))
    return merged.select(*key, "rate", frames.alias("frames"))


def chapter_durations(segments: DataFrame) -> DataFrame:
    """Milliseconds per chapter: the sum of whole milliseconds per file."""
    return segments.groupBy(*CHAPTER_KEY).agg(
        F.sum(frames_to_ms(F.col("frames"), F.col("rate"))).alias("duration_ms")
    )


def chapter_markers(durations: DataFrame, titles: DataFrame) -> DataFrame:
    """Start and end of every chapter that has sound.

    Untitled indices get ``Chapter {index + 1}``.  Start times are running sums
    over a whole book, so they come from the ordered scan.
    """
    heard = durations.where(F.col("duration_ms") > 0)
    timed = sum_before(heard, ["book_id"], "chapter_idx", F.col("duration_ms"), "start_ms")
    first_title = titles.groupBy(*CHAPTER_KEY).agg(F.first("title").alias("title"))
    default = F.concat(F.lit("Chapter "), (F.col("chapter_idx") + 1).cast("string"))
    return timed.join(first_title, CHAPTER_KEY, "left").select(
        *CHAPTER_KEY,
        F.coalesce("title", default).alias("title"),
        "start_ms",
        (F.col("start_ms") + F.col("value")).alias("end_ms"),
    )


def _escaped(text: Column, escape: bool) -> Column:
    return F.regexp_replace(text, r"([=;#\\\n])", r"\\$1") if escape else text


def metadata_header(books: DataFrame, escape: bool = False) -> DataFrame:
    """Global tags of each book: book_id, title, author, language, narrator."""

    def tag(name: str, value: str) -> Column:
        return F.concat(F.lit(f"{name}="), _escaped(F.coalesce(F.col(value), F.lit("")), escape))

    language = F.when(F.coalesce("language", F.lit("")) != "", tag("language", "language"))
    text = F.concat_ws(
        "\n",
        F.lit(K.METADATA_HEADER),
        tag("title", "title"),
        tag("artist", "narrator"),
        tag("composer", "author"),
        tag("album_artist", "author"),
        tag("album", "title"),
        F.lit(K.METADATA_GENRE),
        language,
    )
    return books.select("book_id", F.lit(-1).cast("bigint").alias("chapter_idx"), text.alias("block"))


def metadata_blocks(markers: DataFrame, escape: bool = False) -> DataFrame:
    """One metadata block per chapter."""
    text = F.concat_ws(
        "\n",
        F.lit(""),
        F.lit(K.METADATA_CHAPTER),
        F.lit(K.METADATA_TIMEBASE),
        F.concat(F.lit("START="), F.col("start_ms").cast("string")),
        F.concat(F.lit("END="), F.col("end_ms").cast("string")),
        F.concat(F.lit("title="), _escaped(F.col("title"), escape)),
    )
    return markers.select(*CHAPTER_KEY, text.alias("block"))


def ffmetadata(books: DataFrame, markers: DataFrame, escape: bool = False) -> DataFrame:
    """Metadata text in order of (book_id, chapter_idx); the header is at -1.

    Rows stay per chapter instead of one string per book: a book of any length
    is written as a sorted range, never gathered in one cell.
    """
    return metadata_header(books, escape).unionByName(metadata_blocks(markers, escape))


def concat_list(segments: DataFrame, root: str) -> DataFrame:
    """``file '...'`` line per merged segment, ordered by its numbers."""
    path = F.concat_ws(
        "/",
        F.lit(root),
        F.col("book_id"),
        chapter_dir(F.col("chapter_idx")),
        segment_file(F.col("seg_idx")),
    )
    return segments.select(
        *CHAPTER_KEY, "seg_idx", F.concat(F.lit("file '"), path, F.lit("'")).alias("line")
    )


def assembly_manifest(files: DataFrame) -> DataFrame:
    """Segment files of each book in the order they are joined: book_id, path, position.

    ``files``: book_id, path (``.../<chapter>/<segment>.wav``; others are left out).  The
    numbers in both names give the order; a name without one counts as 0, and equal numbers
    go by name.  The same path twice is one file.  Positions come from an ordered scan, so
    a book may have any number of files.
    """
    place = F.split("path", "/")
    stem = F.regexp_extract("path", r"(?s)/(seg_[^/]*)\.wav\z", 1)
    named = files.select("book_id", "path", F.element_at(F.slice(F.concat(F.array(F.lit("")), place), -2, 1), 1).alias("chapter"), stem.alias("stem"))
    named = named.where("stem <> ''").distinct().withColumns(
        {"chapter_no": index_from_name(F.col("chapter")), "segment_no": index_from_name(F.col("stem"))}
    )
    order = ["chapter_no", "chapter", "segment_no", "stem", "path"]
    return sum_before(named, ["book_id"], order, F.lit(1), "position").select("book_id", "path", "position")


def format_mismatches(parts: DataFrame) -> DataFrame:
    """Parts whose PCM format differs from the first part of their chapter."""
    fmt = F.struct("channels", "width", "rate")
    first = parts.groupBy(*CHAPTER_KEY).agg(
        F.min_by(fmt, F.struct("seg_idx", "event_idx")).alias("_first")
    )
    return parts.join(first, CHAPTER_KEY).where(fmt != F.col("_first")).drop("_first")


def merged_frames(parts: DataFrame, silence_between_ms: int = 0) -> DataFrame:
    """Frames per chapter when its parts are joined with silence in between."""
    gap = ms_to_frames(F.lit(silence_between_ms), F.col("rate"))
    merged = parts.groupBy(*CHAPTER_KEY).agg(
        F.sum("frames").alias("frames"),
        F.count(F.lit(1)).alias("parts"),
        F.min_by("rate", F.struct("seg_idx", "event_idx")).alias("rate"),
    )
    return merged.select(
        *CHAPTER_KEY, "parts", "rate", (F.col("frames") + (F.col("parts") - 1) * gap).alias("frames")
    )
