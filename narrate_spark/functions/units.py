"""Durations, speeds, chapter specifications and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.unicode import ustrip


def ms_to_timestamp(ms: Column) -> Column:
    """``HH:MM:SS.mmm``; hours keep growing past two digits."""
    ms = ms.cast("bigint")
    hours = F.floor(ms / 3600000).cast("string")
    return F.concat(
        F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
        F.lit(":"),
        F.lpad((F.floor(ms / 60000) % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def speed_error(speed: Column) -> Column:
    """Message for a speed outside the accepted range, else null."""
    bad = speed.isNull() | F.isnan(speed) | (speed < K.MIN_SPEED) | (speed > K.MAX_SPEED)
    return F.when(bad, F.format_string("Speed must be between 0.5 and 2.0, got %s", speed.cast("string")))


def speed_to_duration_delta(speed: Column) -> Column:
    """Relative duration change for a speaking speed, to four places; 0 is none."""
    scaled = (F.lit(1.0) / speed - F.lit(1.0)) * F.lit(10000.0)
    # adding 0.0 turns a negative zero into zero
    rounded = F.rint(scaled) / F.lit(10000.0) + F.lit(0.0)
    return F.when(speed_error(speed).isNull(), rounded)


def ms_to_frames(ms: Column, rate: Column) -> Column:
    """Whole frames in a duration (fractions are cut)."""
    return (rate.cast("double") * (ms.cast("double") / F.lit(1000.0))).cast("bigint")


def frames_to_ms(frames: Column, rate: Column) -> Column:
    """Whole milliseconds of a frame count; 0 for an unusable rate."""
    ok = rate.isNotNull() & (rate > 0) & frames.isNotNull()
    ms = (frames.cast("double") / F.when(rate > 0, rate).cast("double")) * F.lit(1000.0)
    return F.when(ok, ms.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def with_acoustic_tail(frames: Column, rate: Column) -> Column:
    """Frames after the short silent tail that follows non-empty audio."""
    tail = (rate.cast("double") * F.lit(K.ACOUSTIC_TAIL_SECONDS)).cast("bigint")
    return F.when(frames > 0, frames + tail).otherwise(frames)


def chapter_spec_error(spec: Column) -> Column:
    """Message for an unreadable chapter specification, else null."""
    part = r"\s*\+?\d+\s*(?:-\s*[+-]?\d+\s*)?"
    large = F.exists(
        F.regexp_extract_all(spec, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint").isNull()
    )
    return F.when(
        ~spec.rlike(rf"\A{part}(?:,{part})*+\z") | large,
        F.lit("Invalid chapter specification."),
    )


def _range(part: Column) -> Column:
    first = F.regexp_extract(part, r"\A\s*\+?(\d+)", 1).try_cast("bigint")
    last = F.regexp_extract(part, r"-\s*\+?(-?\d+)\s*\z", 1)
    return F.struct(
        first.alias("first"), F.when(last == "", first).otherwise(last.try_cast("bigint")).alias("last")
    )


def chapter_spec_ranges(spec: Column) -> Column:
    """The (first, last) ranges of a specification as they are given; null for an unreadable one."""
    return F.when(chapter_spec_error(spec).isNull(), F.transform(F.split(spec, ",", -1), _range))


def in_chapter_spec(chapter: Column, spec: Column) -> Column:
    """Whether a specification names a chapter; no range is written out, however long it is."""
    return F.exists(chapter_spec_ranges(spec), lambda r: chapter.between(r["first"], r["last"]))


def parse_chapter_spec(spec: Column) -> Column:
    """``'0,2,5'`` or ``'1-3'`` to a sorted array of distinct indices.

    A descending range is empty; an unreadable specification gives null.
    """

    def indices(r: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(r["last"] < r["first"], none).otherwise(
            F.sequence(r["first"], F.greatest(r["first"], r["last"]))
        )

    parts = F.transform(chapter_spec_ranges(spec), indices)
    return F.when(
        chapter_spec_error(spec).isNull(),
        F.array_sort(F.array_distinct(F.flatten(parts))),
    )


def format_range(first: Column, last: Column) -> Column:
    """``min-max`` of the available indices, ``(none)`` when there are none."""
    return F.coalesce(
        F.concat(first.cast("string"), F.lit("-"), last.cast("string")), F.lit("(none)")
    )


def artifact_name(chapter: Column, segment: Column, event: Column) -> Column:
    """File name of one synthesized chunk or pause."""
    return F.format_string(
        K.ARTIFACT_NAME,
        chapter.cast("bigint"),
        segment.cast("bigint"),
        event.cast("bigint"),
    )


def segment_file(segment: Column) -> Column:
    """File name of one merged segment."""
    return F.format_string(K.SEGMENT_NAME, segment.cast("bigint"))


def chapter_dir(chapter: Column) -> Column:
    """Directory name of a chapter."""
    return F.format_string(K.CHAPTER_NAME, chapter.cast("bigint"))


def index_from_name(name: Column) -> Column:
    """Number after the first underscore of a name; 0 when there is none."""
    digits = F.regexp_extract(ustrip(name), r"\A[^_]*_\s*([+-]?\d+(?:_\d+)*)\s*\z", 1)
    return F.coalesce(
        F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def narrator_tag(voice: Column, backend: Column) -> Column:
    """``voice - backend`` when both are known, else the voice."""
    both = (F.coalesce(voice, F.lit("")) != "") & (F.coalesce(backend, F.lit("")) != "")
    return F.when(both, F.concat(voice, F.lit(" - "), backend)).otherwise(
        F.coalesce(voice, F.lit(""))
    )
