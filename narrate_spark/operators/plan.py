"""The synthesis plan: what to speak, where to pause, what is still missing.

The order rules of the plan (coalesce neighbouring pauses, drop a pause-only
segment that follows another one, give the last segment the chapter pause) only
look inside one chapter.  They are solved inside the chapter row: chunks of a
segment are one string with boundary characters, pauses coalesce by a regular
expression on it, and the segment rules run on one letter per segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.normalize import NORMALIZE_STEPS
from narrate_spark.functions.sentences import HARD, cut_chunks, pack_steps
from narrate_spark.functions.unicode import BLANK, each, fold_case, unify_line_ends, ustrip
from narrate_spark.functions.units import artifact_name
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.ordered import last_before


@dataclass(frozen=True)
class Prosody:
    """Pauses in milliseconds."""

    paragraph_ms: int = K.PARAGRAPH_PAUSE_MS
    chapter_ms: int = K.CHAPTER_PAUSE_MS
    scene_ms: int = K.SCENE_BREAK_PAUSE_MS
    title_ms: int = K.CHAPTER_TITLE_PAUSE_MS


def title_anchor(text: Column, title: Column, is_first: Column) -> Column:
    """Insert a title marker after a first line that repeats the chapter title."""
    lines = unify_line_ends(text)
    first = F.regexp_extract(lines, rf"\A{BLANK}*+([^\n]*)", 1)
    head = F.regexp_extract(lines, rf"\A{BLANK}*+[^\n]*", 0)
    wanted = ustrip(title)
    narrated = is_first & (wanted != "") & (fold_case(ustrip(first)) == fold_case(wanted))
    tail = F.substr(lines, F.length(head) + 1)
    return F.when(
        narrated, F.concat(head, F.lit("\n" + K.CHAPTER_TITLE_MARKER), tail)
    ).otherwise(text)


def _coalesce_pauses(packed: Column, prosody: Prosody) -> Column:
    """Runs of neighbouring markers become the one with the longest pause."""
    long, short = K.SCENE_BREAK_MARKER, K.CHAPTER_TITLE_MARKER
    if prosody.title_ms > prosody.scene_ms:
        long, short = short, long
    edge = rf"(?<={HARD}|\A)"
    end = rf"(?={HARD}|\z)"
    one = F.regexp_replace(
        packed,
        rf"{edge}(?:{short}{HARD})*{long}(?:{HARD}(?:{long}|{short}){end})*+{end}",
        long,
    )
    one = F.regexp_replace(one, rf"{edge}{short}(?:{HARD}{short}{end})++", short)
    return F.when(F.contains(packed, F.lit("\x00")), one).otherwise(packed)


def _letter(packed: Column) -> Column:
    """E: nothing to do, P: one pause and no text, T: some text."""
    marker = rf"\A(?:{K.SCENE_BREAK_MARKER}|{K.CHAPTER_TITLE_MARKER})\z"
    return F.when(packed == "", "E").when(packed.rlike(marker), "P").otherwise("T")


def synthesis_plan(
    chapters: DataFrame,
    prosody: Prosody = Prosody(),
    max_chars: int = K.DEFAULT_MAX_CHARS,
) -> DataFrame:
    """One row per event: a text to speak or a pause to insert.

    ``seg_pause_ms`` is the silence after the segment, repeated on its events.
    The input keeps its chapter columns; ``seg_idx`` and ``artifact`` need the
    ``seg_offset`` column.
    """
    title = F.col("title")
    anchored = F.transform(
        F.col("segs"), lambda s, i: title_anchor(s, title, i == 0)
    )
    staged = chapters.withColumn("_anchored", anchored)
    packs = each(
        F.col("_anchored"),
        *NORMALIZE_STEPS,
        *pack_steps(max_chars),
        lambda p: _coalesce_pauses(p, prosody),
    )
    staged = staged.withColumn("_packs", packs)
    staged = staged.withColumn(
        "_letters", F.array_join(F.transform("_packs", _letter), "")
    )
    # a pause-only segment right after a pause-only segment is dropped
    staged = staged.withColumn(
        "_letters", F.regexp_replace("_letters", "(?<=P)(E*)P", "$1D")
    )
    keep = [c for c in chapters.columns if c not in ("segs", "seg_offset", "text")]
    offset = ["seg_offset"] if "seg_offset" in chapters.columns else []
    staged = staged.withColumn("_n", F.size("segs"))
    segments = explode_rows(
        staged, [*keep, *offset, "_letters", "_n"], "_packs", "seg_pos", "_pack"
    )
    letter = F.substr("_letters", (F.col("seg_pos") + 1).cast("int"), F.lit(1))
    is_last = F.col("seg_pos") == F.col("_n") - 1
    segments = segments.withColumn("_letter", letter)
    segments = segments.where(F.col("_letter").isin("P", "T"))
    seg_pause = (
        F.when(is_last, F.lit(prosody.chapter_ms))
        .when(F.col("_letter") == "P", F.lit(0))
        .otherwise(F.lit(prosody.paragraph_ms))
    )
    segments = segments.withColumn("seg_pause_ms", seg_pause.cast("bigint"))
    events = explode_rows(
        segments,
        [*keep, *offset, "seg_pos", "seg_pause_ms"],
        cut_chunks(F.col("_pack")),
        "event_idx",
        "_event",
    )
    pause = (
        F.when(F.col("_event") == K.SCENE_BREAK_MARKER, prosody.scene_ms)
        .when(F.col("_event") == K.CHAPTER_TITLE_MARKER, prosody.title_ms)
        .otherwise(0)
    )
    is_pause = F.col("_event").isin(K.SCENE_BREAK_MARKER, K.CHAPTER_TITLE_MARKER)
    plan = events.select(
        *keep,
        "seg_pos",
        *([(F.col("seg_offset") + F.col("seg_pos")).alias("seg_idx")] if offset else []),
        "event_idx",
        F.when(is_pause, "pause").otherwise("text").alias("kind"),
        F.when(is_pause, F.lit("")).otherwise(F.col("_event")).alias("text"),
        pause.cast("bigint").alias("pause_ms"),
        "seg_pause_ms",
    )
    if offset:
        plan = plan.withColumn(
            "artifact", artifact_name(F.col("chapter_idx"), F.col("seg_idx"), F.col("event_idx"))
        )
    return plan


def pending_work(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Events whose artifact does not exist yet."""
    return plan.join(done.select("book_id", "artifact"), ["book_id", "artifact"], "left_anti")


def plan_progress(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Text events per book: all, and those already produced."""
    have = done.select("book_id", "artifact").distinct().withColumn("_have", F.lit(1))
    texts = plan.where(F.col("kind") == "text").select("book_id", "artifact")
    return (
        texts.join(have, ["book_id", "artifact"], "left")
        .groupBy("book_id")
        .agg(
            F.count(F.lit(1)).alias("total_segments"),
            F.count("_have").alias("completed_segments"),
        )
    )


def pause_formats(events: DataFrame) -> DataFrame:
    """PCM format of every pause: that of the latest earlier text in the book.

    ``events`` holds book_id, chapter_idx, seg_pos, event_idx and, for texts
    only, rate, channels and width.  The look-back crosses chapters, so it runs
    as an ordered scan and not as one window per book.
    """
    own = F.when(F.col("rate").isNotNull(), F.struct("rate", "channels", "width"))
    order = ["chapter_idx", "seg_pos", "event_idx"]
    seen = last_before(events, ["book_id"], order, own, "_ref")

    def pick(name: str, default: int) -> Column:
        value = F.coalesce(F.col(f"value.{name}"), F.col(f"_ref.{name}"), F.lit(default))
        return value.cast("bigint").alias(name)

    return seen.select(
        "book_id",
        *order,
        F.when(F.col("value").isNull(), "pause").otherwise("text").alias("kind"),
        pick("rate", K.DEFAULT_RATE),
        pick("channels", K.DEFAULT_CHANNELS),
        pick("width", K.DEFAULT_WIDTH),
    )
