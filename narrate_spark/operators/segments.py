"""Chapter text to ordered segments.

A chapter row carries its segments as one array, so everything up to the
synthesis plan is a projection of that row: no shuffle moves text.  Only the
book-wide segment number needs other rows, and it travels as one narrow
(book, chapter, count) row per chapter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrate_spark.functions.unicode import split_lines, ustrip
from narrate_spark.functions.units import chapter_spec_error, chapter_spec_ranges, format_range
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.ordered import sum_before
from narrate_spark.operators.sizes import small
from narrate_spark.storage import stored

CHAPTER_KEY = ["book_id", "chapter_idx"]


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, ustrip), lambda p: p != "")


def paragraph_segments(text: Column) -> Column:
    """Stripped blocks between empty lines; single newlines stay inside."""
    return _kept(F.split(text, "\n\n", -1))


def line_segments(text: Column) -> Column:
    """One segment per non-blank line, stripped."""
    return _kept(split_lines(text))


def with_segments(
    chapters: DataFrame, split: Callable[[Column], Column], text_col: str = "text"
) -> DataFrame:
    """Replace the chapter text with its ``segs`` array; empty chapters go.

    A generator keeps the array only where it has elements.  A plain filter
    would be pushed below and split every text twice.
    """
    keep = [c for c in chapters.columns if c != text_col]
    held = F.filter(F.array(split(F.col(text_col))), lambda s: F.size(s) > 0)
    return explode_rows(chapters, keep, held, "_pos", "segs").drop("_pos")


def segment_offsets(chapters: DataFrame) -> DataFrame:
    """Narrow rows of chapters: the key, ``seg_offset`` (segments in earlier chapters of the book), ``segments``."""
    counts = chapters.select(*CHAPTER_KEY, F.size("segs").alias("n"))
    offsets = sum_before(counts, ["book_id"], "chapter_idx", F.col("n"), "seg_offset")
    return offsets.select(*CHAPTER_KEY, "seg_offset", F.col("value").alias("segments"))


def with_segment_offset(chapters: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Add ``seg_offset``; ``offsets`` are the chapters' ``segment_offsets`` where they are known already."""
    offsets = segment_offsets(chapters) if offsets is None else offsets
    return chapters.join(offsets.drop("segments"), CHAPTER_KEY)


def explode_segments(chapters: DataFrame) -> DataFrame:
    """One row per segment; ``seg_idx`` is added where the offset is known."""
    keep = [c for c in chapters.columns if c != "segs"]
    rows = explode_rows(chapters, keep, "segs", "seg_pos", "seg_text")
    if "seg_offset" in chapters.columns:
        rows = rows.withColumn("seg_idx", F.col("seg_offset") + F.col("seg_pos"))
        rows = rows.drop("seg_offset")
    return rows


def select_chapters(chapters: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the chapters named by (book_id, chapter_idx) rows."""
    return chapters.join(selection, CHAPTER_KEY, "left_semi")


def missing_chapters(chapters: DataFrame, selection: DataFrame) -> DataFrame:
    """Requested chapters that do not exist, with the range that does."""
    ranges = chapters.groupBy("book_id").agg(
        F.min("chapter_idx").alias("first"), F.max("chapter_idx").alias("last")
    )
    absent = selection.select(*CHAPTER_KEY).distinct()
    absent = absent.join(chapters.select(*CHAPTER_KEY), CHAPTER_KEY, "left_anti")
    return absent.join(small(ranges), "book_id", "left")


def merged_ranges(requests: DataFrame) -> DataFrame:
    """Disjoint ranges of each request's specification: request_id, book_id, first, last.

    ``requests``: request_id (unique), book_id, spec.  Overlapping and touching ranges are
    one; descending ranges and unreadable specifications have none.
    """
    ranges = requests.select(
        "request_id", "book_id", F.explode(F.filter(chapter_spec_ranges(F.col("spec")), lambda r: r["first"] <= r["last"])).alias("r")
    ).select("request_id", "book_id", "r.first", "r.last")
    by = Window.partitionBy("request_id").orderBy("first", "last")
    reached = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("first") - 1 > reached)).cast("int")
    return (
        ranges.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("request_id", "book_id", "island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("island")
    )


def check_selections(chapters: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: request_id, book_id, ranges, named, available, error.

    A specification stays a list of ranges, however many chapters it names: the number of
    a book's chapters before each end of a range comes from one ordered scan over chapters
    and ends together, so neither a chapter number is written out nor a request joined with
    the chapters of its book.  ``named`` counts distinct chapters a request names,
    ``available`` those that exist.  ``error`` is null for a request that can be served; it
    tells an unreadable specification, an empty selection and missing chapters.
    """
    ranges = stored(merged_ranges(requests))
    ends = ranges.select(
        "book_id", "request_id", F.explode(F.array(
            F.struct(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")),
            F.struct(F.col("last").alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("sign")),
        )).alias("e"),
    ).select("book_id", "e.at", "e.kind", "request_id", "e.sign", F.lit(0).alias("one"))
    own = chapters.select("book_id", F.col("chapter_idx").cast("bigint").alias("at")).distinct()
    none = ranges.schema["request_id"].dataType
    own = own.select("book_id", "at", F.lit(1).alias("kind"), F.lit(None).cast(none).alias("request_id"), F.lit(0).alias("sign"), F.lit(1).alias("one"))
    order = ["at", "kind", "request_id", "sign"]
    counted = sum_before(own.unionByName(ends), ["book_id"], order, F.col("one"), "before")
    available = counted.where("kind <> 1").groupBy("request_id").agg(F.sum(F.col("before") * F.col("sign")).alias("available"))
    wide = "decimal(20,0)"
    asked = ranges.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"),
        F.sum(F.col("last").cast(wide) - F.col("first").cast(wide) + 1).alias("named"),
    )
    shown = F.transform("r", lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(format_range(r["first"], r["last"])))
    books = chapters.groupBy("book_id").agg(F.min("chapter_idx").alias("low"), F.max("chapter_idx").alias("high"))
    joined = requests.select("request_id", "book_id", "spec").join(asked, "request_id", "left").join(available, "request_id", "left")
    joined = joined.join(small(books), "book_id", "left").withColumns(
        {"named": F.coalesce("named", F.lit(0).cast("decimal(38,0)")), "available": F.coalesce("available", F.lit(0).cast("bigint"))}
    )
    range_text = F.concat(F.lit(" Available indices: "), format_range(F.col("low"), F.col("high")))
    error = (
        F.when(F.col("spec").isNull() | chapter_spec_error(F.col("spec")).isNotNull(), F.lit("Invalid chapter specification."))
        .when(F.col("named") == 0, F.concat(F.lit("Chapter selection is empty."), range_text))
        .when(
            F.col("available") < F.col("named"),
            F.concat(F.lit("Chapter indices out of range: "), (F.col("named") - F.col("available")).cast("string"), F.lit("."), range_text),
        )
    )
    return joined.select("request_id", "book_id", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("ranges"), "named", "available", error.alias("error"))
