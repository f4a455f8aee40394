"""Markup pages to chapters: spine items, headings, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.functions.markup import (
    SPLIT,
    block_text,
    heading,
    heading_sections,
    strip_tags,
    unescape,
)
from narrate_spark.functions.unicode import unescape_marks, ustrip
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.segments import line_segments, with_segments


def section_title(title: Column, index: Column) -> Column:
    """The title, or ``Section {index + 1}`` where it is empty."""
    auto = F.concat(F.lit("Section "), (index + 1).cast("string"))
    return F.when(F.coalesce(title, F.lit("")) == "", auto).otherwise(title)


def with_page_text(pages: DataFrame) -> DataFrame:
    """Replace ``markup`` with its readable ``text``."""
    blocks = pages.withColumn("_block", block_text(F.col("markup"))).drop("markup")
    return blocks.withColumn("text", ustrip(unescape(F.col("_block")))).drop("_block")


def page_chapters(pages: DataFrame) -> DataFrame:
    """Spine pages (book_id, chapter_idx, markup) as chapters with segments.

    The index is the spine position, so dropping pages without text leaves gaps.
    """
    titled = pages.withColumn(
        "title", section_title(heading(F.col("markup")), F.col("chapter_idx"))
    )
    return with_segments(with_page_text(titled), line_segments)


def _find(text: Column, needle: Column, start: Column | None = None) -> Column:
    """Zero-based position of a needle, -1 when it is absent."""
    at = F.lit(1) if start is None else start + 1
    return F.position(needle, text, at) - 1


def _tag_before(text: Column, pos: Column) -> Column:
    """Zero-based position of the last ``<`` before a position, else -1."""
    prefix = F.substr(text, F.lit(1), pos)
    return pos - F.length(F.substring_index(prefix, "<", -1)) - 1


def _anchor_name(filepos: Column) -> Column:
    return F.concat(F.lit("filepos"), filepos.cast("string"))


def _anchor_at(text: Column, filepos: Column) -> Column:
    name = _anchor_name(filepos)
    double = _find(text, F.concat(F.lit('id="'), name, F.lit('"')))
    single = _find(text, F.concat(F.lit("id='"), name, F.lit("'")))
    return F.when(double >= 0, double).otherwise(single)


def _section(title: Column, markup: Column) -> Column:
    return F.struct(title.alias("title"), markup.alias("markup"))


def with_toc_cut(pages: DataFrame) -> DataFrame:
    """Add ``_cut``: each page cut at the anchors of its ``toc`` (array of title, filepos).

    A section starts at the tag that holds its anchor and ends at the tag of the
    next entry's anchor; without one, at the next mention of that anchor, else
    at the end.  Entries without an anchor have no markup.  Positions are found
    once per entry and then shared through an array.
    """
    markup, toc = F.col("markup"), F.col("toc")
    found = pages.withColumn(
        "_at", F.transform(toc, lambda e: _anchor_at(markup, e["filepos"]))
    )
    tags = found.withColumn(
        "_tag", F.transform("_at", lambda at: F.when(at >= 0, _tag_before(markup, at)))
    )

    def section(entry: Column, i: Column) -> Column:
        at, tag = F.get("_at", i), F.get("_tag", i)
        start = F.when(tag >= 0, tag).otherwise(at)
        next_at, next_tag = F.get("_at", i + 1), F.get("_tag", i + 1)
        mention = _find(markup, _anchor_name(F.get(toc, i + 1)["filepos"]), start + 1)
        end = (
            F.when(i + 1 >= F.size(toc), F.length(markup))
            .when((next_at >= 0) & (next_tag < 0), F.length(markup) - 1)
            .when(next_at >= 0, next_tag)
            .when(mention >= 0, mention)
            .otherwise(F.length(markup))
        )
        body = F.when(at >= 0, F.substr(markup, start + 1, F.greatest(end - start, F.lit(0))))
        return _section(section_title(entry["title"], i), body)

    return tags.withColumn("_cut", F.transform(toc, section)).drop("_at", "_tag")


def _headed(section: Column, index: Column) -> Column:
    head = ustrip(strip_tags(unescape_marks(F.substring_index(section, SPLIT, 1))))
    body = unescape_marks(F.substr(section, F.position(F.lit(SPLIT), section) + 1))
    return _section(section_title(head, index), body)


def heading_rows(pages: DataFrame) -> DataFrame:
    """Sections of pages (``markup``) by their headings: chapter_idx, title, markup; pages without headings have none."""
    keep = [c for c in pages.columns if c not in ("markup", "toc")]
    cut = F.transform(heading_sections(F.col("markup")), _headed)
    rows = explode_rows(pages, keep, cut, "chapter_idx", "_s")
    return rows.select(*keep, "chapter_idx", F.col("_s.title").alias("title"), F.col("_s.markup").alias("markup"))


def html_chapters(pages: DataFrame) -> DataFrame:
    """Chapters of single-file books: by contents, else by headings, else one.

    ``pages`` holds book_id, markup and toc.  A book with contents never falls
    back, even when none of its anchors is found.  Titles from headings keep their
    entities.  Pages are read once: a page is cut in its row, and the array that
    results says which way it went.
    """
    keep = [c for c in pages.columns if c not in ("markup", "toc")]
    no_toc = F.array().cast("array<struct<title:string,filepos:bigint>>")
    cut = with_toc_cut(pages.withColumn("toc", F.coalesce("toc", no_toc)))
    with_toc = F.size("toc") > 0
    cut = cut.withColumn("_heads", F.when(~with_toc, heading_sections(F.col("markup"))))
    sections = (
        F.when(with_toc, F.col("_cut"))
        .when(F.size("_heads") > 0, F.transform("_heads", _headed))
        .otherwise(F.array(_section(F.lit("Chapter 1"), F.col("markup"))))
    )
    rows = explode_rows(cut, keep, sections, "chapter_idx", "_s")
    rows = rows.where(F.col("_s.markup").isNotNull())
    parts = rows.select(*keep, "chapter_idx", F.col("_s.title").alias("title"), F.col("_s.markup").alias("markup"))
    return with_segments(with_page_text(parts), line_segments)
