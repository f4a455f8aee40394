"""Registry of formats: which function turns book files into chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.operators.segments import paragraph_segments, with_segments
from narrate_spark.sources import epub, unpacked
from narrate_spark.sources.files import txt_chapters
from narrate_spark.sources.markup import page_chapters

Parser = Callable[[DataFrame], DataFrame]

_COLUMNS = ["book_id", "chapter_idx", "title", "segs"]


def parse_txt(books: DataFrame) -> DataFrame:
    """Plain text files."""
    return with_segments(txt_chapters(books), paragraph_segments)


def parse_epub(books: DataFrame) -> DataFrame:
    """EPUB archives."""
    return page_chapters(epub.spine_pages(epub.read_archives(books, ("page",))))


def parse_unpacked(books: DataFrame) -> DataFrame:
    """Unpacked single-file books, as ``unpacked.unpacked_books`` gives them."""
    return unpacked.chapters(books)


PARSERS: dict[str, Parser] = {"txt": parse_txt, "epub": parse_epub, "unpacked": parse_unpacked}


def register_parser(form: str, parser: Parser) -> None:
    """Add or replace the parser of a format."""
    PARSERS[form] = parser


def parse_books(books: DataFrame) -> DataFrame:
    """Chapters of all books whose format has a parser."""
    parts = [
        parser(books.where(F.col("format") == form)).select(*_COLUMNS)
        for form, parser in PARSERS.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def parsing_errors(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, path, error) of every book that has no row in ``chapters``.

    Pass the stored result of ``parse_books``, so that no book is parsed twice.
    Only archives without a chapter are opened again, for their reason; no page is
    inflated for it.
    """
    silent = books.join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    broken = epub.read_archives(silent.where(F.col("format") == "epub"), ("book",)).select(
        "book_id", F.col("error").alias("reason")
    )
    known = F.coalesce(F.col("format").isin(*PARSERS), F.lit(False))
    return silent.join(broken, "book_id", "left").select(
        "book_id",
        "path",
        F.when(~known, F.concat(F.lit("No parser for format "), F.coalesce("format", F.lit("?"))))
        .otherwise(F.coalesce("reason", F.lit("No readable chapter")))
        .alias("error"),
    )
