"""Unpacked single-file books: one directory with a page, a package and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.markup import html_title
from narrate_spark.functions.unicode import chain, ustrip
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.sources.covers import image_suffix
from narrate_spark.sources.files import base_name, decode_markup, suffix_of
from narrate_spark.sources.markup import html_chapters
from narrate_spark.sources.package_xml import ncx_entries, opf_package

PACKAGE, CONTENTS = "content.opf", "toc.ncx"


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def unpacked_books(files: DataFrame) -> DataFrame:
    """Files (path, content) to one row per directory that holds a page.

    Returns book_id and path (the directory), stem, format, content (bytes of the
    page, the first by name), opf, ncx and names (of all files there).  Files are
    spread by directory; of images and others only the names travel.
    """
    name = base_name(F.col("path"))
    role = (
        F.when(name == PACKAGE, "opf").when(name == CONTENTS, "ncx").when(suffix_of(name).isin(*K.HTML_SUFFIXES), "page")
    )
    rows = files.select(_directory(F.col("path")).alias("path"), name.alias("name"), role.alias("role"), "content")
    # a content that no role needs is dropped before rows are exchanged
    rows = rows.withColumn("content", F.when(F.col("role").isNotNull(), F.col("content")))

    def of(which: str) -> Column:
        return F.min_by(F.col("content"), F.when(F.col("role") == which, F.col("name")))

    books = rows.groupBy("path").agg(
        of("page").alias("content"),
        of("opf").alias("_opf"),
        of("ncx").alias("_ncx"),
        F.collect_set("name").alias("names"),
        F.count(F.when(F.col("role") == "page", 1)).alias("_pages"),
    )
    return books.where("_pages > 0").select(
        F.col("path").alias("book_id"),
        "path",
        base_name(F.col("path")).alias("stem"),
        F.lit("unpacked").alias("format"),
        "content",
        decode_markup(F.col("_opf")).alias("opf"),
        decode_markup(F.col("_ncx")).alias("ncx"),
        F.sort_array("names").alias("names"),
    )


def chapters(books: DataFrame) -> DataFrame:
    """Chapters of unpacked books (book_id, content and ncx: xml or null)."""
    ncx = F.col("ncx") if "ncx" in books.columns else F.lit(None).cast("string")
    pages = books.select("book_id", decode_markup(F.col("content")).alias("markup"), ncx_entries(ncx).alias("toc"))
    return html_chapters(pages)


def metadata(books: DataFrame) -> DataFrame:
    """Title, author and language of unpacked books (book_id, stem, content, opf).

    The title is that of the package, else of the page, else the stem.
    """
    read = books.select(
        "book_id", "stem", opf_package(F.col("opf")).alias("pkg"), html_title(decode_markup(F.col("content"))).alias("html_title")
    )
    page_title = F.nullif(ustrip(F.col("html_title")), F.lit(""))
    return read.select(
        "book_id",
        F.coalesce("pkg.title", page_title, F.col("stem")).alias("title"),
        F.coalesce("pkg.author", F.lit("")).alias("author"),
        F.coalesce("pkg.language", F.lit("en")).alias("language"),
    )


def opf_cover(books: DataFrame) -> DataFrame:
    """Cover of unpacked books (book_id, opf, names): the file of the first cover id, if it is there.

    Returns book_id, name (as the package gives it) and suffix, one row for each book
    that has such a cover.
    """

    def href(pkg: Column) -> Column:
        return F.get(F.filter(pkg["items"], lambda i: i["id"] == pkg["cover_id"]), F.lit(0))["href"]

    def there(name: Column) -> Column:
        return F.filter(F.array(name), lambda n: (n != "") & F.array_contains("names", n))

    found = F.transform(chain(F.col("opf"), opf_package, href, there), lambda n: F.struct(n.alias("name"), image_suffix(n).alias("suffix")))
    return explode_rows(books, ["book_id"], found, "_pos", "_cover").select("book_id", "_cover.name", "_cover.suffix")
