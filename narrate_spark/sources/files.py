"""Book files: format by suffix, validation, text decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.languages import _lookup

FILE_COLUMNS = ["path", "modificationTime", "length", "content"]


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below a directory; the content is only read where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root)


def suffix_of(path: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)\z", 1))


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    """File name without its suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def scan_books(files: DataFrame) -> DataFrame:
    """Add format, stem and error; an unknown suffix is an error row."""
    suffix = suffix_of(F.col("path"))
    form = _lookup(K.FORMATS, suffix)
    problem = F.when(
        form.isNull(),
        F.concat(
            F.lit("Unsupported format: "),
            suffix,
            F.lit(". Supported: .epub, .txt, .mobi, .azw, .azw3"),
        ),
    )
    return files.select(
        F.col("path").alias("book_id"),
        "path",
        form.alias("format"),
        stem_of(F.col("path")).alias("stem"),
        "content",
        problem.alias("error"),
    )


def validate_books(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into readable books and error rows (book_id, path, error)."""
    zip_magic = F.substring("content", 1, 4) == F.unhex(F.lit("504B0304"))
    empty_zip = F.substring("content", 1, 4) == F.unhex(F.lit("504B0506"))
    bad_zip = (F.col("format") == "epub") & ~(zip_magic | empty_zip)
    checked = books.withColumn(
        "error", F.coalesce("error", F.when(bad_zip, F.lit("Corrupt or invalid ZIP")))
    )
    good = checked.where(F.col("error").isNull()).drop("error")
    bad = checked.where(F.col("error").isNotNull()).select("book_id", "path", "error")
    return good, bad


def decode_text(content: Column) -> Column:
    """Strict UTF-8, Latin-1 where that fails; a byte order mark stays."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def decode_markup(content: Column) -> Column:
    """UTF-8 with replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def txt_chapters(books: DataFrame) -> DataFrame:
    """Plain text books: one chapter each, text still to be cut to segments."""
    return books.select(
        "book_id",
        F.lit(0).cast("bigint").alias("chapter_idx"),
        F.lit("Chapter 1").alias("title"),
        decode_text(F.col("content")).alias("text"),
    )


def txt_metadata(books: DataFrame) -> DataFrame:
    """Title is the file stem; no author; English."""
    return books.select(
        "book_id",
        F.col("stem").alias("title"),
        F.lit("").alias("author"),
        F.lit("en").alias("language"),
    )
