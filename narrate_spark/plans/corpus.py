"""How the given tables are read as books, chapters, voices, jobs and audio.

``documents`` holds running prose without chapter lines, scene breaks or page
numbers.  ``narration_chapters`` therefore writes such lines into the text by a
fixed rule on (document, line), so that every operator has work to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark.functions.unicode import ustrip
from narrate_spark.operators.sizes import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _written_line(line: Column, doc: Column, i: Column) -> Column:
    rule = (doc * 31 + i * 7) % 23
    number = (i % 40).cast("string")
    return (
        F.when(rule == 0, F.lit("***"))
        .when(rule == 1, F.concat(F.lit("Page "), number))
        .when(rule == 2, F.concat(F.lit("Chapter "), number))
        .when(rule == 3, F.concat(F.lit("- "), line))
        .when(rule == 4, F.concat(F.lit("«"), line, F.lit("»")))
        .when(rule == 5, F.lit("xvii"))
        .when(rule == 6, F.lit("  ---  "))
        .when(rule == 7, F.concat(F.lit("¿ "), line, F.lit(" ?  . . . y – bien")))
        .when(rule == 8, F.lit("Copyright © 2020"))
        .when(rule == 9, F.concat(F.lit("\t“"), F.replace(line, F.lit(" "), F.lit("  ")), F.lit("” ....")))
        .otherwise(line)
    )


def _gap(doc: Column, i: Column) -> Column:
    return F.when((doc + i) % 3 == 0, F.lit("\n\n")).otherwise(F.lit("\n"))


def narration_text(doc: Column, text: Column) -> Column:
    """Text of a document with narration lines written into it."""
    return F.array_join(
        F.transform(
            F.split(text, "\n", -1),
            lambda line, i: F.concat(_written_line(line, doc, i), _gap(doc, i)),
        ),
        "",
    )


def chapter_title(doc: Column, text: Column) -> Column:
    """Title of a document: automatic, narrated as its first line, or plain."""
    first = ustrip(F.substring_index(text, "\n", 1))
    return (
        F.when(doc % 7 == 0, F.concat(F.lit("Section "), (doc + 1).cast("string")))
        .when(doc % 3 == 0, F.lower(first))
        .otherwise(F.concat(F.lit("Text "), doc.cast("string")))
    )


def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a book, each document a chapter (indices have gaps)."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_idx"),
        chapter_title(F.col("doc_id"), F.col("text")).alias("title"),
        "text",
    )
    return spread(docs, "book_id", "chapter_idx")


def narration_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document chapters with narration lines written into the text."""
    docs = spread(table(spark, sf_dir, "documents"), "source", "doc_id")
    return docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_idx"),
        chapter_title(F.col("doc_id"), F.col("text")).alias("title"),
        narration_text(F.col("doc_id"), F.col("text")).alias("text"),
    )
