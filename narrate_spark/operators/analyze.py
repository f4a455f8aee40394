"""Read-only analysis of chapters: statistics, warnings, previews, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.normalize import (
    NORMALIZE_STEPS,
    chunk_kind,
    drop_markers,
    is_marker,
)
from narrate_spark.functions.sentences import (
    SENTENCE_STEPS,
    cut_chunks,
    pack_steps,
    split_sentences,
)
from narrate_spark.functions.unicode import BLANK, COUNT_STEPS, each, ustrip
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.segments import CHAPTER_KEY


def with_normalized(chapters: DataFrame) -> DataFrame:
    """Add ``norms``, the normalized text of every segment."""
    return chapters.withColumn("norms", each(F.col("segs"), *NORMALIZE_STEPS))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def _chunks(norms: Column, max_chars: int) -> Column:
    """Chunks of every text of an array, as an array of arrays."""
    return each(norms, *pack_steps(max_chars), cut_chunks)


def _text_chunks(norms: Column, max_chars: int) -> Column:
    only_text = lambda chunks: F.filter(chunks, lambda c: ~is_marker(c))
    return F.transform(_chunks(norms, max_chars), only_text)


def analyze_chapters(
    chapters: DataFrame, max_chars: int = K.DEFAULT_MAX_CHARS
) -> DataFrame:
    """Segments, characters, words and text chunks per chapter.

    Markers are not counted.  Every figure is computed inside the chapter row,
    so the plan has no exchange.
    """
    plains = with_normalized(chapters).withColumn(
        "plains", F.transform("norms", drop_markers)
    )
    keep = [c for c in chapters.columns if c != "segs"]
    return plains.select(
        *keep,
        F.size("segs").cast("bigint").alias("segments"),
        _sum(F.transform("plains", lambda p: F.length(p).cast("bigint"))).alias("chars"),
        _sum(each(F.col("plains"), *COUNT_STEPS, lambda n: n.cast("bigint"))).alias("words"),
        _sum(
            F.transform(
                _text_chunks(F.col("norms"), max_chars), lambda c: F.size(c).cast("bigint")
            )
        ).alias("chunks"),
    )


def book_totals(analysis: DataFrame) -> DataFrame:
    """Sums over the chapters of each book (partial aggregation first)."""
    return analysis.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("segments").alias("segments"),
        F.sum("chars").alias("chars"),
        F.sum("words").alias("words"),
        F.sum("chunks").alias("chunks"),
    )


def chapter_warnings(analysis: DataFrame) -> DataFrame:
    """The three detection warnings, in rule order per chapter."""
    index = F.col("chapter_idx").cast("string")
    untitled = (F.col("title") == "") | F.startswith("title", F.lit("Section "))
    rules = F.array(
        F.when(
            untitled,
            F.concat(
                F.lit("Chapter "),
                index,
                F.lit(": no heading detected (auto-titled '"),
                F.col("title"),
                F.lit("')"),
            ),
        ),
        F.when(
            F.col("segments") <= 1,
            F.concat(
                F.lit("Chapter "),
                index,
                F.lit(": only "),
                F.col("segments").cast("string"),
                F.lit(" segment(s) — may be a parsing artifact"),
            ),
        ),
        F.when(
            F.col("chars") == 0,
            F.concat(
                F.lit("Chapter "),
                index,
                F.lit(": 0 characters after normalization (noise-only content)"),
            ),
        ),
    )
    rows = explode_rows(analysis, CHAPTER_KEY, rules, "pos", "warning")
    return rows.where(F.col("warning").isNotNull()).select(
        *CHAPTER_KEY, (F.col("pos") + 1).alias("rule_no"), "warning"
    )


def _numbered(chapters: DataFrame, nested: Column) -> DataFrame:
    """Flatten per-segment arrays; keeps the position in segment and chapter."""
    keep = [c for c in chapters.columns if c not in ("segs", "norms")]
    tagged = F.transform(
        nested,
        lambda items, pos: F.transform(
            items,
            lambda item, i: F.struct(
                pos.cast("bigint").alias("seg_pos"),
                i.cast("bigint").alias("item_idx"),
                item.alias("text"),
            ),
        ),
    )
    flat = chapters.select(*keep, F.flatten(tagged).alias("items"))
    flat = flat.withColumn("n_items", F.size("items").cast("bigint"))
    rows = explode_rows(flat, [*keep, "n_items"], "items", "item_no", "item")
    return rows.select(*keep, "n_items", "item_no", "item.*")


def sentences(chapters: DataFrame) -> DataFrame:
    """One row per sentence of the normalized text, markers removed."""
    with_norms = with_normalized(chapters)
    plains = F.transform("norms", drop_markers)
    nested = each(plains, *SENTENCE_STEPS)
    return _numbered(with_norms, nested).withColumnRenamed("item_idx", "sentence_idx")


def chunks(chapters: DataFrame, max_chars: int = K.DEFAULT_MAX_CHARS) -> DataFrame:
    """One row per chunk, marker chunks included, with its kind."""
    with_norms = with_normalized(chapters)
    nested = _chunks(F.col("norms"), max_chars)
    rows = _numbered(with_norms, nested).withColumnRenamed("item_idx", "chunk_idx")
    kind = chunk_kind(F.col("text"))
    text = F.when(kind == K.KIND_TEXT, F.col("text")).otherwise("")
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "n_items", "item_no")],
        kind.alias("kind"),
        text.alias("text"),
        F.length(text).cast("bigint").alias("n_chars"),
    )


def preview(chapters: DataFrame, max_chars: int = K.DEFAULT_MAX_CHARS) -> DataFrame:
    """Text chunks of each chapter in reading order, labelled ``i/n``."""
    with_norms = with_normalized(chapters)
    nested = _text_chunks(F.col("norms"), max_chars)
    rows = _numbered(with_norms, nested)
    label = F.concat_ws(
        "/", (F.col("item_no") + 1).cast("string"), F.col("n_items").cast("string")
    )
    return rows.select(
        *CHAPTER_KEY, (F.col("item_no") + 1).alias("chunk_no"), label.alias("label"), "text"
    )


def plan_size(analysis: DataFrame) -> DataFrame:
    """Text chunks that a conversion of each book has to synthesize."""
    return analysis.groupBy("book_id").agg(F.sum("chunks").alias("total_segments"))


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def fingerprints(chunk_rows: DataFrame) -> DataFrame:
    """Order-sensitive fingerprint of each book's chunks.

    The position is part of what is hashed and the hashes are added up, so
    partial sums combine in any order and a large book needs no single task.
    """
    keyed = F.concat_ws(
        "|",
        F.col("chapter_idx").cast("string"),
        F.col("seg_pos").cast("string"),
        F.col("chunk_idx").cast("string"),
        F.col("kind"),
        F.col("text"),
    )
    return chunk_rows.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(_hash60(keyed).cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )


def word_check(chapters: DataFrame, max_chars: int = K.DEFAULT_MAX_CHARS) -> DataFrame:
    """Words before and after chunking, and whether they are the same words.

    The comparison stays inside each chapter row: the sorted word list of the
    normalized text against that of the chunks.
    """

    def words(texts: Column) -> Column:
        parts = F.transform(texts, lambda t: F.split(ustrip(t), f"{BLANK}+", -1))
        return F.array_sort(F.filter(F.flatten(parts), lambda w: w != ""))

    packed = F.flatten(_text_chunks(F.col("norms"), max_chars))
    lists = with_normalized(chapters).select(
        *CHAPTER_KEY,
        words(F.transform("norms", drop_markers)).alias("before"),
        words(packed).alias("after"),
    )
    return lists.select(
        *CHAPTER_KEY,
        F.size("before").cast("bigint").alias("words_before"),
        F.size("after").cast("bigint").alias("words_after"),
        (F.col("before") == F.col("after")).alias("same"),
    )


def word_differences(chapters: DataFrame, max_chars: int = K.DEFAULT_MAX_CHARS) -> DataFrame:
    """Chapters in which chunking lost or invented words; empty when it is sound."""
    return word_check(chapters, max_chars).where(~F.col("same")).drop("same")


def chunk_lengths_ok(chunk_rows: DataFrame, max_chars: int) -> DataFrame:
    """Chunks over the limit that hold more than one sentence (must be none)."""
    return chunk_rows.where(
        (F.col("n_chars") > max_chars) & (F.size(split_sentences(F.col("text"))) > 1)
    )


__all__ = [
    "analyze_chapters",
    "book_totals",
    "chapter_warnings",
    "chunk_lengths_ok",
    "chunks",
    "fingerprints",
    "plan_size",
    "preview",
    "sentences",
    "with_normalized",
    "word_check",
    "word_differences",
]
