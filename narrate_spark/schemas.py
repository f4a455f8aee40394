"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

JOB = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("book_title", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("voice", T.StringType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("paragraph_pause_ms", T.IntegerType()),
        T.StructField("chapter_pause_ms", T.IntegerType()),
        T.StructField("scene_break_pause_ms", T.IntegerType()),
        T.StructField("chapter_title_pause_ms", T.IntegerType()),
        T.StructField("max_chars", T.IntegerType()),
        T.StructField("keep_intermediates", T.BooleanType()),
        T.StructField("work_dir", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("total_segments", T.IntegerType()),
        T.StructField("completed_segments", T.IntegerType()),
        T.StructField("chapter_indices", T.ArrayType(T.IntegerType())),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
