"""Live views: intake of texts, job status, throughput, deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.operators.analyze import chunks
from narrate_spark.operators.jobs import throughput
from narrate_spark.operators.segments import with_segments


def intake(
    chapters: DataFrame, split: Callable[[Column], Column], max_chars: int = K.DEFAULT_MAX_CHARS
) -> DataFrame:
    """Chunks of arriving chapters.

    Every step is a projection of the chapter row, so a stream needs no state.
    """
    return chunks(with_segments(chapters, split), max_chars)


def job_status(log: DataFrame) -> DataFrame:
    """Latest state and progress of every job; one small state row per job."""
    return log.groupBy("job_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.count(F.when(F.col("state") == "synthesizing", 1)).alias("total"),
        F.count(F.when(F.col("state") == "completed", 1)).alias("done"),
        F.max("ts").alias("updated_at"),
    )


def hourly_throughput(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Completions per hour; rows later than the watermark are not counted."""
    return throughput(log, "1 hour", watermark)


def deliveries(artifacts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each artifact once, as long as its repeats come within the watermark."""
    return artifacts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(
        ["book_id", "artifact"]
    )
