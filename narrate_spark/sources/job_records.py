"""Job records stored as JSON files, one directory per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.schemas import JOB

_DEFAULTS = {
    "book_title": "",
    "backend": "",
    "language": "",
    "voice": "",
    "speed": K.DEFAULT_SPEED,
    "paragraph_pause_ms": K.PARAGRAPH_PAUSE_MS,
    "chapter_pause_ms": K.CHAPTER_PAUSE_MS,
    "scene_break_pause_ms": K.SCENE_BREAK_PAUSE_MS,
    "chapter_title_pause_ms": K.CHAPTER_TITLE_PAUSE_MS,
    "max_chars": K.DEFAULT_MAX_CHARS,
    "keep_intermediates": False,
    "total_segments": 0,
    "completed_segments": 0,
}


def scan_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Every readable ``<root>/<job>/job.json`` with defaults filled in.

    Records that are broken, lack an id or timestamps, or hold an unknown state
    are left out.
    """
    raw = (
        spark.read.schema(JOB)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(f"{root.rstrip('/')}/*/job.json")
    )
    valid = raw.where(
        F.col("id").isNotNull()
        & F.col("state").isin(*K.TRANSITIONS)
        & F.col("created_at").isNotNull()
        & F.col("updated_at").isNotNull()
    )
    filled = {name: F.coalesce(name, F.lit(value)) for name, value in _DEFAULTS.items()}
    return valid.withColumns(filled)


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Append job records as JSON lines; the latest record of a job counts."""
    jobs.write.mode("append").json(path)
