"""Batch synthesis with a speech function supplied by the user.

The library ships texts and stores results; the model is the user's.  The
factory runs once per task, so a model loads once and then serves every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K


class Audio(NamedTuple):
    """PCM audio; ``pcm`` may be left out when only the length matters."""

    rate: int
    channels: int
    width: int
    frames: int
    pcm: bytes | None = None


Speak = Callable[[str, str, str, float], Audio]

AUDIO_SCHEMA = (
    "book_id string, artifact string, rate bigint, channels bigint, width bigint, "
    "frames bigint, pcm binary, error string"
)


def _speak_row(speak: Speak, text: str, language: str, voice: str, speed: float) -> tuple:
    try:
        if not text.strip():
            raise ValueError("Cannot synthesize empty text")
        if not K.MIN_SPEED <= speed <= K.MAX_SPEED:
            raise ValueError(f"Speed must be between 0.5 and 2.0, got {speed}")
        audio = speak(text, language, voice, speed)
        tail = int(audio.rate * K.ACOUSTIC_TAIL_SECONDS) if audio.frames > 0 else 0
        pcm = audio.pcm
        if pcm is not None:
            pcm = pcm + b"\x00" * (tail * audio.channels * audio.width)
        return (audio.rate, audio.channels, audio.width, audio.frames + tail, pcm, None)
    except Exception as exc:  # noqa: BLE001 - a bad row must not fail the job
        return (None, None, None, None, None, f"{type(exc).__name__}: {exc}")


def apply_synthesizer(
    pending: DataFrame, factory: Callable[[], Speak], partitions: int | None = None
) -> DataFrame:
    """Speak every pending text; failures become rows with an ``error``.

    ``pending`` holds book_id, artifact, text, language, voice and speed.  Rows
    are spread by artifact, so a large book is shared by all tasks.
    """
    cols = ["book_id", "artifact", "text", "language", "voice", "speed"]
    rows = pending.select(*cols)
    if partitions:
        rows = rows.repartition(partitions, "artifact")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speak: Speak | None = None
        for batch in batches:
            speak = speak or factory()
            made = [
                _speak_row(speak, *row)
                for row in batch[["text", "language", "voice", "speed"]].itertuples(
                    index=False, name=None
                )
            ]
            out = batch[["book_id", "artifact"]].reset_index(drop=True)
            names = ["rate", "channels", "width", "frames", "pcm", "error"]
            audio = pd.DataFrame(made, columns=names, dtype=object)
            for name in names[:4]:
                audio[name] = audio[name].astype("Int64")
            yield pd.concat([out, audio], axis=1)

    return rows.mapInPandas(run, AUDIO_SCHEMA)


def job_failures(jobs: DataFrame, errors: DataFrame, allowed: DataFrame) -> DataFrame:
    """State of every job after its first error.

    The error is kept as ``Type: message``; the job moves to failed only where
    that is a legal transition.  ``errors`` holds job_id, error and an order
    column ``pos``; ``allowed`` holds the legal transitions.
    """
    first = errors.groupBy("job_id").agg(F.min_by("error", "pos").alias("error_message"))
    can_fail = allowed.where(F.col("to_state") == "failed").select(
        F.col("from_state").alias("state"), F.lit(True).alias("can_fail")
    )
    joined = jobs.join(first, "job_id", "left").join(F.broadcast(can_fail), "state", "left")
    failed = F.col("error_message").isNotNull() & F.coalesce("can_fail", F.lit(False))
    return joined.select(
        "job_id",
        F.when(failed, "failed").otherwise(F.col("state")).alias("state"),
        "error_message",
    )
