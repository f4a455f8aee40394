"""Job records: transitions, current state, listings, eligibility.

The job log is append-only: job_id, seq (log position), ts, state.  Order is the
log position; ranges of it are scanned, so a job may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.operators.ordered import last_before


def transitions(spark: SparkSession) -> DataFrame:
    """Legal transitions as rows (a fixed, tiny table)."""
    steps = [(a, b) for a, targets in K.TRANSITIONS.items() for b in targets]
    rows = ",".join(f"('{a}', '{b}')" for a, b in steps)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(from_state, to_state)")


def check_transitions(log: DataFrame) -> DataFrame:
    """State steps of every job: job_id, seq, before, state, legal."""
    allowed = transitions(log.sparkSession).select(
        F.col("from_state").alias("before"), F.col("to_state").alias("state"), F.lit(True).alias("_ok")
    )
    stepped = last_before(log, ["job_id"], "seq", F.col("state"), "before", cheap=True)
    joined = stepped.withColumnRenamed("value", "state").join(F.broadcast(allowed), ["before", "state"], "left")
    legal = F.coalesce("_ok", F.lit(False)) | F.col("before").isNull()
    return joined.select(
        "job_id", "seq", F.coalesce("before", F.lit("")).alias("before"), "state", legal.alias("legal")
    )


def current_state(log: DataFrame) -> DataFrame:
    """Latest state of every job; partial aggregates carry the load."""
    return log.groupBy("job_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def can_resume(state: Column) -> Column:
    """Whether a job in this state can be resumed."""
    return state.isin(*K.RESUMABLE_STATES)


def progress_text(done: Column, total: Column) -> Column:
    """``done/total (pct%)``; a total of 0 divides as 1.

    The percentage is rounded from the double's exact value, ties to even.  The ``%.1f`` of
    ``format_string`` rounds its shortest decimal form instead, ties up.
    """
    pct = 100.0 * done / F.when(total == 0, 1).otherwise(total)
    shown = F.call_function("format_number", pct, F.lit("0.0"))
    return F.format_string("%d/%d (%s%%)", done.cast("bigint"), total.cast("bigint"), shown)


def job_listing(jobs: DataFrame) -> DataFrame:
    """Listing rows of jobs (id, title, state, done, total, created_at)."""
    title = F.when(F.coalesce("title", F.lit("")) == "", "—").otherwise(F.col("title"))
    return jobs.select(
        "job_id",
        title.alias("title"),
        "state",
        progress_text(F.col("done"), F.col("total")).alias("progress"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


def eligibility(jobs: DataFrame, intermediates: DataFrame) -> DataFrame:
    """Whether each job may be resumed, cancelled or assembled again."""
    kept = intermediates.select("job_id", F.lit(True).alias("_kept")).distinct()
    state = F.col("state")
    joined = jobs.join(kept, "job_id", "left")
    cancellable = ~state.isin(*K.TERMINAL_STATES) & (state != "assembling")
    return joined.select(
        "job_id",
        "state",
        can_resume(state).alias("can_resume"),
        cancellable.alias("can_cancel"),
        ((state == "completed") & F.coalesce("_kept", F.lit(False))).alias("can_reassemble"),
    )


def silent_outputs(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Completed jobs that spoke nothing or left no file (a warning, not an error)."""
    finished = jobs.where(F.col("state") == "completed").select("job_id", "total")
    no_text = finished.where(F.col("total") == 0).select("job_id", F.lit("no text").alias("reason"))
    no_file = finished.where(F.col("total") > 0).join(outputs.select("job_id"), "job_id", "left_anti")
    return no_text.unionByName(no_file.select("job_id", F.lit("no file").alias("reason")))


def request_error(output: Column, max_chars: Column) -> Column:
    """Error of a conversion request, else ''."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(output, r"[^/]*\z", 0), r"(?<=.)(\.[^.]+)\z", 1))
    shown = F.when(suffix == "", "(none)").otherwise(suffix)
    return (
        F.when(
            ~suffix.isin(*K.OUTPUT_SUFFIXES),
            F.concat(F.lit("Unsupported output extension '"), shown, F.lit("'. Use .m4b or .wav.")),
        )
        .when(max_chars <= 0, F.lit("max_chars must be a positive integer."))
        .otherwise("")
    )


def run_report(runs: DataFrame, audio_seconds: Column) -> DataFrame:
    """Times, real-time factor and speed-up per device of a run log.

    ``runs`` holds device and seconds.  The speed-up compares with the device
    ``cpu``; an audio length of 0 gives an infinite factor.
    """
    stats = runs.groupBy("device").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("seconds").alias("mean_s"),
        F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
        F.max(audio_seconds).alias("_audio"),
    )
    cpu = stats.where(F.col("device") == "cpu").select("mean_s").scalar()
    factor = F.when(F.col("_audio") > 0, F.col("mean_s") / F.nullif("_audio", F.lit(0.0)))
    return stats.select(
        "device",
        "runs",
        F.round("mean_s", 6).alias("mean_s"),
        "min_s",
        "max_s",
        F.round(F.coalesce(factor, F.lit(float("inf"))), 6).alias("rtf"),
        F.round(cpu / F.col("mean_s"), 6).alias("speed_up"),
    )


def throughput(log: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Completions per time window; streams pass a watermark."""
    rows = log.withWatermark("ts", watermark) if watermark else log
    hours = rows.where(F.col("state") == "completed").groupBy(F.window("ts", window).alias("w"))
    return hours.agg(F.count(F.lit(1)).alias("completions")).select(
        F.col("w.start").alias("window_start"), "completions"
    )
