"""The streaming views, run over the given tables as finished streams.

A finished log is replayed whole, so the watermark only has to exceed its span;
a live source passes the delay it accepts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from narrate_spark.operators.segments import paragraph_segments
from narrate_spark.operators.sizes import spread
from narrate_spark.plans import sql
from narrate_spark.plans.corpus import chapter_title, narration_text, table
from narrate_spark.plans.job_queries import LOG, log_of
from narrate_spark.streaming import live
from narrate_spark.storage import shared_dir
from narrate_spark.streaming.replay import file_stream, run_append, run_upsert

WHOLE_LOG = "3650 days"


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    # the pattern also accepts a table that is one plain file
    return file_stream(spark, f"{sf_dir.rstrip('/')}/{name}[.]parquet", schema)


def _events(spark, sf_dir):
    # event time of a stream has to be an instant
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_intake(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    docs = spread(docs, "doc_id", like=table(spark, sf_dir, "documents"))
    chapters = docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_idx"),
        chapter_title(F.col("doc_id"), F.col("text")).alias("title"),
        narration_text(F.col("doc_id"), F.col("text")).alias("text"),
    )
    rows = live.intake(chapters, paragraph_segments, 300)
    rows = rows.select("book_id", "chapter_idx", "seg_pos", "chunk_idx", "kind", "text")
    return run_append(rows, shared_dir(spark))


def q_status(spark, sf_dir):
    status = live.job_status(log_of(_events(spark, sf_dir)))
    rows = run_upsert(status, shared_dir(spark), ["job_id"])
    return rows.select(
        "job_id", "state", "total", "done",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


def q_throughput(spark, sf_dir):
    hourly = live.hourly_throughput(log_of(_events(spark, sf_dir)), WHOLE_LOG)
    rows = run_upsert(hourly, shared_dir(spark), ["window_start"])
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "completions"
    )


def q_deliveries(spark, sf_dir):
    events = _events(spark, sf_dir)
    made = events.select(
        "ts",
        F.col("event_type").alias("book_id"),
        F.concat(F.lit("seg_"), F.col("user_id").cast("string"), F.lit(".wav")).alias("artifact"),
    )
    return run_append(live.deliveries(made, WHOLE_LOG), shared_dir(spark)).select("book_id", "artifact")


QUERIES = {
    "stream_intake": q_intake,
    "stream_job_status": q_status,
    "stream_throughput": q_throughput,
    "stream_deliveries": q_deliveries,
}

_STAMP = "'%Y-%m-%d %H:%M:%S'"

ORACLES = {
    "stream_intake": f"WITH {sql.BASE}, {sql.chunk_rows(300)} SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, chunk_idx, kind, text FROM chunk",
    "stream_job_status": f"WITH {LOG} SELECT job_id, arg_max(state, seq) AS state, count(*) FILTER (state = 'synthesizing') AS total, "
    f"count(*) FILTER (state = 'completed') AS done, strftime(max(ts), {_STAMP}) AS updated FROM log GROUP BY job_id",
    "stream_throughput": f"WITH {LOG} SELECT strftime(date_trunc('hour', ts), {_STAMP}) AS window_start, count(*) AS completions FROM log "
    "WHERE state = 'completed' GROUP BY 1",
    "stream_deliveries": "SELECT DISTINCT event_type AS book_id, 'seg_' || user_id || '.wav' AS artifact FROM events",
}
