"""Job log queries; ``events`` is read as the log of conversion jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.operators import jobs as J
from narrate_spark.operators.synthesize import job_failures
from narrate_spark.plans.corpus import table


def state_of(event_type: Column, event_id: Column) -> Column:
    """Job state an event stands for."""
    odd = event_id % 2 == 1
    return (
        F.when(event_type == "view", F.when(odd, "created").otherwise("analyzing"))
        .when(event_type == "click", F.when(odd, "ready").otherwise("synthesizing"))
        .when(event_type == "purchase", F.when(odd, "assembling").otherwise("completed"))
        .when(event_type == "error", F.lit("failed"))
        .otherwise(F.when(odd, "cancelled").otherwise("created"))
    )


def log_of(events: DataFrame) -> DataFrame:
    """Events as job log: job_id, seq, ts, state."""
    return events.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        state_of(F.col("event_type"), F.col("event_id")).alias("state"),
    )


def job_log(spark, sf_dir) -> DataFrame:
    """The job log of the given events."""
    return log_of(table(spark, sf_dir, "events"))


def q_transitions(spark, sf_dir):
    return J.check_transitions(job_log(spark, sf_dir)).select("job_id", "seq", "before", "state", "legal")


def q_transition_counts(spark, sf_dir):
    steps = J.check_transitions(job_log(spark, sf_dir))
    return steps.groupBy("before", "state", "legal").agg(F.count(F.lit(1)).alias("steps"))


def q_current(spark, sf_dir):
    rows = J.current_state(job_log(spark, sf_dir))
    return rows.select(
        "job_id", "state", J.can_resume(F.col("state")).alias("can_resume"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


def _jobs(spark, sf_dir) -> DataFrame:
    log = job_log(spark, sf_dir)
    return log.groupBy("job_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.min("ts").alias("created_at"),
        F.count(F.when(F.col("state") == "synthesizing", 1)).alias("total"),
        F.least(
            F.count(F.when(F.col("state") == "completed", 1)),
            F.count(F.when(F.col("state") == "synthesizing", 1)),
        ).alias("done"),
    )


def q_listing(spark, sf_dir):
    title = F.when(F.col("job_id") % 4 == 0, "").otherwise(F.concat(F.lit("Book "), F.col("job_id").cast("string")))
    return J.job_listing(_jobs(spark, sf_dir).withColumn("title", title))


def q_eligibility(spark, sf_dir):
    made = job_log(spark, sf_dir).where("state = 'synthesizing'").select("job_id")
    return J.eligibility(_jobs(spark, sf_dir), made)


def q_failures(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"),
        F.concat(F.lit("ValueError: "), F.col("props")).alias("error"),
    )
    jobs = J.current_state(job_log(spark, sf_dir)).select("job_id", "state")
    rows = job_failures(jobs, errors, J.transitions(spark))
    return rows.select("job_id", "state", F.coalesce("error_message", F.lit("")).alias("error_message"))


def q_silent(spark, sf_dir):
    outputs = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 150")
    return J.silent_outputs(_jobs(spark, sf_dir), outputs.select(F.col("user_id").alias("job_id")))


def q_throughput(spark, sf_dir):
    rows = J.throughput(job_log(spark, sf_dir))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "completions")


def q_report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    device = F.when(F.col("event_type") == "view", "cpu").when(F.col("event_type") == "click", "cuda").otherwise("other")
    runs = events.select(device.alias("device"), F.col("value").alias("seconds"))
    return J.run_report(runs, F.when(F.col("device") == "other", 0.0).otherwise(12.5))


QUERIES = {
    "job_transitions": q_transitions,
    "job_transition_counts": q_transition_counts,
    "job_current": q_current,
    "job_listing": q_listing,
    "job_eligibility": q_eligibility,
    "job_failures": q_failures,
    "job_silent_output": q_silent,
    "throughput_hourly": q_throughput,
    "rtf_report": q_report,
}

STATE_SQL = (
    "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN 'created' ELSE 'analyzing' END "
    "WHEN 'click' THEN CASE WHEN event_id % 2 = 1 THEN 'ready' ELSE 'synthesizing' END "
    "WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN 'assembling' ELSE 'completed' END "
    "WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 1 THEN 'cancelled' ELSE 'created' END END"
)
LOG = f"log AS (SELECT user_id AS job_id, event_id AS seq, ts, {STATE_SQL} AS state FROM events)"
_STEPS = (
    f"{LOG}, st AS (SELECT *, lag(state, 1, '') OVER (PARTITION BY job_id ORDER BY seq) AS before FROM log), "
    "ck AS (SELECT job_id, seq, before, state, before = '' OR (before || '>' || state) IN ('created>analyzing', 'created>cancelled', "
    "'analyzing>ready', 'analyzing>failed', 'analyzing>cancelled', 'ready>synthesizing', 'ready>failed', 'ready>cancelled', "
    "'synthesizing>assembling', 'synthesizing>failed', 'synthesizing>cancelled', 'assembling>completed', 'assembling>failed', "
    "'completed>synthesizing') AS legal FROM st)"
)
_JOBS = (
    f"{LOG}, jobs AS (SELECT job_id, arg_max(state, seq) AS state, min(ts) AS created_at, max(ts) AS updated_at, "
    "count(*) FILTER (state = 'synthesizing') AS total, "
    "least(count(*) FILTER (state = 'completed'), count(*) FILTER (state = 'synthesizing')) AS done FROM log GROUP BY job_id)"
)
_STAMP = "'%Y-%m-%d %H:%M:%S'"

ORACLES = {
    "job_transitions": f"WITH {_STEPS} SELECT * FROM ck",
    "job_transition_counts": f"WITH {_STEPS} SELECT before, state, legal, count(*) AS steps FROM ck GROUP BY ALL",
    "job_current": f"WITH {_JOBS} SELECT job_id, state, state IN ('created', 'ready', 'synthesizing', 'assembling') AS can_resume, "
    f"strftime(updated_at, {_STAMP}) AS updated FROM jobs",
    "job_listing": f"WITH {_JOBS} SELECT job_id, CASE WHEN job_id % 4 = 0 THEN '—' ELSE 'Book ' || job_id END AS title, state, "
    f"printf('%d/%d (%.1f%%)', done, total, 100.0 * done / greatest(total, 1)) AS progress, strftime(created_at, {_STAMP}) AS created FROM jobs",
    "job_eligibility": f"WITH {_JOBS} SELECT job_id, state, state IN ('created', 'ready', 'synthesizing', 'assembling') AS can_resume, "
    "state IN ('created', 'analyzing', 'ready', 'synthesizing') AS can_cancel, state = 'completed' AND total > 0 AS can_reassemble FROM jobs",
    "job_failures": f"WITH {_JOBS}, er AS (SELECT user_id AS job_id, arg_min('ValueError: ' || props, event_id) AS m FROM events "
    "WHERE event_type = 'error' GROUP BY user_id) SELECT job_id, CASE WHEN m IS NOT NULL AND state IN ('analyzing', 'ready', 'synthesizing', "
    "'assembling') THEN 'failed' ELSE state END AS state, coalesce(m, '') AS error_message FROM jobs LEFT JOIN er USING (job_id)",
    "job_silent_output": f"WITH {_JOBS} SELECT job_id, CASE WHEN total = 0 THEN 'no text' ELSE 'no file' END AS reason FROM jobs "
    "WHERE state = 'completed' AND (total = 0 OR job_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150))",
    "throughput_hourly": f"WITH {LOG} SELECT strftime(date_trunc('hour', ts), {_STAMP}) AS window_start, count(*) AS completions FROM log "
    "WHERE state = 'completed' GROUP BY 1",
    "rtf_report": "WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'cuda' ELSE 'other' END AS device, value FROM events), "
    "s AS (SELECT device, count(*) AS runs, avg(value) AS m, min(value) AS min_s, max(value) AS max_s FROM r GROUP BY device) "
    "SELECT device, runs, round(m, 6) AS mean_s, min_s, max_s, CASE WHEN device = 'other' THEN 'inf'::DOUBLE ELSE round(m / 12.5, 6) END AS rtf, "
    "round((SELECT m FROM s WHERE device = 'cpu') / m, 6) AS speed_up FROM s",
}
