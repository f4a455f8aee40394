import datetime as dt

from pyspark.sql import functions as F

from narrate_spark.operators import jobs as J
from narrate_spark.operators.segments import paragraph_segments
from narrate_spark.plans.job_queries import job_log, log_of
from narrate_spark.plans.corpus import table
from narrate_spark.sources.files import txt_chapters
from narrate_spark.streaming import live, replay

SF = "/root/testdata/sf0.001"


def split_events(spark, path):
    """Events as eight files in time order."""
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return events.schema


def test_status_over_many_batches(spark, tmp_path):
    schema = split_events(spark, str(tmp_path / "in"))
    stream = log_of(replay.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=2))
    got = replay.run_upsert(live.job_status(stream), str(tmp_path / "out"), ["job_id"])
    expected = live.job_status(job_log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.select(got.columns).collect()}


def test_throughput_over_many_batches(spark, tmp_path):
    schema = split_events(spark, str(tmp_path / "in"))
    stream = log_of(replay.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=3))
    got = replay.run_upsert(live.hourly_throughput(stream, "3650 days"), str(tmp_path / "out"), ["window_start"])
    expected = J.throughput(log_of(table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.collect()}


def test_late_rows_are_left_out(spark, tmp_path):
    path = str(tmp_path / "in")
    day = dt.datetime(2026, 1, 1)
    schema = "job_id bigint, seq bigint, ts timestamp, state string"
    for i, hours in enumerate([0, 10, 11, 0, 12]):
        # one file per batch, the fourth one many hours late
        row = [(1, i, day + dt.timedelta(hours=hours), "completed")]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)
    stream = replay.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    got = replay.run_upsert(live.hourly_throughput(stream), str(tmp_path / "out"), ["window_start"])
    assert sorted((r.window_start.hour, r.completions) for r in got.collect()) == [(0, 1), (10, 1), (11, 1), (12, 1)]


def test_intake_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Uno. Dos.\n\n***\n\nTres.")
    schema = spark.read.format("binaryFile").load(str(tmp_path / "in")).schema
    arriving = spark.readStream.format("binaryFile").schema(schema).load(str(tmp_path / "in"))
    chapters = txt_chapters(arriving.withColumn("book_id", F.element_at(F.split("path", "/"), -1)))
    got = replay.run_append(live.intake(chapters, paragraph_segments, 5), str(tmp_path / "out"))
    rows = sorted((r.seg_pos, r.chunk_idx, r.kind, r.text) for r in got.collect())
    assert rows == [(0, 0, "text", "Uno."), (0, 1, "text", "Dos."), (1, 0, "scene_break", ""), (2, 0, "text", "Tres.")]


def test_each_artifact_is_delivered_once(spark, tmp_path):
    path, now = str(tmp_path / "in"), dt.datetime(2026, 1, 1)
    for _ in range(2):
        rows = [("b", "x.wav", now), ("b", "x.wav", now), ("b", "y.wav", now)]
        spark.createDataFrame(rows, "book_id string, artifact string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = replay.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    got = replay.run_append(live.deliveries(stream), str(tmp_path / "out"))
    assert sorted(r.artifact for r in got.collect()) == ["x.wav", "y.wav"]


def test_empty_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema
    stream = log_of(replay.file_stream(spark, str(tmp_path / "in"), schema))
    assert replay.run_upsert(live.job_status(stream), str(tmp_path / "a"), ["job_id"]).count() == 0
    stream = log_of(replay.file_stream(spark, str(tmp_path / "in"), schema))
    assert replay.run_append(stream, str(tmp_path / "b")).count() == 0
