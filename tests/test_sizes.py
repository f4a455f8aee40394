"""Partitions and memory follow the size of the input."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from narrate_spark.operators import segments as G
from narrate_spark.operators import sizes
from narrate_spark.plans import page_queries, plan_queries

SMALL = "/root/testdata/sf0.001"


def test_a_larger_input_has_more_partitions(spark, monkeypatch):
    df = spark.range(1000)
    cores = spark.sparkContext.defaultParallelism
    for size in (cores << 26, 6 << 30):
        monkeypatch.setattr(sizes, "input_bytes", lambda _, n=size: n)
        parts = sizes.spread(df, "id").rdd.getNumPartitions()
        assert size / parts <= sizes.SPREAD_BYTES
        assert size / sizes.spread(df, "id", part_bytes=1 << 20).rdd.getNumPartitions() <= 1 << 20
    assert sizes.spread_parts(0, 12) == 1


def test_spread_text_is_not_moved_again_for_segment_numbers(spark):
    rows = spark.range(40).select(
        (F.col("id") % 3).cast("string").alias("book_id"), F.col("id").alias("chapter_idx"), F.array(F.lit("a"), F.lit("b")).alias("segs")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = G.with_segment_offset(sizes.spread(rows, *G.CHAPTER_KEY, part_bytes=64))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        moved = [r for r in plan.splitlines() if "Exchange hashpartitioning(book_id" in r and "ENSURE_REQUIREMENTS" in r]
        assert len(moved) == 1  # the narrow rows
        numbers = sorted((r.book_id, r.chapter_idx, r.seg_offset) for r in joined.collect())
        assert numbers == [(str(b), c, 2 * (c // 3)) for b in range(3) for c in range(b, 40, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_archives_are_sent_on_in_bounded_batches():
    n = 1000
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(n), pa.int64()), "html": ["<p>x</p>"] * n})
    made = list(page_queries._archives([batch]))
    assert sum(b.num_rows for b in made) == n
    assert max(b.num_rows for b in made) <= 256
    assert made[1].column("book_id")[0].as_py() == "256"


def test_sums_over_chapters_read_the_text_once(spark, monkeypatch):
    def no_second_pass(chapters):
        raise AssertionError("segments are counted in a pass of their own")

    monkeypatch.setattr(G, "segment_offsets", no_second_pass)
    for rows in (plan_queries.markers(spark, SMALL), plan_queries.q_merged(spark, SMALL)):
        assert rows.count() > 0
