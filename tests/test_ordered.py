import random

import pytest
from pyspark.sql import functions as F

from narrate_spark.operators import ordered


def rows(seed, count):
    """A third of all rows belongs to one key, and one key is null."""
    rng = random.Random(seed)
    keys = ["hot"] * 3 + ["a", "b", "c", None, "d", "e"]
    made, position = [], -50
    for _ in range(count):
        position += rng.choice([1, 30, 10**12])
        made.append((rng.choice(keys), position, rng.randint(0, 9) if rng.random() > 0.3 else None))
    return made


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_sum_before(spark, parts):
    data = rows(parts, 1500)
    df = spark.createDataFrame(data, "k string, o bigint, v int").repartition(5)
    got = ordered.sum_before(df, ["k"], "o", F.coalesce("v", F.lit(0)), "s", parts=parts)
    expected, running = {}, {}
    for k, o, v in data:
        expected[o] = running.get(k, 0)
        running[k] = running.get(k, 0) + (v or 0)
    assert {r.o: r.s for r in got.collect()} == expected


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_last_before_with_ties(spark, parts):
    data = [(k, o // 3, o, v) for k, o, v in rows(40, 1500)]
    df = spark.createDataFrame(data, "k string, o bigint, p bigint, v int").repartition(5)
    got = ordered.last_before(df, ["k"], ["o", "p"], F.col("v"), "l", cheap=True, parts=parts)
    expected, last = {}, {}
    for k, _, p, v in data:
        expected[p] = last.get(k)
        if v is not None:
            last[k] = v
    assert {r.p: r.l for r in got.collect()} == expected


def test_without_keys_and_without_rows(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), F.col("id")).alias("name"))
    got = ordered.sum_before(df, [], "name", F.lit(1), "rank", parts=5)
    assert {r.name: r["rank"] for r in got.collect()} == {n: i for i, n in enumerate(sorted(f"s{i}" for i in range(100)))}
    assert ordered.sum_before(df.limit(0), [], "name", F.lit(1), "rank").isEmpty()
    assert ordered.last_before(df.where("name = ''"), ["name"], "name", F.lit(1), "x").isEmpty()


def test_rows_are_exchanged_twice_and_one_key_fills_several_partitions(spark, monkeypatch):
    placed, plans = [], []
    write = ordered.stored

    def stored(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        placed.append(write(rows))
        return placed[-1]

    monkeypatch.setattr(ordered, "stored", stored)
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("o"))
    got = ordered.sum_before(df, ["k"], "o", F.lit(1), "s", cheap=True, parts=8)
    assert got.where("s <> o").isEmpty()
    sizes = [r["count"] for r in placed[0].groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000
    assert plans[0].count("Exchange rangepartitioning") == 1
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # besides the broadcast: rows by (partition, group), edges by (partition, group) and by group
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("BroadcastExchange") == 1
