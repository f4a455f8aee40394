"""Mixing of sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a schedule, a weight at each
time, linear between the points given.  The integral of its schedule is the
source's weight in the mix: sources share the words of the mix in proportion, but
none is repeated more than ``most`` times; what that leaves is shared again by
weight among the others, until none is above.

The documents of a source stand in an order drawn by a hash, and are repeated in
that order.  A copy that begins after ``c`` words of the source is due when the
source has been asked for ``c`` words: the cumulative demand, the integral of the
schedule scaled to the target, is inverted for ``c``, and copies are sorted by
that time by range.  A source gives exactly its target, rounded to words: the copy
in which it ends is cut there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common
from narrate_spark.operators.ordered import sum_before

# Points (time, weight) of the schedules that the sources take in turn: falling, even and rising.
SCHEDULES = (((0.0, 8.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
# A source is taken so many times at most.
MOST = 3
# Repetitions of a source's row where its documents are joined.
SALTS = 32

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> list[float]:
    """Integral of a schedule up to each of its points."""
    out = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (u - t) * (w + v) / 2)
    return out


def time_of(share: Column, schedule: Schedule) -> Column:
    """Time at which a schedule has asked for a share, 0 to 1, of all it asks for."""
    sums = integral(schedule)
    asked = share * sums[-1]
    out = F.lit(schedule[-1][0])
    pieces = list(zip(schedule, schedule[1:], sums, strict=False))
    for (t, w), (u, v), before in reversed(pieces):
        # the root of w x + slope x^2 / 2 = rest, in the form that has no difference of near numbers
        slope, rest = (v - w) / (u - t), F.greatest(asked - before, F.lit(0.0))
        root = F.sqrt(F.greatest(w * w + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest == 0, 0.0).otherwise(2 * rest / (w + root))
        out = F.when(asked < before + (u - t) * (w + v) / 2, t + F.least(x, F.lit(u - t))).otherwise(out)
    return out


def target_sizes(sources: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """Add ``target`` to sources (kind: a number of ``weights``, source_size).

    Sources above ``most`` times their size are held there and the rest is shared
    anew by weight.  Every round is one aggregate, and a few sums come to the driver;
    there are no more rounds than steps in which sources are held.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("kind") + 1)
    rows = sources.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("double"))
    sizes = rows.agg(F.sum("source_size")).first()[0] or 0
    rate, held = 0.0, -1
    while True:
        # one sum per kind, so no sum of weights depends on the order of rows
        full = F.col("bound") <= F.lit(rate) * F.col("weight")
        parts = rows.groupBy("kind").agg(
            F.count(F.when(full, 1)).alias("held"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("size"),
            F.count(F.when(~full, 1)).alias("free"),
        ).collect()
        now, free = sum(r["held"] for r in parts), sum(r["free"] * weights[r["kind"]] for r in parts)
        if now == held or not free:
            break
        held, rate = now, (sizes - most * sum(r["size"] for r in parts)) / free
    return rows.withColumn("target", F.least("bound", F.lit(float(rate)) * F.col("weight"))).drop("bound", "weight")


def place_documents(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> DataFrame:
    """Each document with its source's figures and its place in the order of the source.

    Returns one row per row of ``docs`` (doc_id, text, source; other columns are
    not read): doc_id, source, kind, size, source_size, target, before (words of the
    source's documents that stand earlier).  Sources take the schedules in turn, by
    code point, a null source last.  A null text has size 0.  Rows that are alike in
    doc_id, source and text stand side by side.  Reruns give the same rows.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = common.stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").isNull().alias("last"),
            F.col("source").cast("string").alias("source"),
            words.alias("size"),
            F.xxhash64("doc_id", "text").alias("drawn"),
            # keeps rows that are alike apart, so they need not share a task
            F.monotonically_increasing_id().alias("row"),
        )
    )
    sources = rows.groupBy("last", "source").agg(F.sum("size").alias("source_size"))
    # one row per source; its size is no part of the order, it only rides along
    ranked = sum_before(sources, [], ["last", "source", "source_size"], F.lit(1), "rank")
    kinds = len(schedules)
    ranked = ranked.select("last", "source", "source_size", (F.col("rank") % kinds).cast("int").alias("kind"))
    targets = target_sizes(common.stored(ranked), [integral(s)[-1] for s in schedules], most)
    # a source may hold most documents: its row is repeated, and its documents are dealt among the repetitions
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    targets = common.stored(targets.withColumn("source", F.coalesce("source", F.lit("")))).withColumn("salt", salts)
    placed = sum_before(rows, ["last", "source"], ["drawn", "doc_id", "size", "row"], F.col("size"), "before", cheap=True)
    placed = placed.select("doc_id", "last", F.coalesce("source", F.lit("")).alias("source"), "size", "before", "row")
    placed = placed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    joined = placed.join(targets, ["last", "source", "salt"])
    source = F.when(~F.col("last"), F.col("source"))
    return joined.select("doc_id", source.alias("source"), "kind", "size", "source_size", "target", "before")


def copies(placed: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> Column:
    """The copies of each placed document that the mix takes: an array of (epoch, words, time)."""
    quota = F.round("target").cast("long")

    def due(begin: Column) -> Column:
        share = F.least(begin / F.nullif("target", F.lit(0.0)), F.lit(1.0))
        times = F.lit(None).cast("double")
        for kind, schedule in enumerate(schedules):
            times = F.when(F.col("kind") == kind, time_of(share, schedule)).otherwise(times)
        return times

    def copy(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("before")
        words = F.greatest(F.least(begin + F.col("size"), quota) - begin, F.lit(0))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), due(begin).alias("time"))

    every = F.transform(F.sequence(F.lit(0), F.lit(most - 1)).cast("array<bigint>"), copy)
    return F.filter(every, lambda c: c["words"] > 0)


def training_order(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> DataFrame:
    """The mix itself: one row per copy of a document, sorted by range of its training time.

    Returns doc_id, source, epoch (from 0), words (how many of the document's words
    from its start on are taken) and time.  Copies without words have no row; an
    empty table gives none.
    """
    placed = place_documents(docs, schedules, most)
    rows = placed.select("doc_id", "source", F.inline(copies(placed, schedules, most)))
    order = ["time", "source", "epoch", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all ``documents``, sorted by range of the time at which they are first due."""
    placed = place_documents(common.table(spark, sf_dir, "documents"))
    taken = placed.withColumn("copies", copies(placed))
    rows = taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
        F.get("copies", F.lit(0))["time"].alias("first_time"),
    )
    order = [F.col("first_time").asc_nulls_last(), F.col("source"), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
